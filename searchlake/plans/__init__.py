"""Query trees, their parsers and the compiler to DataFrame plans."""
