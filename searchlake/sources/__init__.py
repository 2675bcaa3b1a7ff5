"""Mappings, document walking, index tables and their versions."""
