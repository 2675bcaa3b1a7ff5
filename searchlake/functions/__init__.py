"""Scalar building blocks: text analysis, dates, numbers, geography, vectors."""
