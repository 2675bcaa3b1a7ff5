"""Collectors over hits: sorting, paging, facets, vectors, fusion, highlighting."""
