"""Operators on DataFrames: structure, metadata, chunks, search, citations, answers, catalog and chat."""
