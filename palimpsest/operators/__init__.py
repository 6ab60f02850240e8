"""Operators on pages, threads, links and maps: DataFrames in, DataFrames out."""
