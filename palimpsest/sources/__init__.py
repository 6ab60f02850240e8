"""Readers and writers of files and control files."""
