"""Readers and parsers. A parser takes JSON held in a table, so it serves files and tables alike."""
