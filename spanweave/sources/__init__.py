"""Readers and writers. Parsing is an expression over text columns; files only deliver the text."""
