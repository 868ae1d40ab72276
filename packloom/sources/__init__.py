"""Readers and writers: text corpora, packed sequences, expert tables."""
