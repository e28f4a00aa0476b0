"""Readers and writers of the text formats, and stores of tables."""
