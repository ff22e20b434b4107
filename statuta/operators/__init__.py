"""Relational operators on documents, chunks, versions and graphs."""
