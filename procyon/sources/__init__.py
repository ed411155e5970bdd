"""Readers of captured listings, pages and documents, and table writers."""
