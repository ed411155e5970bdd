"""Registered queries over the stand-in tables, with their SQL."""
