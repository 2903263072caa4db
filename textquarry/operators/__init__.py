"""Operators over corpora: search, file finding, terms, semantic ranking."""
