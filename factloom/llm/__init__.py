"""Operators on text corpora: invalid sources, token ids, mixtures, abusive content."""
