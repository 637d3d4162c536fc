"""Readers: ticker directory, submissions, filing documents, return index, archives, return XML."""
