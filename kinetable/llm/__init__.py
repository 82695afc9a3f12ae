"""Operators for preparing training data: duplicates, leaks, tokens, licences, secrets, quality, languages."""
