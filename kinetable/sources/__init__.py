"""Readers and writers for files, messages, payload and page tables."""
