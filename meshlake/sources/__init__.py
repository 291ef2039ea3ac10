"""Readers and writers of table formats."""
