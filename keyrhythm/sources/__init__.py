"""Readers and writers for the raw text, delimited, JSON, CSV and model formats."""
