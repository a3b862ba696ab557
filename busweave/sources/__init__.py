"""Readers and writers for log text, dictionaries, sheets and training sets."""
