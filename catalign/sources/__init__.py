"""Readers and writers for catalogue files."""
