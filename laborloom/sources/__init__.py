"""Readers, writers and the adapter from the sample star schema."""
