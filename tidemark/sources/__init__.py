"""Readers and writers: monitor files, metadata, stored tables, and the adapter from event streams."""
