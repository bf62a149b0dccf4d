"""Readers and writers: source discovery, document formats, JSON lines and epoch snapshots."""
