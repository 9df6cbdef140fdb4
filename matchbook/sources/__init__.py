"""Readers, writers and the versioned gallery store."""
