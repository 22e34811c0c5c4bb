"""Readers, writers and the projection of star-schema tables onto graph tables."""
