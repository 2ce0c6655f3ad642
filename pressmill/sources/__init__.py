"""Readers, writers, registries and declared schemas."""
