"""Readers, writers and the run/model registry."""
