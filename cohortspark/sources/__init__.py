"""Readers and writers for dataset bundles, study folders and registry files."""
