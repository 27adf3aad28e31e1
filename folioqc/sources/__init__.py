"""Readers and writers for packages, files, manifests and environment files."""
