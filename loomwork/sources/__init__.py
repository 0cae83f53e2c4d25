"""Readers: strict CSV, JSON lines, manifests and single-object JSON. All keep the order of the file in _ord."""
