"""Operators for building training corpora: scoring, encoding, duplicate removal, search, sharding."""
