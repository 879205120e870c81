"""Readers, writers and the domain views built on the input tables."""
