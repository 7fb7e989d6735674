"""Readers and writers of tree, sequence and variant files."""
