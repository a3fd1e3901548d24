"""Readers and writers for sample, label and annotation tables."""
