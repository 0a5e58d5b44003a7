"""Readers and writers of graphs, sources and interchange formats."""
