"""Readers and writers for tables, edge lists, split files and layered datasets."""
