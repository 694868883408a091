"""Readers and writers of vector files and of index directories."""
