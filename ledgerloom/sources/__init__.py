"""Stores and sources: the snapshot store, and blocks of a node as a data source."""
