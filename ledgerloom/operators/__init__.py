"""Snapshot reads, unspent outputs, commit rules, derived views."""
