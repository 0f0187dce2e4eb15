"""Spark-native analytics over versioned ledger tables: every read is pinned to one snapshot."""
