"""Logical plans that derive ledger tables from other tables."""
