"""Spark library that turns semi-structured expense documents into ledger tables."""
