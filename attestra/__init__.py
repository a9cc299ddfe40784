"""Versioned, evidence-backed record ledgers on Spark."""
