"""Registered queries over the TPC-H-like test tables, each with its SQL oracle."""
