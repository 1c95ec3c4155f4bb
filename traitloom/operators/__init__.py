"""Joins, aggregates, windows, graph and ledger operators as DataFrame functions."""
