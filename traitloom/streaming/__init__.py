"""Structured Streaming forms of the ledgers; each gives what its batch form gives."""
