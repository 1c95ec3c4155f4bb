"""Registered queries: the operators applied to the supplied tables, with DuckDB SQL beside them."""
