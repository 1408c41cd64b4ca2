"""Registered queries over the given tables and the DuckDB SQL that says the same."""
