"""Registered queries: name -> (Spark callable, DuckDB SQL or None)."""
