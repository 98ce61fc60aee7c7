"""Registered plans: every operator run over the driver tables, with its DuckDB equivalent."""
