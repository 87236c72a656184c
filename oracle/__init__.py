"""DuckDB restatements of the registered queries, written independently of the Spark code."""
