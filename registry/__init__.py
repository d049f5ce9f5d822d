"""The registered queries: domain tables derived from the given parquet tables, queries over them, and their SQL."""
