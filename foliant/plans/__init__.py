"""Query registry: each module lists QUERIES (name -> callable) and SQL (name -> DuckDB text)."""
