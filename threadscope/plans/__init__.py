"""Query catalogue: Spark plans (``registry``) and their DuckDB oracles (``oracle``)."""
