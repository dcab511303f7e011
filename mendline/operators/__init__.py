"""DataFrame operators; each takes and returns DataFrames and works on batch tables."""
