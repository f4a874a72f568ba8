"""Column expressions (native Catalyst functions only, no Python UDFs)."""
