"""Column expressions; every one is native and stays inside code generation."""
