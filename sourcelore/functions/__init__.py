"""Column expressions for ids, texts and paths."""
