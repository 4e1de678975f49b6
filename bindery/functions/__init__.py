"""Column expressions: string, URL and title functions."""
