"""Column expressions: label maps, scalar helpers, text and time formatting."""
