"""Session settings and distributed building blocks."""
