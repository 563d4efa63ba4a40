"""Column-to-Column building blocks (row-local, no shuffle)."""
