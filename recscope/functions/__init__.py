"""Column functions: what records match, and how they are written."""
