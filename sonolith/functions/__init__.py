"""Column functions: geometry, levels, text and time."""
