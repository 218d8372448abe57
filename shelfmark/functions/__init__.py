"""Column functions: native expressions only, no Python per row."""
