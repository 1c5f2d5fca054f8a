"""Sources of code and of block descriptions."""
