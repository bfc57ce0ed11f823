"""Column functions: paths, sizes, binary fields."""
