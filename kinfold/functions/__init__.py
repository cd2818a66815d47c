"""Column functions: reproducible random numbers and distributed ranks."""
