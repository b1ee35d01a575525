"""Column builders for captions, geometry, time and hashing."""
