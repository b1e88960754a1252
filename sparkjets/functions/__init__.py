"""Column-level functions: in, out, and nothing but Spark expressions."""
