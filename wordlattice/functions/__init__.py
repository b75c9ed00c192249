"""Text functions: patterns, plain-Python kernels and Spark column expressions."""
