"""Reading and writing tables, metric documents and run records."""
