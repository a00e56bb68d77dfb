"""Column-expression helpers: sequence cleaning/chunking and score math."""
