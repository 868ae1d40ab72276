"""Column helpers, index building, null-safe joins and staging shared by the operators."""
