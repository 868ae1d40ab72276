"""Operators put together: from text to packed sequences, from packed sequences to ensemble scores."""
