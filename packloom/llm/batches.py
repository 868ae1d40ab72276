"""Sizes of what a Python worker holds."""

from packloom.functions.batches import KEY, TEXT_ROWS, bound_batches

__all__ = ["KEY", "TEXT_ROWS", "bound_batches"]
