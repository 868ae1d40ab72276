"""Long texts in pieces that a worker can hold."""

from __future__ import annotations

from collections.abc import Iterator

#: bytes of one slice, beyond which it ends at the next blank
SLICE = 1 << 21


def slices(blob: bytes, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Start and end of the slices of a text whose words stand between blanks; no slice cuts a word."""
    at = 0
    while len(blob) - at > size:
        end = blob.find(b" ", at + size)
        if end < 0:
            break
        yield at, end
        at = end
    yield at, len(blob)
