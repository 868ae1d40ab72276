"""Null and empty texts, repeated rows, a null id, blanks only, and columns named like results."""

EDGE_ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "x", True, 1),
    (2, "alpha beta gamma delta epsilon zeta", "y", None, 2),
    (2, "alpha beta gamma delta epsilon zeta", "y", None, 2),
    (3, None, None, False, None),
    (4, "", "z", True, 4),
    (5, " \t\n", "z", True, 5),
    (None, "a text without an id", None, None, None),
    (7, "Ünïcode täxt \U0001f600 with four-byte letters", "u", True, 7),
    (8, "long " * 30_000, "l", True, 8),
]
EDGE_SCHEMA = "doc_id bigint, text string, score string, kept boolean, size int"
