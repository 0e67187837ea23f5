"""Column names that don't clash with those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def free(columns: Iterable[str], name: str) -> str:
    """name, with underscores in front until no column is called so, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
