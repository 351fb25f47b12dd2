"""Names for added columns."""

from __future__ import annotations

from collections.abc import Iterable


def free(name: str, taken: Iterable[str]) -> str:
    """`name`, with as many underscores as it takes to differ from all of `taken`; case doesn't count, as in Spark."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
