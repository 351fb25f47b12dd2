"""Sound prefilters: what every match must contain, as expressions that Spark runs by itself.

A formula is None (nothing is known), or ("has", text), ("all", [...]) or ("any", [...]).  With
k edits and k + 1 separate texts that an exact match must have, one of them stands unharmed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsieve.functions import regex as rx

MAX_TERMS = 64


def factors(node: rx.Node) -> list:
    """Separate parts of the pattern that an exact match must have, in order: texts, or alternatives of lists of parts."""
    out: list = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = ""

    def walk(n: rx.Node) -> None:
        nonlocal run
        match n:
            case rx.Chars(kind="literal"):
                run += chr(n.ranges[0][0])
            case rx.Concat():
                walk(n.left)
                walk(n.right)
            case rx.Empty():
                pass
            case rx.Alt():
                flush()
                out.append((factors(n.left), factors(n.right)))
            case rx.Repeat() if n.least >= 1:
                if n.least == n.most == 1:
                    walk(n.item)
                    return
                if (text := rx.literal(n.item)) is not None and n.least <= 8:
                    # the first copies follow on what stands before; what follows may be a further copy
                    run += text * n.least
                    flush()
                else:
                    flush()
                    out.extend(factors(n.item))
            case _:  # other characters, anchors, what may be missing, groups with a budget of their own
                flush()

    walk(node)
    flush()
    return out


def formula(pattern: str, k: int, fold: bool = False):
    """What holds for every text with a match of at most k edits."""
    node = rx.parse(pattern)
    return _of(factors(node), k, fold)


def _of(parts: list, k: int, fold: bool):
    if k == 0:
        known = [_part(p, 0, fold) for p in parts]
        return _all([x for x in known if x])
    texts = [p for p in parts if isinstance(p, str)]
    # longer texts may be cut, as each piece must be there
    pieces = sorted(texts, key=len, reverse=True)
    while pieces and len(pieces) < k + 1 and len(pieces[0]) >= 4:
        longest = pieces.pop(0)
        half = len(longest) // 2
        pieces = sorted([*pieces, longest[:half], longest[half:]], key=len, reverse=True)
    best = None
    if len(pieces) >= k + 1 and len(pieces[k]) >= 2:
        best = ("any", [("has", p) for p in _cut(texts, k + 1)])
    if best is None:
        for p in parts:
            if isinstance(p, tuple) and (got := _part(p, k, fold)):
                return got
    return best


def _cut(texts: list[str], n: int) -> list[str]:
    """n separate pieces of the texts, the shortest as long as can be."""
    size = max(len(t) for t in texts)
    while size > 1 and sum(len(t) // size for t in texts) < n:
        size -= 1
    pieces = []
    for t in texts:
        count = len(t) // size
        for k in range(count):  # what is left over goes to the last piece
            pieces.append(t[k * size : len(t) if k == count - 1 else (k + 1) * size])
    return sorted(pieces, key=len, reverse=True)[:n]


def _part(part, k: int, fold: bool):
    if isinstance(part, str):
        return ("has", part) if k == 0 else _of([part], k, fold)
    sides = [_of(side, k, fold) for side in part]
    return ("any", sides) if all(sides) else None


def _all(parts: list):
    return None if not parts else parts[0] if len(parts) == 1 else ("all", parts)


def pieces(f) -> list[str] | None:
    """The texts of a formula that asks for any of some texts; None for others."""
    if f is None or f[0] == "all" or f[0] == "any" and any(x[0] != "has" for x in f[1]):
        return None
    return [f[1]] if f[0] == "has" else [x[1] for x in f[1]]


def terms(f) -> int:
    return 0 if f is None else 1 if f[0] == "has" else sum(map(terms, f[1]))


def column(f, text: Column, fold: bool = False) -> Column | None:
    """The formula over a text column; None if it tells nothing or is too long to help.  fold: the pattern's case doesn't matter."""
    if f is None or terms(f) > MAX_TERMS:
        return None
    if f[0] == "has":
        return F.lower(text).contains(f[1].lower()) if fold else text.contains(f[1])
    parts = [column(x, text, fold) for x in f[1]]
    return reduce((lambda a, b: a & b) if f[0] == "all" else (lambda a, b: a | b), parts)


def show(f, depth: int = 0) -> str:
    if f is None:
        return "ALWAYS_TRUE (extraction defeated)"
    if f[0] == "has":
        return "  " * depth + f"HAS {f[1]!r}"
    return "\n".join(["  " * depth + ("AND" if f[0] == "all" else "OR"), *(show(x, depth + 1) for x in f[1])])
