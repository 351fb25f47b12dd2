"""Patterns with edit costs, and their text form p, p@k or p@k:insert,delete,substitute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("pattern", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("max_cost", "cost_ins", "cost_del", "cost_subst"))])


@dataclass(frozen=True)
class Pattern:
    """The first @ of the text form ends the pattern, so a pattern with an @ has to be made from its parts."""

    pattern: str
    max_cost: int = 0
    cost_ins: int = 1
    cost_del: int = 1
    cost_subst: int = 1

    def __post_init__(self):
        if min(self.max_cost, self.cost_ins, self.cost_del, self.cost_subst) < 0:
            raise ValueError("costs may not be negative")

    @classmethod
    def parse(cls, text: str) -> Pattern:
        pattern, at, rest = text.partition("@")
        if not at:
            return cls(pattern)
        k, colon, costs = rest.partition(":")
        if not k.strip().isdecimal():
            raise ValueError(f"bad maximal cost in {text!r}")
        parts = costs.split(",") if colon else ["1", "1", "1"]
        if len(parts) != 3 or not all(p.strip().isdecimal() for p in parts):
            raise ValueError(f"bad costs in {text!r}")
        return cls(pattern, int(k), *map(int, parts))

    def __str__(self) -> str:
        costs = (self.cost_ins, self.cost_del, self.cost_subst)
        if not self.max_cost:
            return self.pattern
        return f"{self.pattern}@{self.max_cost}" + ("" if costs == (1, 1, 1) else ":" + ",".join(map(str, costs)))


def of(pattern: str | Pattern) -> Pattern:
    return pattern if isinstance(pattern, Pattern) else Pattern.parse(pattern)
