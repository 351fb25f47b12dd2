"""Searching a table by a pattern, with or without an index, and ranking by distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textsieve.functions import columns as c
from textsieve.functions.pattern import Pattern, of
from textsieve.naming import free
from textsieve.plans import planner
from textsieve.sources.index import TrigramIndex, conjuncts, shown

OPERATORS = ("%~~", "~~", "~~*", "~", "~*", "=", "!~~", "!~", "!~*")


def predicate(text: Column | str, op: str, right: str | Pattern) -> Column:
    """The exact predicate of an operator: %~~ approximate, ~~ LIKE, ~ regular expression, * without regard to case, ! not."""
    text = F.col(text) if isinstance(text, str) else text
    match op:
        case "%~~":
            return c.match(text, right)
        case "~~":
            return c.like(text, right)
        case "~~*":
            return c.ilike(text, right)
        case "~":
            return c.regex_match(text, right)
        case "~*":
            return c.regex_match(text, right, fold=True)
        case "=":
            return text == right
        case "!~~" | "!~" | "!~*":
            return ~predicate(text, op[1:], right)
    raise ValueError(f"unknown operator {op}")


def _literal(text: str) -> str:
    return "".join("\\" + x if x in "\\.[](){}*+?^$|" else x for x in text)


def query_of(op: str, right: str | Pattern) -> planner.GramQuery:
    """What an index can tell about an operator; nothing of those that don't regard case, or of negations."""
    match op:
        case "%~~":
            p = of(right)
            return planner.gram_query(p.pattern, p.max_cost)
        case "~~":
            parts = c.like_parts(right)
            return planner.gram_query(".*".join(map(_literal, parts)), 0)
        case "~":
            return planner.gram_query(right, 0)
        case "=":
            return planner.gram_query(_literal(right), 0)
    return planner.GramQuery(())


def candidates(index: TrigramIndex, query: planner.GramQuery) -> DataFrame | None:
    """Keys of rows that may match, from an index; None if it can't tell or wouldn't help."""
    if not query.tiles:
        return None
    usable = index.usable(query.grams)
    query = planner.GramQuery(tuple(t & usable for t in query.tiles))
    if not all(query.tiles):
        return None
    frequency = index.frequencies(query.grams)
    if not planner.use_index(query, frequency, index.n_rows()):
        return None
    query = planner.rarest(query, frequency)
    own = index.postings(query.grams)
    have = own.groupBy("id").agg(F.collect_set("gram").alias("have"))  # no more than the pattern's grams
    full = [F.size(F.array_intersect(F.array(*map(F.lit, sorted(t))), F.col("have"))) == len(t) for t in query.tiles]
    return have.where(reduce(lambda a, b: a | b, full)).select(F.col("id").alias(index.catalogue.key))


def narrowed(df: DataFrame, text: str | Column, query: planner.GramQuery, index: TrigramIndex | None, where: str | None) -> DataFrame:
    """df, less rows that an index of the same expression, and of no fewer rows than `where` leaves, rules out."""
    if index is None or shown(text, df.columns)[0] != index.catalogue.text or not conjuncts(index.catalogue.where) <= conjuncts(where):
        return df
    keys = candidates(index, query)
    return df if keys is None else df.join(keys, index.catalogue.key, "left_semi")


def search(df: DataFrame, text: str | Column, op: str, right: str | Pattern, index: TrigramIndex | None = None, where: str | None = None) -> DataFrame:
    """Rows of df for which the operator, and `where`, hold.

    An index may only narrow what is checked.  It is used if it is of the same expression; one that has
    a condition of its own is used if the parts of that are among those of `where`.
    """
    df = df.where(where) if where else df
    return narrowed(df, text, query_of(op, right), index, where).where(predicate(shown(text, df.columns)[1], op, right))


def nearest(df: DataFrame, text: str | Column, pattern: str | Pattern, key: str, n: int, column: str = "dist", index: TrigramIndex | None = None, where: str | None = None) -> DataFrame:
    """The n matching rows of least distance, by key among equals; the distance is added as `column`, with underscores if df has that name."""
    p, column = of(pattern), free(column, df.columns)
    df = df.where(where) if where else df
    rows = narrowed(df, text, query_of("%~~", p), index, where)
    return rows.withColumn(column, c.distance(shown(text, df.columns)[1], p)).where(F.col(column).isNotNull()).orderBy(column, key).limit(n)


def nearest_by_group(df: DataFrame, text: str, pattern: str | Pattern, group: str, key: str | list[str], n: int, column: str = "dist", rank: str = "rank") -> DataFrame:
    """The n matching rows of least distance in each group; distance and rank are added, with underscores if df has these names."""
    column = free(column, df.columns)
    rank = free(rank, [*df.columns, column])
    found = df.withColumn(column, c.distance(text, pattern)).where(F.col(column).isNotNull())
    order = W.partitionBy(group).orderBy(column, *([key] if isinstance(key, str) else key))
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """About `share` of the rows, the same ones however the table is dealt out: those whose key's hash is small."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") < F.lit(share * 2**32))
