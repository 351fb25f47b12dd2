"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items.

Items and documents are normalised to words (A-Z lower-cased); a window is 13
consecutive words of an item, or all words of a shorter one.  The automaton's
letters are words, so that a text is scanned once, word by word, and a hit's words
map to byte offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm import textbytes as tb
from textsieve.llm.staging import Staged, map_batches
from textsieve.naming import free

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned for in as many passes as it needs.
BLOCK_BYTES = 16 << 20
HITS = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
HITS_DDL = "struct<n_words: long, words: array<long>, starts: array<long>, ends: array<long>, items: array<string>>"


def windows(text: str | None, size: int) -> set[bytes]:
    words = WORD.findall((text or "").encode("utf-8", "replace").lower())
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


class Scanner:
    """Windows with the items that they belong to; only the items' texts travel, and the automaton is built where it is used."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.items, self.size, self.automaton = items, size, None

    def __getstate__(self):
        return {"items": self.items, "size": self.size, "automaton": None}

    def build(self) -> None:
        found: dict[bytes, set[str]] = {}
        for item, text in self.items:
            for w in windows(text, self.size):
                found.setdefault(w, set()).add(item)
        self.of = {k: sorted(v) for k, v in found.items()}
        words = sorted({w for k in self.of for w in k.split()})
        a = pa.array(words, pa.binary())
        buf, off = tb.buffers(a)
        h = tb.hash_spans(buf, off[:-1], off[1:], tb.LOWER)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        number = {w: i + 1 for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.least = min((k.count(b" ") + 1 for k in self.of), default=1 << 60)
        for k in self.of:
            parts = k.split()
            self.automaton.add_word(tuple(number[w] for w in parts), (len(parts), k))
        if self.of:
            self.automaton.make_automaton()

    def scan(self, texts: pa.Array) -> list[dict]:
        """For each text its number of words, the hit words' numbers and bytes (maximal runs) and the items."""
        if self.automaton is None:
            self.build()
        buf, off = tb.buffers(texts)
        starts, ends, first = tb.runs(buf, off, tb.ALNUM)
        out = [{"n_words": int(n), "words": [], "starts": [], "ends": [], "items": []} for n in np.diff(first)]
        if not self.of or not len(starts):
            return out
        h = tb.hash_spans(buf, starts, ends, tb.LOWER)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        number = np.where(known, self.order[at] + 1, 0)
        own = tb.owner(first)
        # runs of words that the benchmark has, within a text
        edge = known.copy()
        edge[1:] &= ~(known[:-1] & (own[1:] == own[:-1]))
        begin = np.flatnonzero(edge)
        stop = known.copy()
        stop[:-1] &= ~(known[1:] & (own[1:] == own[:-1]))
        end = np.flatnonzero(stop) + 1
        long = end - begin >= self.least
        change = np.zeros(len(starts) + 1, np.int64)
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            for last, (n, key) in self.automaton.iter(tuple(number[a:b].tolist())):
                i, j = a + last - n + 1, a + last + 1
                if b" ".join(buf[starts[k] : ends[k]].tobytes().lower() for k in range(i, j)) != key:
                    continue
                change[i] += 1
                change[j] -= 1
                out[own[i]].setdefault("found", set()).update(self.of[key])
        hit = np.cumsum(change[:-1]) > 0
        where = np.flatnonzero(hit)
        for i in where.tolist():
            mine, k = out[own[i]], int(i - first[own[i]])
            a, b = int(starts[i] - off[own[i]]), int(ends[i] - off[own[i]])
            if mine["words"] and mine["words"][-1] == k - 1:
                mine["ends"][-1] = b
            else:
                mine["starts"].append(a)
                mine["ends"].append(b)
            mine["words"].append(k)
        for mine in out:
            mine["items"] = sorted(mine.pop("found", ()))
        return out


def merge(a: dict | None, b: dict) -> dict:
    """Unites what two passes found in a text."""
    if a is None:
        return b
    words = sorted({*a["words"], *b["words"]})
    spans: list[list[int]] = []
    for s, e in sorted([*zip(a["starts"], a["ends"]), *zip(b["starts"], b["ends"])]):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return {"n_words": b["n_words"], "words": words, "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted({*a["items"], *b["items"]})}


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 13, column: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs, and in `column` n_words, the hit words, their byte spans and the items of each text.

    A null text has no words.  Items without an id or without words have no windows.  An id that
    several rows share has the windows of them all.  An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    column = free(column, docs.columns)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // block_bytes) or 1
    staged = Staged(spark) if passes > 1 else None
    for k in range(passes):
        items = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        scanner = Scanner([tuple(r) for r in items], size)
        last = column if k else None

        def work(batch: pa.RecordBatch, scanner=scanner, last=last) -> pa.RecordBatch:
            found = scanner.scan(batch.column("text"))
            if last:
                found = [merge(a, b) for a, b in zip(batch.column(last).to_pylist(), found)]
                batch = batch.drop_columns([last])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, HITS)], [*batch.schema.names, column])

        plain = docs.drop(column) if k else docs
        schema = plain.withColumn(column, F.lit(None).cast(HITS_DDL)).schema
        docs = map_batches(docs, work, schema)
        if staged:
            docs = staged.put(docs, f"pass{k}")
    return docs


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the digest columns of every document; contaminated if at least one word in twenty is hit.

    Repeated rows and rows that share a doc_id are judged each by its own text; a null text is clean.
    """
    found = scan(docs.select("doc_id", F.col("text").cast("string")), benchmark)
    n_hit = F.size("hits.words").cast("long")
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.arrays_zip(F.col("hits.starts").alias("start"), F.col("hits.ends").alias("end")).alias("spans"),
    )


def contaminated(column: str = "hits"):
    n_hit = F.size(f"{column}.words")
    return (n_hit > 0) & (F.lit(20) * n_hit >= F.col(f"{column}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated; repeated rows stay, and so do null texts."""
    column = free("hits", docs.columns)
    found = scan(docs, benchmark, column=column)
    return found.where(~contaminated(column)).drop(column)


ORACLE = """
WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bx AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM bw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w FROM bx),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents),
dx AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w FROM dx),
hit AS (SELECT doc_id, item_id, n, i FROM dw JOIN win USING (n, w)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
