"""Best-fit packing of token sequences by exact complements.

A document's token ids are cut into pieces of at most `room` tokens.  All pieces of
one length are alike, so the packing is planned on the number of pieces of each
length, a table of at most `room` rows however large the corpus is.  Where a piece
leaves a gap, combinations of one, two or three lengths that fill it exactly are
taken while they last; the rest goes by best fit, longest first.  Each row of the
plan takes a run of pieces of one length to a run of sequences, and pieces find
their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsieve.llm.staging import Staged, map_batches, partitions
from textsieve.llm.wordbpe import Encoder

SEPARATOR = (0).to_bytes(4, "little")


def pieces(docs: DataFrame, encode: Encoder, room: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document; a null text is empty, so that it has the separator alone."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, off = encode(batch.column("text"))
        doc, piece, start, length, crc = [], [], [], [], []
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            data = ids[a:b].tobytes() + SEPARATOR
            for k, at in enumerate(range(0, len(data), 4 * room)):
                part = data[at : at + 4 * room]
                doc.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        doc_id = batch.column("doc_id").take(pa.array(doc, pa.int32()))
        return pa.RecordBatch.from_arrays([doc_id, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Rows by length and then rank: pieces of ranks from `rank` on go `each` to a sequence, from `sequence` on, at `offset` and after one another."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.float64)
        row = np.empty(len(length), np.int64)
        for n in np.unique(length):
            a, b = np.searchsorted(key, [n, n + 1])
            mine = length == n
            row[mine] = a + np.searchsorted(self.rank[a:b], rank[mine], "right") - 1
        past = rank - self.rank[row]
        seq, nth = np.divmod(past, self.each[row])
        return self.sequence[row] + seq, self.offset[row] + nth * length


def plan(count: np.ndarray, room: int) -> Plan:
    """count[n]: how many pieces have n tokens."""
    left = np.zeros(room + 1, np.int64)
    left[: len(count)] = count
    used = np.zeros(room + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(n: int, each: int, bins: int, base: int, offset: int) -> None:
        rows.append((n, int(used[n]), base, each, offset))
        used[n] += each * bins
        left[n] -= each * bins

    def fill(parts: list[int], bins: int) -> None:
        nonlocal sequences
        at = 0
        for n in parts:
            take(n, 1, bins, sequences, at)
            at += n
        sequences += bins

    if left[room]:
        fill([room], int(left[room]))
    # index of sums of two lengths, from the larger of the two; as counts only fall, what was absent stays absent
    for n in range(room - 1, 0, -1):
        gap = room - n
        while left[n] > 0:
            need = gap
            if left[need] >= (2 if need == n else 1):
                fill([n, need], int(left[n] // 2 if need == n else min(left[n], left[need])))
                continue
            found = _pair(left, n, gap) or _triple(left, n, gap)
            if not found:
                break
            parts = [n, *found]
            uses = {p: parts.count(p) for p in parts}
            fill(parts, int(min(left[p] // u for p, u in uses.items())))
    # best fit of the rest: open sequences by their gap
    open_: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]  # (base, how many)
    gaps: set[int] = set()
    for n in range(room, 0, -1):
        while left[n] > 0:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                each = room // n
                bins, rest = divmod(int(left[n]), each)
                for m, e in ((bins, each), (1, rest)):
                    if m and e:
                        take(n, e, m, sequences, 0)
                        open_[room - e * n].append((sequences, m))
                        gaps.add(room - e * n)
                        sequences += m
                continue
            base, bins = open_[gap].pop()
            each = gap // n
            full = min(bins, int(left[n]) // each)
            if full:
                take(n, each, full, base, room - gap)
                open_[gap - each * n].append((base, full))
                gaps.add(gap - each * n)
                base, bins = base + full, bins - full
            if bins and left[n]:
                each = int(left[n])
                take(n, each, 1, base, room - gap)
                open_[gap - each * n].append((base, 1))
                gaps.add(gap - each * n)
                base, bins = base + 1, bins - 1
            if bins:
                open_[gap].append((base, bins))
            if not open_[gap]:
                gaps.discard(gap)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences)


def _pair(left: np.ndarray, n: int, gap: int, floor: int = 1) -> list[int] | None:
    """Two lengths that are at hand beside a piece of n tokens and sum to gap, the larger first."""
    a = np.arange((gap + 1) // 2, gap - floor + 1)
    b = gap - a
    ok = (left[a] > (a == n)) & (left[b] > (b == n).astype(int) + (a == b))
    i = np.flatnonzero(ok)
    return [int(a[i[-1]]), int(b[i[-1]])] if len(i) else None


def _triple(left: np.ndarray, n: int, gap: int) -> list[int] | None:
    have = np.flatnonzero(left[:gap] > 0)
    for a in have[::-1].tolist():
        if a < (gap + 2) // 3:
            break
        if a >= gap - 1 or left[a] <= (a == n):
            continue
        left[a] -= 1
        pair = _pair(left, n, gap - a)
        left[a] += 1
        if pair:
            return [a, *pair]
    return None


def pack(docs: DataFrame, tokenizer_path: str, room: int = 2048) -> DataFrame:
    """Each piece of each document with its sequence_id and its offset there.

    A null text is empty: one piece, the end token.  Repeated rows, and rows that share a doc_id, have
    pieces each of its own, and so have those with a null doc_id.  Pieces of one length are alike to
    the plan, ties among them by doc_id and piece.  Columns besides doc_id and text aren't read; no
    rows give no rows.

    Ranks are by a hash of doc_id within (length, bucket), and buckets of a length are laid
    after one another, so a length that a third of all pieces has is ranked by many tasks.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    buckets = 4 * partitions(spark)
    found = staged.put(pieces(docs, Encoder(tokenizer_path), room).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    # at most `buckets` rows of each length
    sizes = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = staged.put(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "sizes")
    count = np.zeros(room + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `room` rows
        count[r["length"]] = r["n"]
    layout = plan(count, room)
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece")).cast("long") - 1
    ranked = found.withColumn("rank", rank).join(sizes.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches):
        for batch in batches:
            seq, off = layout.place(*(batch.column(c).to_numpy() for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [*batch.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*(ranked.schema[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)
