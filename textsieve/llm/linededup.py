"""Fuzzy line deduplication.

A line is normalised to its words.  Equal lines are one; of different ones, the 64-bit
SimHashes of their words, of which long ones weigh more, are joined on pigeonhole blocks: of m blocks of bits, two hashes
that differ in BITS bits at most share m - BITS, and each choice of so many blocks is a
table of buckets.  A pair is compared in the first table in which it meets, by its edit
similarity in characters.  Of each connected group of lines, the first occurrence in the
order of (doc_id, line) stays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm import textbytes as tb
from textsieve.llm.buckets import Forest, Sides, across, dealt, tasks, unite_groups
from textsieve.llm.components import components
from textsieve.llm.editsim import Compared
from textsieve.llm.staging import Staged, map_batches, trimmed
from textsieve.naming import free
from textsieve.shipping import ensure

BITS = 6
#: Hashes in a bucket, about, beyond which the 64 bits are cut into more blocks, which finds the same pairs.
DENSE = 2048
#: A word of more bytes counts as its windows of PIECE bytes, so that scripts without spaces have several features.
LONG_WORD, PIECE = 24, 9
_U = np.uint64
RECORD = np.dtype([("table", "u1"), ("sim", "<u8")])


def byte_lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that isn't empty: its first and one past its last byte, its text and its number there."""
    breaks = np.flatnonzero(buf == 10)
    begin, end = np.concatenate([off[:-1], breaks + 1]), np.concatenate([breaks, off[1:]])
    begin.sort()
    end.sort()
    full = np.flatnonzero(begin < end)
    begin, end = begin[full], end[full]
    text = tb.owner(np.searchsorted(begin, off))
    return begin, end, text, np.searchsorted(breaks, begin) - np.searchsorted(breaks, off[:-1])[text]


def lines(buf: np.ndarray, off: np.ndarray, least: int = 1):
    """Of each line with `least` words or more: its text, its number there, its first and one past its last word; and the words."""
    begin, end, text, number = byte_lines(buf, off)
    starts, ends, _ = tb.runs(buf, off, tb.ALNUM)
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    ok = np.flatnonzero(b - a >= least)
    return text[ok], number[ok], a[ok], b[ok], starts, ends


def neighbours(a: np.ndarray, b: np.ndarray) -> np.ndarray | slice:
    """The words of all lines, of words a to b, in a row; a slice if no word stands between lines."""
    return slice(int(a[0]), int(b[-1])) if (a[1:] == b[:-1]).all() else tb.spans(a, b - a)


def weights(length: np.ndarray) -> np.ndarray:
    """What words of so many bytes count: short ones, which all lines have, hardly anything."""
    return np.maximum(np.minimum(length, 30) - 3, 0).astype(_U) ** _U(2) + _U(1)


def majority(h: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHashes of groups of size[i] > 0 neighbouring hashes: the bits that have more than half of their weight."""
    pieces = -(-size // 64)  # four counters in a word hold 64 weights of up to 730
    group = np.cumsum(pieces) - pieces
    nth = np.arange(int(pieces.sum())) - np.repeat(group, pieces)
    first = np.repeat(np.cumsum(size) - size, pieces) + 64 * nth
    total = np.add.reduceat(weight, np.cumsum(size) - size).astype(np.int64)
    out = np.empty((len(size), 64), bool)
    for k in range(16):
        lanes = np.add.reduceat((h >> _U(k) & _U(0x0001000100010001)) * weight, first).view(np.uint16).reshape(-1, 4)
        out[:, k::16] = 2 * np.add.reduceat(lanes, group, axis=0, dtype=np.int64) > total[:, None]
    return np.packbits(out, axis=1, bitorder="little").view(_U).reshape(-1)


def exact_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the lines of words a to b, whose hashes are h: a hash of the words in their order."""
    if not len(a):
        return np.zeros(0, _U)
    size = b - a
    begin = np.cumsum(size) - size
    nth = np.arange(int(size.sum()), dtype=_U)
    nth -= np.repeat(begin.astype(_U), size)
    nth *= _U(0x9E3779B97F4A7C15)
    nth += h[neighbours(a, b)]
    return tb.mix(np.add.reduceat(tb.mix(nth), begin) + size.astype(_U))


def simhashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SimHashes of the lines of words a to b, over weighted words and the windows of long ones."""
    if not len(a):
        return np.zeros(0, _U)
    size = b - a
    mine = neighbours(a, b)
    length = (ends - starts)[mine]
    if (length <= LONG_WORD).all():
        return majority(h[mine], weights(length), size)
    pieces = np.where(length > LONG_WORD, length - PIECE + 1, 1)
    # long words side by side, of which the windows are hashed; the others' hashes are known
    long = np.flatnonzero(length > LONG_WORD)
    at = tb.spans(np.cumsum(length[long]) - length[long], pieces[long])
    each, size_of = np.repeat(h[mine], pieces), np.repeat(length, pieces)
    inside = tb.spans((np.cumsum(pieces) - pieces)[long], pieces[long])
    each[inside] = tb.hash_spans(buf[tb.spans(starts[mine][long], length[long])], at, at + PIECE, tb.LOWER)
    size_of[inside] = PIECE
    return majority(each, weights(size_of), np.add.reduceat(pieces, np.cumsum(size) - size))


def outline(docs: DataFrame, least: int) -> DataFrame:
    """doc_id and, for each of its lines with `least` words or more, number, hash and SimHash."""
    kind = pa.list_(pa.struct([("n", pa.int32()), ("line", pa.int64()), ("sim", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = tb.buffers(batch.column("text"))
        text, number, a, b, starts, ends = lines(buf, off, least)
        h = tb.hash_spans(buf, starts, ends, tb.LOWER)
        line, sim = exact_hashes(h, a, b), simhashes(buf, starts, ends, h, a, b)
        inner = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(line.view(np.int64)), pa.array(sim.view(np.int64))], ["n", "line", "sim"])
        bounds = pa.array(np.searchsorted(text, np.arange(len(off))).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, inner).cast(kind)], ["doc_id", "lines"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lines array<struct<n: int, line: long, sim: long>>")


class Tables:
    """The tables of pigeonhole blocks for n hashes; pairs within BITS bits meet in one of them at least, for any n."""

    def __init__(self, n: int):
        m = BITS + 2
        while 2.0 ** ((64 // m) * (m - BITS)) * DENSE < n and m < 2 * BITS:
            m += 1
        edges = [64 * k // m for k in range(m + 1)]
        self.shift = [_U(e) for e in edges[:-1]]
        self.mask = [_U((1 << b - a) - 1) for a, b in zip(edges, edges[1:])]
        self.width = [_U(b - a) for a, b in zip(edges, edges[1:])]
        self.chosen = list(combinations(range(m), m - BITS))
        place = {c: k for k, c in enumerate(self.chosen)}
        # by the set of blocks that are equal: the table of the first of them
        self.first = np.array([place.get(tuple(k for k in range(m) if s >> k & 1)[: m - BITS], -1) for s in range(1 << m)], np.int16)

    def keys(self, table: int, sim: np.ndarray) -> np.ndarray:
        out = np.full(len(sim), table, _U)
        for k in self.chosen[table]:
            out = (out << self.width[k]) | (sim >> self.shift[k] & self.mask[k])
        return out

    def meets(self, differ: np.ndarray) -> np.ndarray:
        """From the bits in which two hashes differ to the table in which they are compared; -1 for equal hashes."""
        equal = np.zeros(len(differ), np.int64)
        for k, (s, m) in enumerate(zip(self.shift, self.mask)):
            equal |= ((differ >> s & m) == 0).astype(np.int64) << k
        return np.where(differ == 0, -1, self.first[equal])


def meetings(sims: DataFrame, tables: Tables, parts: int) -> DataFrame:
    """(key, table, sim) of hashes that meet another one within BITS bits in a bucket; hashes travel in one binary for each part."""
    ensure(sims.sparkSession)

    def split(batches):
        for batch in batches:
            sim = batch.column("sim").to_numpy().view(_U)
            record = np.empty((len(tables.chosen), len(sim)), RECORD)
            part = np.empty(record.shape, np.int64)
            for t in range(len(tables.chosen)):
                record[t]["table"], record[t]["sim"] = t, sim
                part[t] = (tb.mix(tables.keys(t, sim)) % _U(parts)).astype(np.int64)
            part, record = part.reshape(-1), record.reshape(-1)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(ends))
            record = record[order]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([record[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary())], ["part", "records"])

    def meet(batches):
        record = np.frombuffer(b"".join(b for batch in batches for b in batch.column("records").to_pylist()), RECORD)
        for t in np.unique(record["table"]).tolist():
            sim = record["sim"][record["table"] == t]
            key = tables.keys(t, sim)
            order = np.argsort(key)
            sim, key = sim[order], key[order]
            hit = np.zeros(len(sim), bool)
            # how many of its bucket come after each; those with the most go first
            edge = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
            after = np.repeat(edge, np.diff(edge, prepend=-1)) - np.arange(len(key))
            longest = np.argsort(-after, kind="stable")
            for d, n in enumerate(len(key) - np.cumsum(np.bincount(after)), 1):  # n have d or more
                i = longest[:n]
                differ = sim[i] ^ sim[i + d]
                close = np.flatnonzero(np.bitwise_count(differ) <= BITS)
                close = close[tables.meets(differ[close]) == t]
                hit[i[close]] = hit[i[close] + d] = True
            yield pa.RecordBatch.from_arrays([pa.array(tb.mix(key[hit]).view(np.int64)), pa.array(np.full(int(hit.sum()), t, np.int32)), pa.array(sim[hit].view(np.int64))], ["key", "table", "sim"])

    return sims.select("sim").mapInArrow(trimmed(split), "part int, records binary").repartition(parts, "part").mapInArrow(trimmed(meet), "key long, table int, sim long")


def normalised(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """line and its normalised text, for the lines numbered `ns` of the documents of `wanted`."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted.hint("shuffle_hash"), "doc_id").select("text", "ns")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = tb.buffers(batch.column("text"))
        begin, end, text, number = byte_lines(buf, off)
        asked = batch.column("ns")
        owner = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
        take = np.isin(text << 32 | number, owner << 32 | asked.flatten().to_numpy().astype(np.int64))
        begin, size = begin[take], (end - begin)[take]
        buf = buf[tb.spans(begin, size)]  # only these lines, each as a text
        _, _, a, b, starts, ends = lines(buf, np.concatenate([[0], np.cumsum(size)]), least)
        line = exact_hashes(tb.hash_spans(buf, starts, ends, tb.LOWER), a, b)
        low = tb.FOLD[buf].tobytes()
        plain = [b" ".join([low[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())]).decode("utf-8", "replace") for i, j in zip(a.tolist(), b.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), pa.array(plain, pa.string())], ["line", "plain"])

    return map_batches(rows, work, "line long, plain string").dropDuplicates(["line"])


def verified(members: DataFrame, tables: Tables, similarity: float, parts: int) -> DataFrame:
    """Links (u, v) of lines of edit similarity `similarity` or more, that connect what such links connect in each (key, block)."""
    cross = "root" in members.columns

    def work(batches):
        rows = [pa.Table.from_batches([b]) for b in batches]
        table = pa.concat_tables(rows).combine_chunks() if rows else None
        if table is None or not table.num_rows:
            return
        column = lambda c: table.column(c).to_numpy()
        group = tb.mix(column("key").view(_U) + column("block").astype(_U))
        order = np.argsort(group, kind="stable")
        group, line, sim, at = group[order], column("b")[order], column("sim")[order].view(_U), column("table")[order]
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        text = table.column("plain").combine_chunks().take(pa.array(order))
        compared = Compared(text)
        forest = Forest(len(line))
        sides = Sides(forest, np.repeat(np.arange(len(cut) - 1), np.diff(cut)), column("side")[order], column("root")[order]) if cross else None

        def near(x: np.ndarray, y: np.ndarray):
            if sides is not None:
                ok = sides.apart(x, y)
                x, y = x[ok], y[ok]
            differ = sim[x] ^ sim[y]
            bits = np.bitwise_count(differ).astype(np.int16)
            ok = np.flatnonzero(bits <= BITS)
            ok = ok[tables.meets(differ[ok]) == at[x[ok]]]
            x, y = x[ok], y[ok]
            n, m = compared.size[x], compared.size[y]
            return x, y, (-bits[ok] - 64.0 * np.abs(n - m) / np.maximum(np.maximum(n, m), 1)).astype(np.float32)

        def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            longest = np.maximum(compared.size[x], compared.size[y])
            return compared.within(x, y, np.floor((1 - similarity) * longest + 1e-9).astype(np.int64))

        unite_groups(cut, forest, near, alike)
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(line[links[:, k]]) for k in (0, 1)], ["u", "v"])

    ensure(members.sparkSession)
    return members.select("key", "block", "table", "b", "sim", "plain", *(["side", "root"] if cross else [])).repartition(parts, "key", "block").mapInArrow(trimmed(work), "u long, v long")


def near_lines(docs: DataFrame, distinct: DataFrame, similarity: float, staged: Staged, least: int) -> DataFrame:
    """Connected lines (u, v) of distinct (line, sim, at), v the least of its group."""
    sims = staged.put(distinct.groupBy("sim").agg(F.count("*").alias("lines")), "sims")
    n = sims.count()
    tables = Tables(n)
    met = meetings(sims, tables, tasks(sims, n, len(tables.chosen) * RECORD.itemsize))
    met = met.unionByName(sims.where("lines > 1").select(F.xxhash64("sim").alias("key"), F.lit(-1).alias("table"), "sim"))  # equal hashes
    met = staged.put(met, "met")
    of = distinct.join(met.select("sim").distinct(), "sim", "left_semi")
    wanted = of.groupBy("at.doc_id").agg(F.collect_list("at.n").alias("ns"))
    plain = staged.put(normalised(docs, wanted, least).withColumnRenamed("line", "b"), "plain")
    each = met.join(distinct.select("sim", F.col("line").alias("b")), "sim")
    members = staged.put(dealt(each), "members")
    length, rows = plain.agg(F.avg(F.octet_length("plain"))).first()[0] or 0, members.count()
    links = staged.put(verified(members.join(plain, "b"), tables, similarity, tasks(members, rows, 100 + 8 * length)), "links")
    roots = components(links, staged)
    if members.where("mix = 1").head(1):  # there are large buckets
        rest = staged.put(across(members, roots, "table", "sim"), "across")
        rows = rest.count()
        if rows:
            others = staged.put(verified(rest.join(plain, "b"), tables, similarity, tasks(rest, rows, 100 + 8 * length)), "links_across")
            roots = components(links.unionByName(others), staged)
    staged.drop("sims", "met", "plain", "members")
    return roots


def removals(docs: DataFrame, similarity: float, staged: Staged, least: int) -> DataFrame:
    """doc_id and the numbers of its lines that go."""
    seen = staged.put(outline(docs.where("doc_id IS NOT NULL"), least), "outlines")
    each = seen.select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.n", "l.line", "l.sim")
    distinct = staged.put(each.groupBy("line").agg(F.min(F.struct("doc_id", "n")).alias("at"), F.min("sim").alias("sim"), F.count("*").alias("times")), "distinct")
    roots = near_lines(docs, distinct, similarity, staged, least)
    group = distinct.join(roots, distinct["line"] == roots["u"], "left").select("line", F.coalesce("v", "line").alias("group"), "at", "times")
    kept = group.groupBy("group").agg(F.min("at").alias("kept"), F.sum("times").alias("times")).where("times > 1")
    goes = group.select("line", "group").join(kept, "group").select("line", "kept")
    gone = each.select("doc_id", "n", "line").join(goes, "line").where("kept != struct(doc_id, n)")
    out = staged.put(gone.groupBy("doc_id").agg(F.collect_set("n").alias("ns")), "removals")
    staged.drop("outlines", "distinct")
    return out


def without(texts: pa.Array, ns: pa.Array) -> pa.Array:
    """Texts without their lines numbered ns; null where the text is."""
    out = []
    for text, gone in zip(texts, ns):
        if not text.is_valid:
            out.append(None)
            continue
        parts = text.as_py().split("\n")
        keep = np.ones(len(parts), bool)
        keep[gone.values.to_numpy()] = False
        out.append("\n".join([parts[k] for k in np.flatnonzero(keep).tolist()]))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, similarity: float = 0.9, column: str = "n_removed", least: int = 1) -> DataFrame:
    """All columns of docs, with text less the lines that go, and how many those are (0 if none).

    A line goes if an earlier one, in the order of (doc_id, line number), is equal or connected to it
    by lines whose SimHashes differ in BITS bits and whose edit similarity is `similarity` at least.
    Lines with fewer than `least` words stay, and lines without words always; so do rows without a
    doc_id and null texts.  Rows that share a doc_id lose the same lines.  A text without a line to go
    is unchanged, byte for byte; one of which all lines go is empty.  No rows give no rows.  The added
    column gets underscores until no column has its name, whatever the case.
    """
    column = free(column, docs.columns)
    going, id_ = free("going", [*docs.columns, column]), free("going_id", [*docs.columns, column])
    staged = Staged(docs.sparkSession)
    own = docs.select("doc_id", "text")
    gone = removals(own, similarity, staged, max(1, least)).select(F.col("doc_id").alias(id_), F.col("ns").alias(going))
    joined = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(id_), "left")
    rest = F.arrow_udf(without, "string")(F.when(F.col(going).isNotNull(), F.col("text").cast("string")), going)
    text = F.when(F.col(going).isNull(), F.col("text")).otherwise(rest).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.when(F.col(going).isNull(), 0).otherwise(F.size(going)).cast("long").alias(column))
