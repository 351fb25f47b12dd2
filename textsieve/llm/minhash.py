"""Near-duplicate documents by BagMinHash over bags of five-word shingles.

A shingle of weight w has a Poisson process of points (time, weight, register) for
each dyadic block of weights (0, 1], (1, 2], (2, 4], ...; within a block, successive
bits of a point's cell number descend to its unit of weight, and points above w are
left out.  A register keeps the earliest time of all its points, so two bags agree in
a register with the probability of their weighted Jaccard similarity.  Points come in
the order of time, and a process ends as soon as it is later than all registers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm import textbytes as tb
from textsieve.llm.buckets import Forest, Sides, across, dealt, tasks, unite_groups
from textsieve.llm.components import components
from textsieve.llm.staging import Staged, map_batches, trimmed
from textsieve.naming import free
from textsieve.shipping import ensure

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Bytes of a sketch: one for each register and eight for each band key.
WIDTH = BANDS * ROWS + 8 * BANDS
_U = np.uint64


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: text, hash and how often it occurs there.

    A text of one to four words has one shingle, and a text without words, but not empty, is its own.
    """
    buf, off = tb.buffers(texts)
    starts, ends, first = tb.runs(buf, off, tb.ALNUM)
    h = tb.hash_spans(buf, starts, ends, tb.LOWER)
    own = tb.owner(first)
    words = np.diff(first)
    ok = np.flatnonzero(tb.windows(first, SHINGLE, len(h)))
    text, shingle = [own[ok]], [tb.combine(h, SHINGLE)[ok]]
    for n in range(1, SHINGLE):
        few = np.flatnonzero(words == n)
        if len(few):
            text.append(few)
            shingle.append(tb.combine(h, n)[first[:-1][few]])
    bare = np.flatnonzero((words == 0) & (np.diff(off) > 0))
    text.append(bare)
    shingle.append(tb.hash_spans(buf, off[bare], off[bare + 1]))
    text, shingle = np.concatenate(text), np.concatenate(shingle)
    key = tb.mix(shingle + text.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    one = order[new]
    return text[one], shingle[one], np.diff(np.append(new, len(key)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n rows of m registers; registers of an empty bag are infinite."""
    out = np.full((n, m), np.inf)
    flat, top = out.reshape(-1), np.full(n, np.inf)
    own, seed, size, most = [], [], [], []
    level = 0
    while True:  # the dyadic blocks of weight
        low, width = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
        mine = np.flatnonzero(weight > low)
        if not len(mine):
            break
        own.append(text[mine])
        seed.append(tb.mix(shingle[mine] + _U(level * 0xA24BAED4963EE407 % 2**64)))
        size.append(np.full(len(mine), float(width)))
        most.append(weight[mine] - low)
        level += 1
    if not own:
        return out
    own, seed, size, most = map(np.concatenate, (own, seed, size, most))
    time = np.zeros(len(own))
    point = 0
    while len(own):
        point += 1
        r = tb.mix(seed + _U(point * 0x9E3779B97F4A7C15 % 2**64))
        time -= np.log1p(-((r >> _U(24)).astype(float) / 2.0**40)) / (m * size)
        live = time < top[own]
        if not live.all():
            own, seed, size, most, time, r = (x[live] for x in (own, seed, size, most, time, r))
        inside = np.ones(len(own), bool)
        wide = np.flatnonzero(size > 1)
        if len(wide):
            cell = (tb.mix(r[wide] ^ _U(0x5851F42D4C957F2D)) >> _U(11)).astype(float) / 2.0**53 * size[wide]
            inside[wide] = np.floor(cell) < most[wide]
        register = ((r & _U(0xFFFFFF)) * _U(m) >> _U(24)).astype(np.int64)
        np.minimum.at(flat, (own * m + register)[inside], time[inside])
        top = out.max(1)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, a hash `h` of its text, a fingerprint `node` of its bag, its band keys, null for an empty bag, and a byte of each register with the band keys after them."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        text, shingle, weight = bags(texts)
        n = len(texts)
        prints = np.zeros((n, 2), _U)
        for k, c in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            np.add.at(prints[:, k], text, tb.mix(shingle ^ _U(c)) * weight.astype(_U))
        node = fixed(prints.view(np.uint8).reshape(n, 16))
        registers = signatures(text, shingle, weight, n)
        empty = np.isinf(registers[:, 0])
        bits = registers.view(_U).reshape(n, BANDS, ROWS)
        key = np.zeros((n, BANDS), _U) + np.arange(BANDS, dtype=_U) * _U(0xD1B54A32D192ED03)
        for k in range(ROWS):
            key = tb.mix(key + bits[:, :, k])
        keys = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
        keys = pa.array([None if e else k for e, k in zip(empty, keys.to_pylist())], pa.list_(pa.int64())) if empty.any() else keys
        small = np.concatenate([tb.mix(bits.reshape(n, -1)).astype(np.uint8), key.view(np.uint8).reshape(n, -1)], axis=1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), node, keys, fixed(small)], ["doc_id", "h", "node", "keys", "registers"])

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, node binary, keys array<long>, registers binary")


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of pairs of texts."""
    both = packed(pa.concat_arrays([left, right]))
    n = len(left)
    return shares(both, np.arange(n), np.arange(n, 2 * n))


def packed(texts: pa.Array) -> pa.Array:
    """Each text's bag as 32-bit hashes of its shingles, of which each further occurrence has another."""
    text, shingle, weight = bags(texts)
    most = np.repeat(np.arange(len(text)), weight)
    nth = np.arange(len(most)) - np.repeat(np.cumsum(weight) - weight, weight)
    value = (tb.mix(shingle[most] + nth.astype(_U) * _U(0xC2B2AE3D27D4EB4F)) >> _U(32)).astype(np.uint32)
    own = text[most]
    order = np.argsort(own, kind="stable")
    off = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(value[order])])


def shares(bag: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of packed bags x[i] and y[i]."""
    data, off = tb.buffers(bag)
    data, off = data.view(np.uint32), off // 4
    out = np.zeros(len(x))
    size = off[1:] - off[:-1]
    for k in range(0, len(x), 512):
        i, j = x[k : k + 512], y[k : k + 512]
        n = np.concatenate([size[i], size[j]])
        first = np.concatenate([off[i], off[j]])
        pair = np.repeat(np.tile(np.arange(len(i)), 2), n)
        value = data[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        key = np.sort((pair.astype(_U) << _U(32)) | value.astype(_U))
        common = np.bincount((key[1:][key[1:] == key[:-1]] >> _U(32)).astype(np.int64), minlength=len(i))
        total = size[i] + size[j] - common
        out[k : k + 512] = np.divide(common, total, out=np.zeros(len(i)), where=total > 0)
    return out


#: Registers that agree, less than which bags of similarity 0.8 practically never have: 6 standard deviations.
SLACK = 0.25


def verified(members: DataFrame, least: float, parts: int) -> DataFrame:
    """Links (u, v) whose bags overlap by `least` or more and that connect what such links connect in each (key, block).

    Members are compared by their registers, and where those allow, the likeliest first, by their
    bags, unless links that were verified connect them already.  A pair that meets in several bands
    is compared in the first of them.  With a column `root`, a group has two blocks, members of one
    root are connected, and pairs within a block are left out.
    """
    cross = "root" in members.columns

    def work(batches):
        rows = [pa.Table.from_batches([b]) for b in batches]
        table = pa.concat_tables(rows).combine_chunks() if rows else None
        if table is None or not table.num_rows:
            return
        group = tb.mix(table.column("key").to_numpy().view(_U) + table.column("block").to_numpy().astype(_U))
        order = np.argsort(group, kind="stable")
        group = group[order]
        sketch = np.frombuffer(tb.buffers(table.column("sketch"))[0], np.uint8).reshape(-1, WIDTH)[order]
        sketch, keys = sketch[:, : BANDS * ROWS], sketch[:, BANDS * ROWS :].copy().view(_U)
        bag, band = table.column("bag").combine_chunks(), table.column("band").to_numpy()[order]
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        forest = Forest(len(group))
        sides = None
        if cross:
            root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()[order]
            sides = Sides(forest, np.repeat(np.arange(len(cut) - 1), np.diff(cut)), table.column("side").to_numpy()[order], root)

        def near(x: np.ndarray, y: np.ndarray):
            if sides is not None:
                ok = sides.apart(x, y)
                x, y = x[ok], y[ok]
            share = (sketch[x] == sketch[y]).mean(1, dtype=np.float32)
            ok = np.flatnonzero(share >= least - SLACK)
            ok = ok[(keys[x[ok]] == keys[y[ok]]).argmax(1) == band[x[ok]]]
            return x[ok], y[ok], share[ok]

        def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return shares(bag, order[x], order[y]) >= least - 1e-12

        unite_groups(cut, forest, near, alike)
        node = table.column("b").combine_chunks()
        links = order[np.array(forest.links, np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([node.take(pa.array(links[:, k])) for k in (0, 1)], ["u", "v"])

    ensure(members.sparkSession)
    return members.select("key", "block", "band", "b", "sketch", "bag", *(["side", "root"] if cross else [])).repartition(parts, "key", "block").mapInArrow(trimmed(work), "u binary, v binary")


def classes(docs: DataFrame, least: float, staged: Staged) -> DataFrame:
    """For every row of docs: doc_id, a hash `h` of its text, the `root` of its class and the least doc_id `class_id` there.

    A row without words or doc_id has no root.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = staged.put(sketch(docs), "sketches")
    some = found.where("doc_id IS NOT NULL AND keys IS NOT NULL")
    nodes = staged.put(some.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.min_by(F.struct("keys", "registers"), "doc_id").alias("s")).select("node", "at.doc_id", "at.h", "s.keys", "s.registers"), "nodes")
    each = nodes.select(F.posexplode("keys").alias("band", "key"), F.col("node").alias("b"))
    many = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = staged.put(dealt(each.join(many, "key")), "met")
    wanted = nodes.join(met.select("b").distinct(), F.col("b") == F.col("node"), "left_semi").select("node", "doc_id", "h")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def bag_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), packed(batch.column("text")).cast(pa.binary())], ["b", "bag"])

    texts = docs.withColumn("h", F.xxhash64("text")).join(wanted.hint("shuffle_hash"), ["doc_id", "h"]).select("node", "text")
    bag = staged.put(map_batches(texts, bag_of, "b binary, bag binary").dropDuplicates(["b"]), "bags")
    sketches = nodes.select(F.col("node").alias("b"), F.col("registers").alias("sketch"))
    length, rows = bag.agg(F.avg(F.octet_length("bag"))).first()[0] or 0, met.count()
    linked = lambda df, n: verified(df.join(sketches, "b").join(bag, "b"), least, tasks(df, n, 400 + length))
    links = staged.put(linked(met, rows), "links")
    staged.release()
    roots = components(links, staged)
    if met.where("mix = 1").head(1):  # there are large buckets
        rest = staged.put(across(met, roots, "band"), "across")
        rows = rest.count()
        if rows:
            others = staged.put(linked(rest, rows), "links_across")
            staged.release()
            roots = components(links.unionByName(others), staged)
    own = nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", "doc_id", F.coalesce("v", "node").alias("root"))
    of = own.join(own.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("node", "root", "class_id")
    rows = found.select("doc_id", "h", F.when(F.col("keys").isNotNull() & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = rows.join(of, "node", "left").select("doc_id", "h", "root", F.coalesce("class_id", "doc_id").alias("class_id"))
    staged.drop("bags", "met")
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every row of docs.

    Documents of equal bags are one node.  Only nodes that share a band bucket with another have
    their bags dealt to their buckets, where pairs are verified; a bucket returns at most one link
    less than it has members.  Large buckets are dealt into blocks, of which every two are compared
    that links don't connect.  Classes are the connected components of verified links.  A null or
    empty text is linked to nothing and is its own class; wordless texts are linked if they are
    equal.  Rows that share a doc_id have each the class of its own text, and repeated rows the same
    one.  A null doc_id has a null class.  No rows give no rows; other columns don't matter.
    """
    return classes(docs, least, Staged(docs.sparkSession)).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of each class, with all columns of docs: that of the least doc_id, and of these the one whose text has the least hash.

    Rows whose text is null or empty are classes of their own, but repeats of a (doc_id, text) go.
    Rows without a doc_id stay.  The columns are those of docs.
    """
    from pyspark.sql import Window as W

    staged = Staged(docs.sparkSession)
    h, nth, id_ = (free(c, docs.columns) for c in ("h", "nth", "id"))
    found = classes(docs.select("doc_id", "text"), least, staged).where("class_id = doc_id")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("at")).select("at.doc_id", "at.h")
    keep = first.unionByName(found.where("root IS NULL").select("doc_id", "h").distinct())
    keep = staged.put(keep.select(F.col("doc_id").alias(id_), F.col("h").alias(h + "_")), "keep")
    own = docs.where("doc_id IS NOT NULL").withColumn(h, F.xxhash64(F.col("text").cast("string")))
    left = own.join(keep, (F.col("doc_id") == F.col(id_)) & (F.col(h) == F.col(h + "_")), "left_semi")
    left = left.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", h).orderBy("doc_id", h))).where(F.col(nth) == 1)
    return left.drop(h, nth).unionByName(docs.where("doc_id IS NULL"))
