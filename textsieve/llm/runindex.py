"""Removal of repeated passages by a run-length compressed index.

Every string of `size` bytes has an anchor, the substring of `GRAM` bytes with the least
hash in it, so equal strings have equal anchors at equal places.  Strings with one anchor
are the windows of a segment around it.  Segments whose anchor several documents have are
dealt out by anchor; each task sorts its distinct segments' suffixes by their first
`size` bytes, and then by the least document that has the segment, keeps their
Burrows-Wheeler transform as runs, with the text place of the first row of each string as
samples, and streams the segments' windows over it from right to left.  The first
row of a window's interval is its earliest document.

Texts are kept in groups by a hash of doc_id, in a bucketed table, so that they are dealt
out once; a group sends each anchor and each distinct segment once, however many of its
documents have it, so what a task receives of one passage is bounded by the number of groups.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm import textbytes as tb
from textsieve.llm.staging import Staged, partitions
from textsieve.shipping import ensure

GRAM = 16
#: Bytes of segments in one index, as far as anchors aren't cut apart.
INDEX_BYTES = 400_000
#: Bytes of texts in a group.
GROUP_BYTES = 6_000_000
#: Buckets that Spark allows for a table, by its default.
MOST_BUCKETS = 100_000
_U = np.uint64
_LOW = _U((1 << 20) - 1)


def anchors(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Place of each anchor, the first and the last window start that it stands for, and its hash."""
    n, width = len(buf), size - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []
    block = 1 << 18
    power, inverse = tb._powers(tb._BASE, block + size), tb._powers(tb._INV, block + size)
    for b in range(0, max(0, n - size + 1), block):
        part = buf[b : min(n, b + block + size - 1)]
        m = len(part)
        sums = np.zeros(m + 1, _U)
        np.cumsum(tb.RAW[part] * power[:m], out=sums[1:])
        h = tb.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: m - GRAM + 1])
        least = (h & ~_LOW) | np.arange(len(h), dtype=_U)
        have = 1
        while have < width:  # least of windows of doubling width
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        starts = np.arange(b, b + m - size + 1)
        place = (least & _LOW).astype(np.int64)
        i, j = np.searchsorted(off, [b, starts[-1]], "right")
        last = np.repeat(off[i : j + 1], np.diff(np.concatenate([[b], off[i:j], [starts[-1] + 1]])))  # where each start's text ends
        place[starts + size > last] = -1
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        p = place[cut[:-1]]
        ok = p >= 0
        out.append((p[ok] + b, cut[:-1][ok] + b, cut[1:][ok] - 1 + b, h[p[ok]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U))
    return tuple(map(np.concatenate, zip(*out)))


def segment_hashes(buf: np.ndarray, low: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of buf[low:end] with the anchor's place in it.  low ascends and so does end but at text ends, where spans are cut apart."""
    order = np.argsort(end, kind="stable")
    h = np.empty(len(low), _U)
    a = tb.hash_spans(buf, low[order], end[order])
    h[order] = a
    return tb.mix(h + (place - low).astype(_U))


def half(h: np.ndarray) -> np.ndarray:
    return (h >> _U(32)).astype(np.uint32)


class RunIndex:
    """Run-length Burrows-Wheeler transform of segments, in the order of `size` bytes of context.

    Once built it has the runs, the first rows of the distinct strings of `size` bytes and of one
    byte less, a sample at each of the former, and one row for each segment: what it holds follows
    the number of different strings and not the length of the text.
    """

    def __init__(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int):
        """Segment k is text[begin[k]:end[k]]; earlier segments come first among equal strings."""
        n = len(text)
        self.n, self.size = n, size
        text_end = np.repeat(end, end - begin)
        # ranks by the first 5 bytes, then by twice as many; 0 stands for what is past a segment's end
        have = min(5, size - 1)
        key = np.zeros(n, _U)
        at = np.arange(n)
        for i in range(have):
            key <<= _U(8)
            inside = at[: n - i] + i < text_end[: n - i]
            key[: n - i] |= np.where(inside, text[i:], 0).astype(_U)
        rank = self._ranks(*self._sorted(key, 8 * have))
        while have < size - 1:
            before, step = rank, min(have, size - 1 - have)
            if 2 * have >= size - 1:
                break
            rank = self._ranks(*self._sorted(*self._join(before, step, text_end)))
            have += step
        bits = int(rank.max()).bit_length() + 1 if n else 1
        longer, _ = self._join(rank, size - have, text_end)  # size bytes, as 2 * have covers them
        # valid windows before shorter suffixes padded alike, then the order of segments
        whole = at + size <= text_end
        suffix, same = self._sorted((longer << _U(1)) | (~whole).astype(_U), 2 * bits + 1)
        same >>= _U(1)
        self.strings = self._starts(same)  # first rows of strings of `size` bytes, and of one byte less
        shorter, _ = self._join(rank, size - 1 - have, text_end)
        self.shorter = self._starts(shorter[suffix])
        self.sample = suffix[self.strings]  # text place of the earliest row of each string
        del longer, same, shorter, rank
        # rows of the last windows of segments, from which patterns enter
        row = np.empty(n, np.int64)
        row[suffix] = at
        self.enter = row[end - size]
        start = np.zeros(n, bool)
        start[begin] = True
        bwt = np.where(start[suffix], 256, text[suffix - 1]).astype(np.int64)
        run = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        head, length = bwt[run], np.diff(np.append(run, n))
        order = np.argsort(head, kind="stable")
        head = head[order]
        self.key, self.start, self.length = head * (n + 1) + run[order], run[order], length[order]
        before = np.cumsum(self.length) - self.length
        self.by_char = np.searchsorted(head, np.arange(258))
        self.before = before - before[np.minimum(self.by_char[head], len(before) - 1)]
        # rows by their first byte; segments' last bytes by themselves come first, as empty suffixes have no rows to come from
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])[:256] + np.bincount(text[end - 1], minlength=256)

    @staticmethod
    def _starts(key: np.ndarray) -> np.ndarray:
        """First row of each interval of equal keys."""
        return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))

    @staticmethod
    def low(starts: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First rows of the intervals that rows are in."""
        return starts[np.searchsorted(starts, row, "right") - 1]

    @staticmethod
    def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of their keys, equal keys in the order of places, and the keys in that order."""
        room = max(1, (len(key) - 1).bit_length())
        if bits + room <= 64:  # sorting values is several times as fast as sorting places
            both = np.sort((key << _U(room)) | np.arange(len(key), dtype=_U))
            return (both & _U((1 << room) - 1)).astype(np.int64), both >> _U(room)
        order = np.argsort(key, kind="stable")
        return order, key[order]

    @staticmethod
    def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        return rank

    @staticmethod
    def _join(rank: np.ndarray, step: int, text_end: np.ndarray) -> tuple[np.ndarray, int]:
        """Keys by what stands at a place and `step` after it, 0 past the segment's end, and their bits."""
        bits = int(rank.max()).bit_length() + 1 if len(rank) else 1
        after = np.zeros(len(rank), _U)
        n = len(rank) - step
        if n > 0:
            inside = np.arange(step, len(rank)) < text_end[:n]
            after[:n] = np.where(inside, rank[step:] + 1, 0).astype(_U)
        return (rank.astype(_U) << _U(bits)) | after, 2 * bits

    def occurrences(self, char: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each char stands in the transform before each row."""
        i = np.searchsorted(self.key, char * (self.n + 1) + row) - 1
        ok = i >= self.by_char[char]
        i = np.maximum(i, 0)
        return np.where(ok, self.before[i] + np.minimum(row - self.start[i], self.length[i]), 0)

    def stream(self, text: np.ndarray, last: np.ndarray, count: np.ndarray):
        """From the segments' windows that start at `last`, `count` windows each from right to left: yields the
        patterns still going, the windows' starts and the text places of their earliest occurrences.

        A pattern enters at the row of its own last window; each further one is found by
        leaving out the last byte and searching backwards for the next.
        """
        live = np.arange(len(last))
        low = self.low(self.strings, self.enter)
        step = 0
        while len(live):
            yield live, last[live] - step, self.sample[np.searchsorted(self.strings, low)]
            step += 1
            on = count[live] > step
            live = live[on]
            low = self.low(self.shorter, low[on])
            char = text[last[live] - step].astype(np.int64)
            low = self.first[char] + self.occurrences(char, low)


def first_owners(text: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For each segment a bit for each of its windows (from the left) that also starts in a segment of a lesser doc.  doc ascends."""
    mask = np.zeros(len(begin), _U)
    if not len(begin):
        return mask
    index = RunIndex(text, begin, end, size)
    segment = np.repeat(np.arange(len(begin)), end - begin)
    for live, start, found in index.stream(text, end - size, end - begin - size + 1):
        older = doc[segment[found]] < doc[live]
        mask[live[older]] |= _U(1) << (start - begin[live])[older].astype(_U)
    return mask


def _pack(**columns: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blobs: list[bytes]) -> pa.Table | None:
    tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


PARTS = "to int, group int, data binary"


def _deal(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"to": pa.array([r[0] for r in rows], pa.int32()), "group": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _split(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    s = part[order]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
    return [(int(s[a]), order[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte offsets of maximal removed runs) and kept_sha256 of every row.

    A byte goes if a string of `size` bytes over it also starts in a document with a smaller doc_id.
    A null text is empty, texts shorter than `size` and rows without a doc_id keep all bytes and
    take none from others; rows that share a doc_id are one document, so they take nothing from one
    another.  doc_id must be an integer.
    """
    spark = docs.sparkSession
    ensure(spark)
    held_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(partitions(spark), -(-held_bytes // (2 * GROUP_BYTES)))
    groups, targets = 2 * buckets, buckets  # a group sends one binary to each target
    name = f"textsieve_{uuid.uuid4().hex}"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(groups)).cast("int").alias("group"))
    files = min(buckets, MOST_BUCKETS)
    own.repartition(files, "group").write.bucketBy(files, "group").saveAsTable(name)
    staged = Staged(spark)
    staged.release()
    held = spark.table(name)

    def texts(table: pa.Table):
        buf, off = tb.buffers(table.column("text"))
        id_ = table.column("doc_id").combine_chunks()
        known = id_.is_valid().to_numpy(zero_copy_only=False)
        return buf, off, id_.fill_null(0).to_numpy(), known

    def found(table: pa.Table):
        """Anchors of the group's documents that have an id: text, place, first and last window, hash."""
        buf, off, id_, known = texts(table)
        place, low, high, h = anchors(buf, off, size)
        text = np.searchsorted(off, place, "right") - 1
        ok = known[text]
        return buf, off, id_, text[ok], place[ok], low[ok], high[ok], h[ok]

    def announce(key, table):
        _, _, id_, text, _, _, _, h = found(table)
        order = np.argsort(h)
        s, d = h[order], id_[text[order]]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        if not len(cut):
            return _deal([])
        several = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
        h = s[cut]
        part = (h % _U(targets)).astype(np.int64)
        # half of a hash is enough: what looks shared and isn't is found out later
        return _deal([(p, key[0].as_py(), _pack(h=half(h[i]), several=several[i])) for p, i in _split(part)])

    def answer(key, table):
        parts = [_unpack([b]) for b in table.column("data").to_pylist()]
        h = np.concatenate([_numbers(t, "h") for t in parts])
        several = np.concatenate([t.column("several").to_numpy() for t in parts])
        group = np.repeat(table.column("group").to_numpy(), [t.num_rows for t in parts])
        order = np.argsort(h)
        s = h[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        count = np.diff(cut)
        ok = np.empty(len(h), bool)
        ok[order] = np.repeat((count > 1) | np.logical_or.reduceat(several[order], cut[:-1]), count)
        where = np.flatnonzero(ok)
        return _deal([(g, 0, _pack(h=h[where[i]])) for g, i in _split(group[where])])

    def segments(table: pa.Table, wanted: np.ndarray):
        """The documents' segments around anchors of which half of the hash is wanted."""
        buf, off, id_, text, place, low, high, h = found(table)
        at = np.minimum(np.searchsorted(wanted, half(h)), max(0, len(wanted) - 1))
        ok = wanted[at] == half(h) if len(wanted) else np.zeros(len(h), bool)
        text, place, low, high, h = text[ok], place[ok], low[ok], high[ok], h[ok]
        return buf, off, id_, text, low, high, h, segment_hashes(buf, low, high + size, place)

    def send(key, left, right):
        if not right.num_rows or not left.num_rows:
            return _deal([])
        wanted = np.sort(_numbers(_unpack(right.column("data").to_pylist()), "h"))
        buf, _, id_, text, low, high, h, s = segments(left, wanted)
        if not len(h):
            return _deal([])
        both = tb.mix(h + s * _U(0x9E3779B97F4A7C15))
        order = np.argsort(both)
        k = both[order]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        doc = np.minimum.reduceat(id_[text[order]], cut)
        one = order[cut]
        part = (h[one] % _U(targets)).astype(np.int64)
        rows = []
        for p, i in _split(part):
            a, n = low[one[i]], high[one[i]] + size - low[one[i]]
            data = buf[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            segment = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(data)])
            rows.append((p, key[0].as_py(), _pack(h=h[one[i]], s=s[one[i]], doc=doc[i], segment=segment)))
        return _deal(rows)

    def judge(key, table):
        blobs = table.column("data").to_pylist()
        parts = [_unpack([b]) for b in blobs]
        group = np.repeat(table.column("group").to_numpy(), [t.num_rows for t in parts])
        all_ = pa.concat_tables(parts).combine_chunks()
        h, s, doc = (_numbers(all_, c) for c in ("h", "s", "doc"))
        text, off = tb.buffers(all_.column("segment"))
        order = np.lexsort((doc, s, h))
        hs, ss, ds = h[order], s[order], doc[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])])
        variant = np.empty(len(h), np.int64)
        variant[order] = np.cumsum(new) - 1
        one, least = order[new], ds[new]  # a variant's first row has its least document
        anchor = np.cumsum(np.concatenate([[True], hs[new][1:] != hs[new][:-1]])) - 1
        shared = np.bincount(anchor)[anchor] > 1  # a lone variant has no other to be matched with
        mask = np.zeros(len(one), _U)
        some = np.flatnonzero(shared)
        piece = np.cumsum(off[one[some] + 1] - off[one[some]]) // INDEX_BYTES if len(some) else some
        piece = piece[np.searchsorted(anchor[some], anchor[some])]  # an anchor's segments are in one index
        for k in np.unique(piece):
            mine = some[piece == k]
            mine = mine[np.argsort(least[mine], kind="stable")]
            n = off[one[mine] + 1] - off[one[mine]]
            end = np.cumsum(n)
            data = text[np.repeat(off[one[mine]] - (end - n), n) + np.arange(int(n.sum()))]
            mask[mine] = first_owners(data, end - n, end, least[mine], size)
        return _deal([(g, 0, _pack(h=h[i], s=s[i], doc=least[variant[i]], mask=mask[variant[i]])) for g, i in _split(group)])

    report = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])

    def finish(key, left, right):
        buf, off, id_, known = texts(left)
        gone = np.zeros(len(buf) + 1, np.int32)
        if right.num_rows and left.num_rows:
            told = _unpack(right.column("data").to_pylist())
            h, s, doc, mask = (_numbers(told, c) for c in ("h", "s", "doc", "mask"))
            _, _, _, text, low, high, ah, as_ = segments(left, np.unique(half(h)))
            both, own = (tb.mix(x + y * _U(0x9E3779B97F4A7C15)) for x, y in ((h, s), (ah, as_)))
            order = np.argsort(both)
            at = order[np.minimum(np.searchsorted(both[order], own), len(both) - 1)]
            told_of = both[at] == own
            text, low, high, at = text[told_of], low[told_of], high[told_of], at[told_of]
            all_of = id_[text] > doc[at]
            np.add.at(gone, low[all_of], 1)
            np.add.at(gone, high[all_of] + size, -1)
            some = np.flatnonzero(~all_of & (id_[text] == doc[at]) & (mask[at] > 0))
            m = mask[at[some]]
            for k in range(size):
                on = some[(m >> _U(k) & _U(1)) > 0]
                if len(on):
                    np.add.at(gone, low[on] + k, 1)
                    np.add.at(gone, low[on] + k + size, -1)
        out = np.cumsum(gone[:-1]) > 0
        starts, ends, first = tb.runs(out.view(np.uint8), off, np.arange(256) == 1)
        rows = []
        removed = tb.sums(ends - starts, first)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            x, y = starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist()
            kept = hashlib.sha256()
            last = a
            for s_, e_ in zip(x, y):
                kept.update(buf[last:s_])
                last = e_
            kept.update(buf[last:b])
            rows.append((b - a, int(removed[i]), len(x), [{"start": s_ - a, "end": e_ - a} for s_, e_ in zip(x, y)], kept.hexdigest()))
        columns = list(zip(*rows)) or [()] * 5
        ids = left.column("doc_id").combine_chunks().cast(pa.int64())
        return pa.table([ids, *(pa.array(c, report.field(k + 1).type) for k, c in enumerate(columns))], schema=report)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    try:
        asked = held.groupBy("group").applyInArrow(announce, PARTS)
        told = asked.groupBy("to").applyInArrow(answer, PARTS)
        sent = held.groupBy("group").cogroup(told.groupBy("to")).applyInArrow(send, PARTS)
        judged = sent.groupBy("to").applyInArrow(judge, PARTS)
        return staged.put(held.groupBy("group").cogroup(judged.groupBy("to")).applyInArrow(finish, schema), "report")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blk AS (SELECT doc_id, b, substring(h, 2000 * b + 1, 2098) AS x FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 999) // 1000)) AS b FROM d)),
w AS (SELECT doc_id, 1000 * b + i AS p, substring(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, b, x, unnest(range(0, least(1000, len(x) // 2 - 49))) AS i FROM blk WHERE len(x) >= 100)),
m AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, p FROM w JOIN m USING (s) WHERE f < doc_id),
o AS (SELECT doc_id, p, lag(p) OVER v AS b, lead(p) OVER v AS n FROM g WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, sum(least(50, coalesce(n - p, 50))) AS n_removed, count(*) FILTER (WHERE b IS NULL OR p - b > 50) AS n_spans FROM o GROUP BY doc_id),
e AS (SELECT doc_id, p + 50 AS a FROM o WHERE n IS NULL OR n - p > 50 UNION ALL SELECT doc_id, 0 FROM d),
c AS (SELECT doc_id, p AS z FROM o WHERE b IS NULL OR p - b > 50 UNION ALL SELECT doc_id, len(h) // 2 FROM d),
a AS (SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM e),
z AS (SELECT doc_id, z, row_number() OVER (PARTITION BY doc_id ORDER BY z) AS k FROM c),
t AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM a JOIN z USING (doc_id, k) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)
"""
