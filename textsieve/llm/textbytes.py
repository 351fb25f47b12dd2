"""Vectorised reading of whole texts as UTF-8 bytes.

Every operator of this subpackage that looks at words, lines or n-grams works on
the bytes of an Arrow string column, without a Python object per word.  Work is
done in blocks of ``BLOCK`` bytes, so that the temporary memory does not grow
with the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16
SLICE = 4 << 20

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _M1
    h ^= h >> _U(27)
    h *= _M2
    h ^= h >> _U(31)
    return h


def _tables() -> tuple[np.ndarray, np.ndarray]:
    raw = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    low = raw.copy()
    low[65:91] = raw[97:123]
    return raw, low


RAW, LOWER = _tables()
_BASE = 0x9E3779B97F4A7C55 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * _U(pow(base, done, 1 << 64))
        done += take
    return out


_P, _Q = _powers(_BASE, BLOCK + 1), _powers(_INV, BLOCK + 1)


def byte_class(*chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for c in chars:
        table[list(c)] = True
    return table


#: Lower-cased letters, digits and whatever is not ASCII.
ALNUM = byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
#: All but ASCII white space.
INK = ~byte_class(b" ", range(9, 14))
NOT_NEWLINE = ~byte_class(b"\n")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (one more for the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE):
    """Cuts a batch into runs of rows with about `most` bytes of text each; a longer text stands alone."""
    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class, cut at the ends of texts: starts, ends, and the first run of each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    mask = table[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    begin = off[:-1]
    before[begin[begin < n]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    last = off[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = RAW) -> np.ndarray:
    """64-bit hashes of buf[starts[i]:ends[i]]; starts and ends ascend."""
    at_start, at_end = np.zeros(len(starts), _U), np.zeros(len(ends), _U)
    carry = _U(0)
    sums = np.empty(BLOCK + 1, _U)
    for b in range(0, len(buf), BLOCK):
        part = table[buf[b : b + BLOCK]]
        m = len(part)
        part *= _P[:m]
        if b:
            part *= _U(pow(_BASE, b, 1 << 64))
        sums[0] = 0
        np.cumsum(part, out=sums[1 : m + 1])
        sums[: m + 1] += carry
        i, j = np.searchsorted(starts, [b, b + m])
        at_start[i:j] = sums[starts[i:j] - b]
        i, j = np.searchsorted(ends, [b, b + m], "right")
        at_end[i:j] = sums[ends[i:j] - b]
        carry = sums[m]
    h = at_end - at_start
    block, rest = np.divmod(starts, BLOCK)
    h *= _Q[rest]
    if len(buf) > BLOCK:
        h *= _powers(pow(_INV, BLOCK, 1 << 64), len(buf) // BLOCK + 1)[block]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first[i] to first[i] + size[i] - 1 of all i in a row."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbouring values; the last n-1 places are left out."""
    if len(h) < n:
        return np.zeros(0, _U)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _U(0x9FB21C651E98DF25)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def owner(first: np.ndarray) -> np.ndarray:
    """From the first item of each text to the text of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_text(where: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the ascending places `where` lie in each text."""
    return np.diff(np.searchsorted(where, off))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` over the items of each text."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal elsewhere, and which are the first of their value to count."""
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice, first = np.zeros(len(key), bool), np.ones(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first[order[1:][same]] = False
    return twice, first


def windows(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks the items from which n items of one text follow."""
    ok = np.zeros(max(0, total - n + 1), bool)
    ok[:] = True
    own = owner(first)
    return ok & (own[: len(ok)] == own[n - 1 : n - 1 + len(ok)])


def letters(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter."""
    buf, off = buffers(texts)
    plain = per_text(np.flatnonzero(byte_class(range(65, 91), range(97, 123))[buf]), off) > 0
    if not plain.all():
        for i in np.flatnonzero(~plain & (np.diff(off) > 0)):
            plain[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode(errors="replace")))
    return plain


def grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the n-byte substrings of each text, and the first of each text."""
    if len(buf) < n:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    m = len(buf) - n + 1
    code = np.full(m, n * 0x01000193, np.uint32)
    for k in range(n):
        code ^= buf[k : k + m]
        code *= np.uint32(0x01000193)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    inside = np.ones(m, bool)
    for k in range(1, n):
        cut = off[1:-1] - k
        inside[cut[(cut >= 0) & (cut < m)]] = False
    where = np.flatnonzero(inside)
    return code[where], np.searchsorted(where, off)
