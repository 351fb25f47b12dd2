"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms with numpy, with monotonic constraints on chosen
statistics, and flattened to node arrays, so that a batch of documents is scored
by as many gathers as a tree is deep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm import textbytes as tb
from textsieve.llm.sampling import labelled, remainder
from textsieve.llm.staging import map_batches

SYMBOLS = tb.byte_class(b"#*$%&|<>")
UPPER, DIGIT, STOP = tb.byte_class(range(65, 91)), tb.byte_class(range(48, 58)), tb.byte_class(b".!?")
PUNCT = tb.byte_class(range(33, 48), range(58, 65), range(91, 97), range(123, 127))
TAIL = tb.byte_class(range(0x80, 0xC0))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "distinct", "log_lines", "stops"]
#: -1: the score may not rise with the statistic.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
_U = np.uint64


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the five counts of BASE (int64) and the statistics of STATS (float32)."""
    buf, off = tb.buffers(texts)
    n = len(off) - 1
    starts, ends, first = tb.runs(buf, off, tb.INK)
    words = np.diff(first)
    own = tb.owner(first)
    h = tb.hash_spans(buf, starts, ends)
    in_words = tb.sums(ends - starts, first)
    count = lambda table: tb.per_text(np.flatnonzero(table[buf]), off)
    # white space has no continuation bytes, so all of them are in words
    chars = in_words - count(TAIL)
    line_starts, line_ends, line_first = tb.runs(buf, off, tb.NOT_NEWLINE)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_own = tb.owner(line_first)[full]
    line_hash = tb.mix(tb.hash_spans(buf, line_starts, line_ends)[full] + line_own.astype(_U) * _U(0x9E3779B97F4A7C15))
    again = ~tb.repeated(line_hash)[1]
    dup_lines = np.bincount(line_own[again], minlength=n)
    lines = np.bincount(line_own, minlength=n)
    ok = np.flatnonzero(tb.windows(first, 5, len(h)))
    keys = tb.mix(tb.combine(h, 5)[ok] + own[ok].astype(_U) * _U(0x9E3779B97F4A7C15))
    twice = ok[tb.repeated(keys)[0]]
    change = np.bincount(twice, minlength=len(h) + 5) - np.bincount(twice + 5, minlength=len(h) + 5)[: len(h) + 5]
    covered = np.cumsum(change)[: len(h)] > 0
    repeat = tb.sums(covered, first)
    distinct = np.bincount(own[tb.repeated(tb.mix(h + own.astype(_U) * _U(0x9E3779B97F4A7C15)))[1]], minlength=n)
    symbols = count(SYMBOLS)
    base = np.stack([words, chars, symbols, dup_lines, repeat], 1).astype(np.int64)
    w, c, ln = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    stats = np.stack([np.log1p(words), chars / w, symbols / w, dup_lines / ln, repeat / w, count(UPPER) / c, count(DIGIT) / c, count(PUNCT) / c, distinct / w, np.log1p(lines), count(STOP) / w], 1)
    return base, stats.astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth: split statistic, bound and leaf value by node."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, b, v in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += v[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Fits log loss.  Classes weigh alike.  With no row, or rows of one class, the score is constant."""
    share = y.mean() if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), 0.0)
    if share in (0.0, 1.0) or not len(y):
        model.start = 4.0 * (2 * share - 1)
        return model
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    margin = np.zeros(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            left, right = 2 * node + 1, 2 * node + 2
            low[[left, right]], high[[left, right]] = low[node], high[node]
            best = (1e-3, None)
            for k, e in enumerate(edges):
                if not len(e) or len(mine) < 20:
                    continue
                gs, hs = (np.bincount(binned[mine, k], v[mine], len(e) + 1).cumsum() for v in (g, h))
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                vl, vr = (np.clip(a / (b + ridge), low[node], high[node]) for a, b in ((gl, hl), (gr, hr)))
                gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + gr * vr - 0.5 * (hr + ridge) * vr**2
                gain[(hl < 1) | (hr < 1)] = -np.inf
                if k in monotone:
                    gain[(vr - vl) * monotone[k] < 0] = -np.inf
                i = int(np.argmax(gain))
                if gain[i] - 0.5 * gs[-1] ** 2 / (hs[-1] + ridge) > best[0]:
                    best = (gain[i] - 0.5 * gs[-1] ** 2 / (hs[-1] + ridge), (k, i, vl[i], vr[i]))
            if best[1] is None:
                at[mine] = left
                continue
            k, i, vl, vr = best[1]
            model.feature[t, node], model.bound[t, node] = k, edges[k][i]
            if k in monotone:  # neither side may cross the middle later
                middle = (vl + vr) / 2
                if monotone[k] < 0:
                    low[left], high[right] = max(low[left], middle), min(high[right], middle)
                else:
                    high[left], low[right] = min(high[left], middle), max(low[right], middle)
            at[mine] = np.where(binned[mine, k] > i, right, left)
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        model.leaf[t] = rate * np.clip(gs / (hs + ridge), low[inner:], high[inner:])
        margin += model.leaf[t][leaf]
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, longest: int = 1 << 18) -> Trees:
    """Learns labels.quality from at most 2 * most documents of at most `longest` bytes, the first by a hash of doc_id.

    Rows whose crc32(doc_id) mod 4 is 2 are held out, as by the quality classifier.
    """

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column("text"))[1]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x.astype(float)), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = labelled(docs, labels, "quality", remainder(4) != 2, most, longest)
    rows = map_batches(sample, stats, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(STATS))
    return grow(x, rows["label"].to_numpy(float), {STATS.index(k): v for k, v in MONOTONE.items()})


def apply_rules(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts of BASE, base_failed, kept and score of every document; columns besides doc_id and text are not read.

    A null or empty text has no words, so base_failed is true.  Equal rows give equal results.
    """

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, x = statistics(batch.column("text"))
        score = model.score(x)
        failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, base.T.copy()), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    counts = ", ".join(f"{k} long" for k in BASE)
    return map_batches(docs.select("doc_id", F.col("text").cast("string")), judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {counts}, base_failed boolean, kept boolean, score double")
