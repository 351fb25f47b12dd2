"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, of its character
n-grams and of whether neighbouring words are equal; softmax of a linear map of
that average is the score.  Trained by stochastic gradient descent in numpy.  As
the map is linear, vectors are multiplied by it once, and whole texts are scored
by averaging one number for each feature.
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
from textsieve.naming import free

BUCKETS = 1 << 16
GRAMS = (3, 5)
_U = np.uint64


def features(buf: np.ndarray, off: np.ndarray):
    """Yields the bucket of each feature, in the order of the text, and the first feature of each text."""
    starts, ends, first = tb.runs(buf, off, tb.INK)
    h = tb.hash_spans(buf, starts, ends)
    yield (h >> _U(48)).astype(np.int64), first
    own = tb.owner(first)
    # repeats of the last word, of the last but one and so on are word n-grams that share a bucket by their distance
    for gap in (1, 2, 4, 8):
        same = (h[gap:] == h[:-gap]) & (own[gap:] == own[:-gap]) if len(h) > gap else np.zeros(0, bool)
        where = np.flatnonzero(same)
        yield np.full(len(where), BUCKETS - gap), np.searchsorted(where, first)
    for n in GRAMS:
        code, first = tb.grams(buf, off, n)
        yield (code >> np.uint32(16)).astype(np.int64), first


@dataclass
class Classifier:
    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        buf, off = tb.buffers(texts)
        total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for bucket, first in features(buf, off):
            total += tb.sums(self.weight[bucket], first)
            count += np.diff(first)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(ids: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, dim: int = 4, epochs: int = 12, batch: int = 32, rate: float = 0.3, seed: int = 7) -> Classifier:
    """ids, shares: the buckets of each document and their shares of its features.  Classes weigh alike."""
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(BUCKETS), 4.0 * (2 * y[0] - 1) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.01, (BUCKETS, dim))
    u, bias = rng.normal(0, 1, (dim, 2)), np.zeros(2)
    seen_v, seen_u = np.full((BUCKETS, dim), 1e-8), np.full((dim, 2), 1e-2)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            mine = order[k : k + batch]
            f, s = np.concatenate([ids[i] for i in mine]), np.concatenate([shares[i] for i in mine])
            row = np.repeat(np.arange(len(mine)), [len(ids[i]) for i in mine])
            mean = np.stack([np.bincount(row, s * v[f, d], len(mine)) for d in range(dim)], 1)
            z = mean @ u + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(mine)), y[mine].astype(int)] -= 1
            p *= weight[mine][:, None] / len(mine)
            to_u, to_mean = mean.T @ p, p @ u.T
            uniq, back = np.unique(f, return_inverse=True)
            to_v = np.stack([np.bincount(back, s * to_mean[row, d]) for d in range(dim)], 1)
            seen_v[uniq] += to_v**2
            seen_u += to_u**2
            v[uniq] -= rate * to_v / np.sqrt(seen_v[uniq])
            u -= 0.1 * rate * to_u / np.sqrt(seen_u)
            bias -= 0.1 * rate * p.sum(0)
    return Classifier(v @ (u[:, 1] - u[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000, longest: int = 1 << 15) -> Classifier:
    """Learns labels.quality from at most 2 * most documents of at most `longest` bytes, the first by a hash of doc_id.

    Rows whose crc32(doc_id) mod 4 is 2 are held out.
    """

    def shares(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text"):
            found = np.bincount(np.concatenate([b for b, _ in features(*tb.buffers(pa.array([text.as_py()])))]), minlength=1)
            ids = np.flatnonzero(found)
            out.append((ids.astype(np.int32).tobytes(), (found[ids] / max(1, found.sum())).astype(np.float32).tobytes()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["doc_id", "label", "ids", "shares"])

    sample = labelled(docs, labels, "quality", remainder(4) != 2, most, longest)
    rows = map_batches(sample, shares, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, ids binary, shares binary").toPandas().sort_values("doc_id", kind="stable")
    return train([np.frombuffer(x, np.int32) for x in rows["ids"]], [np.frombuffer(x, np.float32) for x in rows["shares"]], rows["label"].to_numpy(float))


def classify(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """All columns of docs and the score of every whole text.

    A null or empty text gets the score of no features.  Equal texts score alike, and repeated rows
    stay.  The added column comes last, with underscores until no column has its name, whatever the
    case.  No rows give no rows.
    """
    name = free(column, docs.columns)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column("text")))], [*batch.schema.names, name])

    return map_batches(docs, judge, schema)
