"""Language identification by string kernels.

The kernel of two texts is the number of n-grams, of several lengths at once, that
both have, divided by the root of the product of the numbers that each has; n-grams
are of bytes, with A-Z lower-cased, and told apart by BITS bits of their hashes.  Kernel ridge regression, one
language against the rest, is solved in the span of the landmarks (Nystrom's
method).  Batches of whole texts are scored by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textsieve.llm import textbytes as tb
from textsieve.llm.sampling import remainder
from textsieve.llm.staging import map_batches

LENGTHS = (2, 3, 4)
BITS = 18
UNKNOWN = "und"


def presence(texts: pa.Array) -> np.ndarray:
    """Which of the 2 ** BITS n-grams each text has."""
    buf, off = tb.buffers(texts)
    buf = tb.FOLD[buf]
    out = np.zeros((len(off) - 1, 1 << BITS), bool)
    for n in LENGTHS:
        code, first = tb.grams(buf, off, n)
        at = (code >> np.uint32(32 - BITS)).astype(np.int64)
        at += tb.owner(first) << BITS
        out.reshape(-1)[at] = True
    return out


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # those that a landmark has
    landmarks: np.ndarray  # grams by landmarks, divided by the root of each landmark's number of grams
    alpha: np.ndarray  # landmarks by languages

    def kernel(self, texts: pa.Array, rows: int = 128) -> np.ndarray:
        """Kernel values of texts and landmarks; a text without n-grams has 0."""
        out = []
        for k in range(0, len(texts), rows):
            x = presence(texts.slice(k, rows))
            out.append((x[:, self.grams].astype(np.float32) @ self.landmarks) / np.sqrt(np.maximum(np.count_nonzero(x, axis=1), 1))[:, None])
        return np.concatenate(out) if out else np.zeros((0, self.landmarks.shape[1]))

    def margins(self, texts: pa.Array) -> np.ndarray:
        return self.kernel(texts) @ self.alpha


def train(texts: list[str], langs: list[str], landmarks: int = 24, ridge: float = 1e-3) -> Model:
    """The first `landmarks` texts of each language are landmarks."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.zeros((1, 1), np.float32))
    y = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])
    full = presence(pa.array([texts[i] for i in chosen]))
    grams = np.flatnonzero(full.any(0))
    marks = full[:, grams].astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    model = Model(names, grams, np.ascontiguousarray(marks.T), np.zeros((len(chosen), len(names)), np.float32))
    k_nm = model.kernel(pa.array(texts)).astype(float)
    k_mm = (marks @ marks.T).astype(float)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y][:, None]
    left = k_nm.T @ (weight * k_nm) + ridge * len(y) * k_mm + 1e-8 * len(y) * np.eye(len(k_mm))
    model.alpha = np.linalg.solve(left, k_nm.T @ (weight * target)).astype(np.float32)
    return model


def fit(docs: DataFrame, most: int = 250, longest: int = 1 << 13, langs: int = 64) -> Model:
    """Learns from at most `most` documents, of at most `longest` bytes, of each language; with more than `langs` languages, from fewer of each.

    Of a language whose texts all are longer, the shortest are taken, a tenth as many.  Rows whose
    crc32(doc_id) mod 3 is 1 are held out.
    """
    size = F.octet_length("text")
    own = docs.where(F.col("lang").isNotNull() & (remainder(3) != 1) & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", size.alias("size"))
    names = own.groupBy("lang").agg((F.min("size") > longest).alias("wordy"))
    many = max(1, names.count() / langs)
    each = max(1, int(most / many))
    room = F.when(F.col("wordy"), max(1, each // 10)).otherwise(each)
    order = W.partitionBy("lang").orderBy(F.when(F.col("wordy"), F.col("size")), F.xxhash64("doc_id"), "doc_id")
    ids = own.join(F.broadcast(names), "lang").where(F.col("wordy") | (F.col("size") <= longest)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= room).select("doc_id", "rank", "size").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text", "lang", size.alias("size")).where(F.col("lang").isNotNull()).join(F.broadcast(ids), ["doc_id", "size"]).dropDuplicates(["doc_id"]).toPandas().sort_values(["rank", "doc_id"], kind="stable")
    return train(rows["text"].tolist(), rows["lang"].tolist(), landmarks=max(1, int(24 / many)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    A text without a letter, or null, is of unknown language with score 0, and so is every text
    if no language was learned.  Of languages that score alike, the first by name is taken.  Equal
    rows give equal results; columns besides doc_id and text aren't read.  No rows give no rows.
    """

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        if model.langs:
            m = model.margins(texts)
            best = m.argmax(1)
            known = tb.letters(texts)
            names = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, np.clip((m.max(1) + 1) / 2, 0, 1), 0.0)
        else:
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score.astype(float))], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
