"""Toxicity: a linear-chain conditional random field over words.

Two states (toxic, other), whose log potentials are learned weights of the word and
of its first 4, 5 and 6 bytes, and of the pair of states.  Training words are
labelled from labelled documents: in a toxic document, a word one of whose features
is much more frequent in toxic documents than in others is toxic.  Forward-backward
marginals over the whole text make the document's score and the offending offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm import textbytes as tb
from textsieve.llm.sampling import labelled, remainder
from textsieve.llm.staging import map_batches

BITS = 18
PREFIXES = (4, 5, 6)
CHUNK = 64
_U = np.uint64


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, first word of each text and a row of hashed features for each word."""
    starts, ends, first = tb.runs(buf, off, tb.ALNUM)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = tb.hash_spans(buf, starts, ends, tb.LOWER) >> _U(64 - BITS)
    code = np.zeros(len(starts), _U)
    size = ends - starts
    for k in range(max(PREFIXES)):
        inside = size > k
        code[inside] |= tb.FOLD[buf[starts[inside] + k]].astype(_U) << _U(8 * k)
        if k + 1 in PREFIXES:  # a shorter word has its own whole as prefix
            out[:, 1 + PREFIXES.index(k + 1)] = tb.mix(code + _U(k + 1 << 56)) >> _U(64 - BITS)
    return starts, ends, first, out


@dataclass
class Field:
    """weight: by feature, of being toxic; pairs[a, b]: of b after a; scale: logistic map of a document's evidence."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = -4.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.array([-2.0, 4.0, 0.0]))

    def marginals(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each word is toxic, given its whole text; own: the words' features."""
        return marginals(self.weight[own].sum(1) + self.bias, first, self.pairs)

    def evidence(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text 1, the largest marginal and the logarithm of one more than the sum of their squares."""
        words = np.diff(first)
        top = np.zeros(len(words))
        if len(p):
            top[words > 0] = np.maximum.reduceat(p, first[:-1][words > 0])
        return np.stack([np.ones(len(words)), top, np.log1p(tb.sums(p * p, first))], 1)


def marginals(emit: np.ndarray, first: np.ndarray, pairs: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over all texts at once: the probability that each word is toxic.

    Texts are cut into chunks of CHUNK words; each chunk's product of 2x2 potentials
    carries messages over it, so a long text costs as many steps as it has chunks.
    edges: gets the probability of each pair of states of a word and the one before it,
    which for a text's first word is "other".
    """
    if not len(emit):
        return np.zeros(0)
    words = np.diff(first)
    chunks = -(-words // CHUNK)
    base = np.concatenate([[0], np.cumsum(chunks)])
    n = base[-1]
    text = np.repeat(np.arange(len(words)), chunks)
    begin = first[:-1][text] + (np.arange(n) - base[text]) * CHUNK
    size = np.minimum(CHUNK, first[1:][text] - begin)
    on = np.exp(np.clip(emit, -30, 30))
    step = np.exp(pairs)
    tile = np.ones((CHUNK, n))
    place = np.arange(CHUNK)[:, None]
    real = place < size
    at = np.minimum(begin + place, len(emit) - 1)
    tile[real] = on[at][real]
    # products over chunks: carry[a, b] from state a before the chunk to b at its end
    carry = np.zeros((2, 2, n))
    carry[0, 0] = carry[1, 1] = 1
    for k in range(CHUNK):
        new0 = carry[:, 0] * step[0, 0] + carry[:, 1] * step[1, 0]
        new1 = (carry[:, 0] * step[0, 1] + carry[:, 1] * step[1, 1]) * tile[k]
        total = new0 + new1
        total = total[0] + total[1]
        live = real[k]
        carry[:, 0] = np.where(live, new0 / total, carry[:, 0])
        carry[:, 1] = np.where(live, new1 / total, carry[:, 1])
    before, after = np.empty((2, n)), np.empty((2, n))
    # the state before a text is "other"; texts with more chunks go on longer
    order = np.argsort(-chunks, kind="stable")
    sorted_chunks = chunks[order]
    f, b = np.stack([np.ones(len(words)), np.zeros(len(words))]), np.ones((2, len(words)))
    for k in range(int(chunks.max(initial=0))):
        mine = order[: np.searchsorted(-sorted_chunks, -k, "left")]
        c = base[:-1][mine] + k
        before[:, c] = f[:, mine]
        new = np.stack([(f[0, mine] * carry[0, s, c] + f[1, mine] * carry[1, s, c]) for s in (0, 1)])
        f[:, mine] = new / new.sum(0)
        c = base[1:][mine] - 1 - k
        after[:, c] = b[:, mine]
        new = np.stack([(carry[s, 0, c] * b[0, mine] + carry[s, 1, c] * b[1, mine]) for s in (0, 1)])
        b[:, mine] = new / new.sum(0)
    left = np.empty((CHUNK, 2, n))
    f = before
    for k in range(CHUNK):
        new = np.stack([f[0] * step[0, 0] + f[1] * step[1, 0], (f[0] * step[0, 1] + f[1] * step[1, 1]) * tile[k]])
        f = left[k] = new / new.sum(0)
    out = np.zeros(len(emit))
    b = after
    for k in range(CHUNK - 1, -1, -1):
        both = left[k] * b
        live = real[k]
        out[at[k][live]] = (both[1] / both.sum(0))[live]
        w1 = tile[k] * b[1]
        if edges is not None:
            f = left[k - 1] if k else before
            joint = np.stack([f[a] * step[a, c] * (w1 if c else b[0]) for a in (0, 1) for c in (0, 1)])
            edges[at[k][live]] = (joint / joint.sum(0)).T.reshape(-1, 2, 2)[live]
        new = np.stack([step[0, 0] * b[0] + step[0, 1] * w1, step[1, 0] * b[0] + step[1, 1] * w1])
        b = np.where(live, new / new.sum(0), b)
    return out


def unlike(texts: list[np.ndarray]) -> list[int]:
    """Leaves out texts that share the least or the largest hash of five neighbouring words with an earlier one, so copies don't count as evidence again."""
    seen: set[int] = set()
    out = []
    for i, own in enumerate(texts):
        h = tb.combine(own[:, 0].astype(_U), min(5, max(1, len(own))))
        ends = {int(h.min()), int(h.max())} if len(h) else set()
        if not ends & seen:
            out.append(i)
        seen |= ends
    return out


def train(texts: list[np.ndarray], toxic: np.ndarray, odds: float = 4.0, share: float = 0.004, least: int = 3, epochs: int = 8, rate: float = 0.3, seed: int = 5) -> Field:
    """texts: the words' features of each document; share, least: of toxic documents, and how many of them, that a toxic word's feature occurs in."""
    model = Field()
    mine = unlike(texts)
    texts, toxic = [texts[i] for i in mine], toxic[mine]
    if not len(toxic) or not toxic.any() or toxic.all():
        model.scale = np.array([4.0 if len(toxic) and toxic.all() else -4.0, 0.0, 0.0])
        return model
    # document frequencies of features in toxic and other documents; words and prefixes share the table
    seen = np.zeros((2, 1 << BITS))
    for own, t in zip(texts, toxic):
        seen[int(t), np.unique(own)] += 1
    rest, bad = int((toxic == 0).sum()), int((toxic == 1).sum())
    log_odds = np.log((seen[1] + 0.5) / (bad + 1)) - np.log((seen[0] + 0.5) / (rest + 1))
    marked = (log_odds >= odds) & (seen[1] >= max(least, share * bad))
    rng = np.random.default_rng(seed)
    pieces = [(own[k : k + CHUNK], (marked[own[k : k + CHUNK]].any(1) & bool(t))) for own, t in zip(texts, toxic) for k in range(0, len(own), CHUNK)]
    hot = [i for i, (_, y) in enumerate(pieces) if y.any()]
    cold = [i for i, (_, y) in enumerate(pieces) if not y.any()]
    grad_w, grad_p = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-2)
    grad_b = 1e-2
    for _ in range(epochs):
        mine = np.concatenate([hot, rng.permutation(cold)[: 4 * max(1, len(hot))]]).astype(int)
        rng.shuffle(mine)
        for k in range(0, len(mine), 256):
            own = np.concatenate([pieces[i][0] for i in mine[k : k + 256]])
            y = np.concatenate([pieces[i][1] for i in mine[k : k + 256]]).astype(float)
            size = np.array([len(pieces[i][0]) for i in mine[k : k + 256]])
            first = np.concatenate([[0], np.cumsum(size)])
            joint = np.zeros((len(own), 2, 2))
            p = marginals(model.weight[own].sum(1) + model.bias, first, model.pairs, joint)
            # gradient of the log likelihood: labels less marginals, of words and of pairs
            d = (y - p) / len(size)
            uniq, back = np.unique(own, return_inverse=True)
            g = np.bincount(back.ravel(), np.repeat(d, own.shape[1])) - 1e-4 * model.weight[uniq]
            grad_w[uniq] += g**2
            model.weight[uniq] += rate * g / np.sqrt(grad_w[uniq])
            grad_b += d.sum() ** 2
            model.bias += 0.1 * rate * d.sum() / np.sqrt(grad_b)
            was = np.concatenate([[0], y[:-1]]).astype(np.int64)
            was[first[:-1]] = 0
            count = np.bincount(2 * was + y.astype(np.int64), minlength=4).reshape(2, 2)
            gp = (count - joint.sum(0)) / len(size)
            grad_p += gp**2
            model.pairs += 0.1 * rate * gp / np.sqrt(grad_p)
    x = np.concatenate([model.evidence(model.marginals(own, np.array([0, len(own)])), np.array([0, len(own)])) for own in texts])
    scale = np.zeros(3)
    balance = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    for _ in range(50):  # Newton's method, with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + np.eye(3) * 1e-3 * len(x)
        scale += np.linalg.solve(h, x.T @ (balance * (toxic - p)) - 1e-3 * len(x) * scale)
    model.scale = scale
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, longest: int = 1 << 14) -> Field:
    """Learns labels.toxic from at most 2 * most documents of at most `longest` bytes, the first by a hash of doc_id.

    Rows whose crc32(doc_id) mod 5 is 0 are held out.
    """

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, first, own = features(*tb.buffers(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([own[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["doc_id", "label", "own"])

    sample = labelled(docs, labels, "toxic", remainder(5) != 0, most, longest)
    rows = map_batches(sample, words, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, own binary").toPandas().sort_values("doc_id", kind="stable")
    return train([np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in rows["own"]], rows["label"].to_numpy(float))


def tag(docs: DataFrame, model: Field, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and spans of every whole text.

    spans: byte offsets start, end of each maximal run of words more likely toxic than not,
    and the run's largest marginal.  A null or wordless text has no spans and the score of
    no evidence.  Equal rows give equal results; columns besides doc_id and text aren't read.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = tb.buffers(batch.column("text"))
        starts, ends, first, own = features(buf, off)
        p = model.marginals(own, first)
        score = 1 / (1 + np.exp(-np.clip(model.evidence(p, first) @ model.scale, -30, 30)))
        text = tb.owner(first)
        hit = np.flatnonzero(p >= threshold)
        out = [[] for _ in range(len(off) - 1)]
        last = -2
        for i in hit:
            mine = out[text[i]]
            a, b = int(starts[i] - off[text[i]]), int(ends[i] - off[text[i]])
            if mine and last == i - 1:
                mine[-1] = {"start": mine[-1]["start"], "end": b, "p": max(mine[-1]["p"], float(p[i]))}
            else:
                mine.append({"start": a, "end": b, "p": float(p[i])})
            last = i
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(out, spans)], ["doc_id", "score", "spans"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start: long, end: long, p: double>>")
