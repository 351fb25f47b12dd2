"""Token ids of whole texts, in numpy, by a BPE vocabulary file whose tokenizer drops white space.

The tokenizer splits a text at white space, into runs of letters, single digits and runs
of other characters, and merges the bytes of each part by itself.  Distinct parts of a
batch are merged together, one step of all of them at a time, and remembered.  Parts
between white space with anything but ASCII and Latin-1 letters, digits and plain
punctuation go to the tokenizers library as they are, so its normalisation, contractions
and special tokens hold.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from textsieve.llm import textbytes as tb

_U = np.uint64
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, OTHER, np.uint8)
    kind[[32, *range(9, 14)]] = SPACE
    kind[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = LETTER
    kind[48:58] = DIGIT
    odd = np.zeros(256, bool)  # bytes that need the library
    odd[[*range(9), *range(14, 32), 39, 60, 124, 127, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
    return kind, odd


KIND, ODD = _classes()


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """Remembers up to `most` parts."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most, self.library = path, most, None

    def __getstate__(self):
        return {"path": self.path, "most": self.most, "library": None}

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.final = np.array([vocab[c + end] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.shift = 40
        # a table of slots by a multiplicative hash; what shares a slot is found in the sorted rest
        slot = self._slot(key)
        self.slots = np.full(1 << 64 - self.shift - 3, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]
        self.key, self.made = key, made
        lost = np.flatnonzero(self.slots[slot] != np.arange(len(key)))
        self.lost = lost[np.argsort(key[lost])]
        self.lost_key = key[self.lost]
        self.hash, self.begin, self.count = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.library = Tokenizer.from_file(self.path)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(self.shift + 3)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, or one more than all ranks."""
        key = a.astype(np.int64) * self.size + b
        none = len(self.key)
        got = self.slots[self._slot(key)]
        miss = self.key[got] != key
        if miss.any():
            i = np.flatnonzero(miss)
            at = np.minimum(np.searchsorted(self.lost_key, key[i]), len(self.lost) - 1)
            got[i] = np.where(self.lost_key[at] == key[i], self.lost[at], none)
        return got

    def merge(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts buf[start:end], one after another, and their numbers."""
        size = ends - starts
        count = np.zeros(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # parts, their ids in rows
        order = np.argsort(size, kind="stable")
        s = size[order]
        at = 0
        while at < len(order):
            longest = max(8, int(s[at] * 1.3))
            to = min(int(np.searchsorted(s, longest, "right")), at + max(1, 2_000_000 // longest))
            part = order[at:to]
            width = int(s[to - 1])
            place = np.arange(width)
            inside = place < size[part][:, None]
            text = buf[np.minimum(starts[part][:, None] + place, len(buf) - 1)]
            low = tb.FOLD[text]
            if width > 1:  # capitals of Latin-1: the byte after 0xC3
                accent = (text[:, :-1] == 0xC3) & (text[:, 1:] < 0x9F)
                low[:, 1:] += (32 * accent).astype(np.uint8)
            sym = np.where(inside, self.inner[low], 0).astype(np.int32)
            rows = np.arange(len(part))
            sym[rows, size[part] - 1] = self.final[low[rows, size[part] - 1]]
            have = size[part].copy()
            none = len(self.key)
            rank = np.full((len(part), width), none, np.int32)
            if width > 1:
                ok = inside[:, 1:]
                rank[:, :-1][ok] = self._rank(sym[:, :-1][ok], sym[:, 1:][ok])
            live = rows
            while len(live):
                best = rank[live].argmin(1)
                r = rank[live, best]
                on = r < none
                live, best, r = live[on], best[on], r[on]
                if not len(live):
                    break
                take = place + (place > best[:, None])
                take[take >= width] = width - 1
                i = live[:, None]
                new, old = sym[i, take], rank[i, np.minimum(place + (place >= best[:, None]), width - 1)]
                k = np.arange(len(live))
                new[k, best] = self.made[r]
                have[live] -= 1
                n = have[live]
                old[:, -1] = none
                old[k, best] = none
                right = np.flatnonzero(best + 1 < n)
                old[right, best[right]] = self._rank(new[right, best[right]], new[right, best[right] + 1])
                left = np.flatnonzero(best > 0)
                old[left, best[left] - 1] = self._rank(new[left, best[left] - 1], new[left, best[left]])
                sym[live], rank[live] = new, old
            count[part] = have
            done.append((part, sym))
            at = to
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for part, sym in done:
            inside = np.arange(sym.shape[1]) < count[part][:, None]
            out[(begin[part][:, None] + np.arange(sym.shape[1]))[inside]] = sym[inside]
        return out, count

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (one more for the end)."""
        if self.library is None:
            self._load()
        buf, off = tb.buffers(texts)
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        kind = KIND[buf]
        odd = ODD[buf]
        second = np.flatnonzero((buf == 0x97) | (buf == 0xB7))
        second = second[(second > 0) & (buf[second - 1] == 0xC3)]
        odd[second] = True
        odd = np.flatnonzero(odd)
        if len(odd):
            a, b, _ = tb.runs(buf, off, tb.INK)
            i = np.unique(np.searchsorted(a, odd, "right") - 1)
            a, b = a[i], b[i]
            kind[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))] = WHOLE
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edge[off] = True
        edge = np.flatnonzero(edge)
        full = kind[edge[:-1]] != SPACE
        starts, ends = edge[:-1][full], edge[1:][full]
        first = np.searchsorted(starts, off)
        whole = kind[starts] == WHOLE
        h = tb.hash_spans(buf, starts, ends, tb.LOWER)
        if whole.any():  # such a part is not lower-cased by its hash alone
            i = np.flatnonzero(whole)
            h[i] = tb.mix(tb.hash_spans(buf, starts[i], ends[i]) + _U(1))
        order = np.argsort(h)
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        uniq, example = s[new], order[new]
        back = np.empty(len(s), np.int64)
        back[order] = np.cumsum(new) - 1
        at = np.minimum(np.searchsorted(self.hash, uniq), max(0, len(self.hash) - 1))
        known = self.hash[at] == uniq if len(self.hash) else np.zeros(len(uniq), bool)
        if not known.all():
            missing = np.flatnonzero(~known)
            e = example[missing]
            odd_ones, plain = missing[whole[e]], missing[~whole[e]]
            ids, count = self.merge(buf, starts[example[plain]], ends[example[plain]])
            more = [buf[starts[x] : ends[x]].tobytes().decode("utf-8", "replace") for x in example[odd_ones]]
            extra = [np.array(x.ids, np.uint32) for k in range(0, len(more), 4096) for x in self.library.encode_batch_fast(more[k : k + 4096], add_special_tokens=False)]
            add_count = np.concatenate([count, np.array([len(x) for x in extra], np.int64)])
            add_pool = np.concatenate([ids, *extra]).astype(np.uint32)
            add_hash = np.concatenate([uniq[plain], uniq[odd_ones]])
            if len(self.hash) + len(add_hash) > self.most:  # what this batch doesn't use is forgotten
                keep = np.unique(at[known])
                c = self.count[keep].astype(np.int64)
                self.pool = self.pool[np.repeat(self.begin[keep] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
                self.hash, self.begin, self.count = self.hash[keep], np.cumsum(c) - c, c.astype(np.int32)
            begin = np.cumsum(add_count) - add_count + len(self.pool)
            self.pool = np.concatenate([self.pool, add_pool])
            hash_ = np.concatenate([self.hash, add_hash])
            order = np.argsort(hash_, kind="stable")
            self.hash, self.begin, self.count = hash_[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, add_count.astype(np.int32)])[order]
            at = np.searchsorted(self.hash, uniq)
        count = self.count[at][back].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        return self.pool[np.repeat(self.begin[at][back] - total[:-1], count) + np.arange(int(total[-1]))], total[first]
