"""Edit distances of many pairs of texts at once, within a bound for each pair.

For a growing number of edits, each pair keeps for every diagonal of its table how far it
gets; equal stretches are skipped by prefix hashes.  The work for a pair follows the square
of its distance and not its length, so texts of any length are compared by characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textsieve.llm import textbytes as tb

_U = np.uint64
_FAR = np.int32(-(1 << 30))
#: Diagonals and characters of the pairs that are compared together.
CELLS, CHARS = 1 << 19, 1 << 21
#: Bits that pairs of characters are counted by.
BINS = 8


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each begins; null is empty."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, _ = tb.buffers(texts)
    return np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(size)])


class Compared:
    """Texts of which pairs are compared."""

    def __init__(self, texts: pa.Array):
        self.code, self.off = characters(texts)
        self.size = np.diff(self.off)
        # counts of pairs of characters, by bits of their hashes; an edit takes away or adds two of them at most
        text = np.repeat(np.arange(len(self.size)), self.size)
        inner = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
        kind = (self.code[inner] * np.uint32(0x9E3779B1) + self.code[inner + 1] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BINS)
        self.counts = np.bincount((text[inner] << BINS) + kind.astype(np.int64), minlength=len(self.size) << BINS).reshape(-1, 1 << BINS).astype(np.int32)

        # words between blanks: an upper bound is what replacing all that differ costs
        start = np.ones(len(self.code), bool)
        start[1:] = self.code[:-1] == 32
        start[self.off[:-1][self.size > 0]] = True
        begin = np.flatnonzero(start)
        place = np.arange(len(self.code)) - np.repeat(begin, np.diff(np.append(begin, len(self.code))))
        self.word = np.add.reduceat(tb.mix(self.code.astype(_U) + place.astype(_U) * _U(0x9E3779B97F4A7C15)), begin) if len(begin) else np.zeros(0, _U)
        self.length = np.diff(np.append(begin, len(self.code)))
        self.first = np.searchsorted(begin, self.off)

    def replaced(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many edits replace each word of x[i] that differs from the one at its place in y[i]; for different numbers of words, very many."""
        out = np.full(len(x), 1 << 40)
        n = self.first[x + 1] - self.first[x]
        same = np.flatnonzero((n == self.first[y + 1] - self.first[y]) & (n > 0))
        same = same[np.argsort(n[same], kind="stable")]
        cut = np.searchsorted(np.cumsum(n[same]) // CHARS, np.arange(int(n[same].sum()) // CHARS + 2))
        for a, b in zip(cut, cut[1:]):
            mine = same[a:b]
            if len(mine):
                i, j = tb.spans(self.first[x[mine]], n[mine]), tb.spans(self.first[y[mine]], n[mine])
                cost = np.where(self.word[i] == self.word[j], 0, np.maximum(self.length[i], self.length[j]))
                out[mine] = np.add.reduceat(cost, np.cumsum(n[mine]) - n[mine])
        return out

    def within(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Whether at most room[i] edits of characters turn text x[i] into text y[i]."""
        out = self.replaced(x, y) <= room
        lower = np.zeros(len(x), np.int64)
        for k in range(0, len(x), 4096):
            d = self.counts[x[k : k + 4096]] - self.counts[y[k : k + 4096]]
            lower[k : k + 4096] = (np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1)) + 1) // 2
        lower = np.maximum(lower, np.abs(self.size[x] - self.size[y]))
        left = np.flatnonzero((lower <= room) & ~out)
        left = left[np.argsort(room[left], kind="stable")]
        at = 0
        while at < len(left):  # as many pairs as there is room for, one at least
            mine = left[at : at + 4096]
            wide = np.arange(1, len(mine) + 1) * (2 * room[mine] + 3)
            long = np.cumsum(self.size[x[mine]] + self.size[y[mine]])
            mine = mine[: max(1, int(np.count_nonzero((wide <= CELLS) & (long <= CHARS))))]
            out[mine] = self._together(x[mine], y[mine], room[mine])
            at += len(mine)
        return out

    def _together(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        size = self.size[used]
        code = self.code[tb.spans(self.off[used], size)]
        power = tb._powers(tb._BASE, int(size.max(initial=0)) + 1)
        begin = np.cumsum(size) - size
        place = np.arange(len(code)) - np.repeat(begin, size)
        sums = np.zeros(len(code) + 1, _U)
        np.cumsum(tb.mix(code.astype(_U) + _U(0x9E3779B97F4A7C15)) * power[place], out=sums[1:])
        a, b = back[: len(x)], back[len(x) :]
        n, m, a, b = size[a], size[b], begin[a], begin[b]

        def reach(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """How many characters of pair p are equal from i and j on, where the first ones are."""
            got = np.ones(len(p), np.int64)
            high = np.minimum(n[p] - i, m[p] - j) + 1  # not equal that far
            on, low, step = np.arange(len(p)), np.ones(len(p), np.int64), np.full(len(p), 2, np.int64)
            while len(on):
                test = np.minimum(low + step, high - 1)
                live = test > low
                if not live.all():
                    on, low, high, step, test = (v[live] for v in (on, low, high, step, test))
                    if not len(on):
                        break
                q, u, v = p[on], i[on], j[on]
                same = (sums[a[q] + u + test] - sums[a[q] + u]) * power[v] == (sums[b[q] + v + test] - sums[b[q] + v]) * power[u]
                low = np.where(same, test, low)
                high = np.where(same, high, test)
                step = np.where(same, step * 4, np.maximum(1, (high - low) // 2))
                got[on] = low
            return got

        code = np.append(code, np.uint32(0))
        done = np.zeros(len(x), bool)
        live = np.arange(len(x))
        widest = int(room.max())
        # how far each diagonal j - i gets, in column widest + 1 + j - i; before any edit, the first one only
        far = np.full((len(x), 2 * widest + 3), _FAR)
        now, first, last = np.zeros((len(x), 1), np.int32), 0, 0
        for edits in range(widest + 1):
            own = [v[live].astype(np.int32)[:, None] for v in (n, m, a, b)]
            if edits:
                # diagonals that so many edits reach, and from which the rest reaches the last one
                ends, rest = own[1] - own[0], widest - edits
                first, last = max(-edits, int(ends.min()) - rest), min(edits, int(ends.max()) + rest)
                f = far[:, widest + first : widest + 3 + last]
                now = np.maximum(np.maximum(f[:, 1:-1] + 1, f[:, :-2]), f[:, 2:] + 1)
            diagonal = np.arange(first, last + 1, dtype=np.int32)
            now = np.minimum(now, np.minimum(own[0], own[1] - diagonal))
            other = now + diagonal
            now[(now < 0) | (other < 0)] = _FAR
            inside = (now >= 0) & (now < own[0]) & (other < own[1])
            same = code[np.where(inside, own[2] + now, 0)] == code[np.where(inside, own[3] + other, 0)]
            row, column = np.nonzero(same & inside)
            i, j = now[row, column].astype(np.int64), other[row, column].astype(np.int64)
            now[row, column] += 1
            p = live[row]  # of most, the next characters differ already
            on = np.flatnonzero((code[a[p] + i + 1] == code[b[p] + j + 1]) & (i + 1 < n[p]) & (j + 1 < m[p]))
            now[row[on], column[on]] += (reach(p[on], i[on], j[on]) - 1).astype(np.int32)
            far[:, widest + 1 + first : widest + 2 + last] = now
            ended = far[np.arange(len(live)), np.clip(widest + 1 + (own[1] - own[0])[:, 0], 0, far.shape[1] - 1)] >= own[0][:, 0]
            done[live[ended]] = True
            stay = ~ended & (room[live] > edits)
            if not stay.all():
                live, far = live[stay], far[stay]
            if not len(live):
                break
        return done
