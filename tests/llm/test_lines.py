"""Fuzzy line deduplication against brute force, its parts by themselves, and odd rows."""

import hashlib
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from textsieve.llm import buckets, entry, linededup
from textsieve.llm import textbytes as tb
from textsieve.llm.editsim import Compared

SCHEMA = "doc_id long, text string, Going string, N_removed string"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def removed(spark, rows, **options):
    out = linededup.dedup_lines(table(spark, rows), **options)
    assert out.columns == ["doc_id", "text", "Going", "N_removed", "n_removed_"]
    return {r.doc_id: r.n_removed_ for r in out.collect()}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def word_hash(word):
    buf, off = tb.buffers(pa.array([word], pa.binary()))
    return int(tb.hash_spans(buf, off[:-1], off[1:], tb.LOWER)[0])


def simhash(words):
    """In plain Python, from hashes of single words."""
    features = [f for w in words for f in ([w] if len(w) <= 24 else [w[k : k + 9] for k in range(len(w) - 8)])]
    weighed = [(word_hash(f), max(0, min(len(f), 30) - 3) ** 2 + 1) for f in features]
    return sum(1 << k for k in range(64) if sum((2 * (h >> k & 1) - 1) * w for h, w in weighed) > 0)


def expected(rows, similarity=0.9):
    """Removed line numbers of each doc_id, over all pairs of lines."""
    seen = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n")):
            if w := tuple(WORD.findall(line.encode().lower())):
                seen.setdefault(w, []).append((i, n))
    keys = list(seen)
    plain = [b" ".join(k).decode() for k in keys]
    sims = [simhash(k) for k in keys]
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(keys)), 2):
        if find(i) != find(j) and (sims[i] ^ sims[j]).bit_count() <= linededup.BITS:
            longest = max(len(plain[i]), len(plain[j]))
            if levenshtein(plain[i], plain[j]) <= int((1 - similarity) * longest + 1e-9):
                up[find(i)] = find(j)
    groups, gone = {}, {}
    for k, key in enumerate(keys):
        groups.setdefault(find(k), set()).update(seen[key])
    for places in groups.values():
        for i, n in sorted(places)[1:]:
            gone.setdefault(i, set()).add(n)
    return gone


def varied(rng):
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    pool += [p + "s" for p in pool[:10]] + [p.replace("a", "é", 1) for p in pool[:10]]
    rows = [(i, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "a b\r\n" + pool[0].upper() + "\n"), (53, pool[24] * 3), (54, pool[24] * 3 + " x"), (None, pool[0]), (7, rows[7][1])]


@pytest.mark.parametrize("block", [2048, 0.01])
def test_lines_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(buckets, "BLOCK", block)  # of 0.01: each bucket is dealt into hundreds of blocks
    rows = varied(random.Random(11))
    gone = expected(rows)
    got = {}
    for r in linededup.dedup_lines(table(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        want = t if i is None or t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))
        assert got[i].text == want and got[i].n_removed_ == len(gone.get(i, ()))
    assert linededup.dedup_lines(table(spark, rows).where("false")).count() == 0


def test_lines_that_are_near_to_one_other_line_only(spark):
    """Forty equal words and six that differ from pair to pair: all SimHashes are near, but only pairs are alike."""
    rng = random.Random(1)
    rows = []
    for k in range(12):
        own = ["".join(rng.choice("bcdfghjk") for _ in range(12)) for _ in range(6)]
        rows += [(2 * k, " ".join(["common"] * 40 + own)), (2 * k + 1, " ".join(["common"] * 40 + own[:-1] + [own[-1][:-2] + "zz"]))]
    assert removed(spark, rows) == {i: i % 2 for i, _ in rows}


def test_lines_of_one_bucket_are_all_compared(spark):
    rng = random.Random(12)
    old, new = (["".join(rng.choice("bcdfgh") for _ in range(8)) for _ in range(120)] for _ in range(2))
    chain = [" ".join(["wordword" * 3] * 150 + new[:k] + old[k:]) for k in range(120)]  # all of one SimHash, each like a few others only
    rows = list(enumerate(rng.sample(chain, len(chain))))
    assert removed(spark, rows, similarity=0.99) == {i: int(i > 0) for i in range(120)}


def test_short_lines_and_scripts_without_spaces(spark, tmp_path):
    paragraph = "".join(chr(0x4E00 + random.Random(3).randrange(3000) + k) for k in range(160))
    near = paragraph[:-3] + "山に登"
    rows = [(1, f"Read more\n{paragraph}\n***"), (2, f"{near}\nread  MORE!\nkeep"), (3, "***\n\nRead more\nOne 4 words line"), (4, "one 4 WORDS line\nkeep")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.op5_line_dedup(spark, str(tmp_path)).collect()}
    kept = {1: rows[0][1], 2: "keep", 3: "***\n\nOne 4 words line", 4: ""}
    assert all(got[i].kept_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items())
    assert [got[i].n_removed for i in kept] == [0, 2, 1, 2]
    assert [got[i].n_lines for i in kept] == [3, 3, 4, 2]
    assert expected(rows) == {2: {0, 1}, 3: {2}, 4: {0, 1}}


def test_long_lines_are_compared_by_characters(spark):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("bcdfgh") for _ in range(n))
    short = [word(7) for _ in range(60)]
    typos = [w[:-1] + "x" for w in short]  # a sixth of the words, 2 % of the characters
    far = [[word(24) for _ in range(80)] for _ in range(2)]  # 7 % of the words, most characters
    rows = [(1, "common " * 300 + " ".join(short)), (2, "common " * 300 + " ".join(typos)), (3, "ab " * 1000 + " ".join(far[0])), (4, "ab " * 1000 + " ".join(far[1]))]
    assert removed(spark, rows) == {1: 0, 2: 1, 3: 0, 4: 0}


def test_a_document_of_many_lines(spark):
    rows = [(1, "\n".join(f"line {k % 50_000} of {k % 50_000}" for k in range(100_000))), (2, "x\n" * 60_000)]
    table(spark, rows[:1]).count()
    began = time.time()
    got = removed(spark, rows, similarity=0.999)
    assert got == {1: 50_000, 2: 59_999}
    assert time.time() - began < 120


def test_edit_distances():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 14))) for _ in range(60)] + [None]
    texts += [t[:k] + "b" + t[k + rng.randint(0, 2) :] for t in texts[:60] for k in [rng.randint(0, 8)]]
    compared = Compared(pa.array(texts))
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    true = np.array([levenshtein(texts[i] or "", texts[j] or "") for i, j in zip(x, y)])
    room = np.array([rng.randint(0, 6) for _ in x])
    assert (compared.within(x, y, room) == (true <= room)).all()
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    edited = list(long)
    for k in rng.sample(range(len(long)), 40):
        edited[k] = "z"
    compared = Compared(pa.array([long, "".join(edited)]))
    assert compared.within(np.array([0, 0]), np.array([1, 1]), np.array([39, 40])).tolist() == [False, True]


@pytest.mark.parametrize("n", [1, 10**9, 10**12])
def test_tables_find_all_pairs_once(n):
    rng = random.Random(n)
    tables = linededup.Tables(n)
    sims = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    flips = np.array([sum(1 << k for k in rng.sample(range(64), rng.randint(1, linededup.BITS))) for _ in sims], np.uint64)
    other = sims ^ flips
    at = tables.meets(sims ^ other)
    met = np.array([tables.keys(t, sims) == tables.keys(t, other) for t in range(len(tables.chosen))])
    assert met.any(0).all() and (met.argmax(0) == at).all()
    assert tables.meets(np.zeros(1, np.uint64)).tolist() == [-1]


def test_only_long_words_and_wanted_lines_are_hashed_again(monkeypatch):
    """Bytes hashed beside a batch's own words are those of its long words, and hashes are the same as word by word."""
    import numpy as np
    import pyarrow as pa

    from textsieve.llm import linededup as ld
    from textsieve.llm import textbytes as tb

    texts = pa.array(["short words only\n\nand Here", None, "a " + "x" * 40 + " b\n" + "日本語" * 20 + "\n", "\n", ""])
    buf, off = tb.buffers(texts)
    text, number, a, b, starts, ends = ld.lines(buf, off)
    assert list(zip(text.tolist(), number.tolist())) == [(0, 0), (0, 2), (2, 0), (2, 1)]
    h = tb.hash_spans(buf, starts, ends, tb.LOWER)
    seen, plain = [], tb.hash_spans
    monkeypatch.setattr(tb, "hash_spans", lambda data, *more: seen.append(len(data)) or plain(data, *more))
    sim = ld.simhashes(buf, starts, ends, h, a, b)
    assert seen == [40 + 180]
    for k in range(len(a)):
        at = [(i, j) for s, e in zip(starts[a[k] : b[k]], ends[a[k] : b[k]]) for i, j in ([(s, e)] if e - s <= ld.LONG_WORD else [(x, x + ld.PIECE) for x in range(s, e - ld.PIECE + 1)])]
        s, e = (np.array(v) for v in zip(*at))
        assert sim[k] == ld.majority(plain(buf, s, e, tb.LOWER), ld.weights(e - s), np.array([len(at)]))[0]
