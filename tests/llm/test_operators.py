"""Operators against brute force on small tables, and on odd rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textsieve.llm import buckets, components, decontam, langid, minhash, packing, quality, revisit, rules, runindex, staging, textbytes, toxicity, wordbpe
from textsieve.llm.staging import Staged

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, hits string, score string, label string, bucket int"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "été", "42", "don't", "Über", "x***"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 120)).replace(". ", ".\n")) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "###"), (44, rows[3][1]), (45, rows[3][1] + " extra"), (46, "long " * 30_000), (47, rows[5][1]), (48, "###"), (47, rows[5][1])]
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashes_tell_words_apart():
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [None, "x" * 200_000]
    buf, off = textbytes.buffers(pa.array(rows))
    starts, ends, _ = textbytes.runs(buf, off, textbytes.INK)
    words = [w for r in rows for w in (r or "").split()]
    seen = {}
    for w, h in zip(words, textbytes.hash_spans(buf, starts, ends)):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), wordbpe.Encoder(path, most=500)
    rng = random.Random(2)
    parts = ["a", "B", "é", "É", "Ÿ", "×", "1", "23", "'s", "'", "<|endoftext|>", "!", "??", " ", "\n", "\x1c", "　", "İ", "ß", "你", "😀", "é", "Σ", "|", "I'LL", "\x85", "٣", "hello", "World"]
    for _ in range(20):
        rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None]
        ids, off = own(pa.array(rows))
        for k, r in enumerate(rows):
            assert ids[off[k] : off[k + 1]].tolist() == library.encode(r or "", add_special_tokens=False).ids


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    room = 64
    rows = packing.pack(table(spark, texts), path, room).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), room):
            part = ids[k : k + room]
            want[i, k // room, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= room
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in rows) // room) + 1
    assert packing.pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_all(seed):
    rng = np.random.default_rng(seed)
    room = 50
    count = np.concatenate([[0], rng.integers(0, 30, room) * (rng.random(room) < 0.6)])
    layout = packing.plan(count, room)
    length = np.repeat(np.arange(room + 1), count)
    rank = np.concatenate([np.arange(c) for c in count]).astype(np.int64)
    sequence, offset = layout.place(length, rank)
    used = Counter()
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        for k in range(o, o + n):
            used[s, k] += 1
    assert not used or max(used.values()) == 1 and max(k for _, k in used) < room
    assert len(set(sequence.tolist())) == layout.sequences


def bag(text):
    w = WORD.findall((text or "").encode().lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter([text] if text else [])


def test_signatures_are_unbiased():
    a = " ".join(["x y z u v w"] * 40 + [f"w{i}" for i in range(100)])
    b = " ".join(["x y z u v w"] * 25 + [f"w{i}" for i in range(120)])
    s = minhash.signatures(*minhash.bags(pa.array([a, b])), 2, 4096)
    exact = minhash.overlap(pa.array([a]), pa.array([b]))[0]
    x, y = bag(a), bag(b)
    assert exact == pytest.approx(sum((x & y).values()) / sum((x | y).values()))
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicates(spark, texts):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    rows = list(texts)
    for k in range(40):  # a group of near copies, some of which aren't near one another
        mine = list(base)
        for _ in range(rng.randint(0, 12)):
            mine[rng.randrange(200)] = rng.choice(words)
        rows.append((1000 + k, " ".join(mine)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    ids = {i: bag(t) for i, t in rows}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and ids[i] and 5 * sum((ids[i] & ids[j]).values()) >= 4 * sum((ids[i] | ids[j]).values()):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert got == {i: find(i) for i in ids}
    kept = minhash.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.near_duplicates(table(spark, [(None, "a b c"), (None, None)])).where("class_id IS NULL").count() == 2


def test_rows_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (7, c), (7, c), (8, None), (8, ""), (8, ""), (None, a), (None, a), (9, a + " end")]
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == [(-1, -1), (-1, -1), (3, 3), (5, 3), (5, 5), (7, 7), (7, 7), (8, 8), (8, 8), (8, 8), (9, 3)]
    kept = sorted((r.doc_id or -1, r.text or "") for r in minhash.one_of_each(table(spark, rows)).collect())
    assert kept == sorted([(-1, a), (-1, a), (3, a), (5, b), (7, c), (8, ""), (8, "")])


def near_pairs(rng, n, words):
    """n pairs of texts of similarity 0.8 or a little more: they differ in words at one end."""
    new = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    for _ in range(n):
        base = new(words)
        yield " ".join(base), " ".join(base[: -(words // 10)] + new(words // 10))


def test_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 0.01)  # every bucket is dealt into hundreds of blocks
    rows = list(enumerate(t for pair in near_pairs(random.Random(15), 40, 60) for t in pair))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_pairs_that_agree_in_bytes_of_an_earlier_band(spark):
    """Bands whose registers have equal bytes, but differ, are no earlier meeting."""
    pairs = list(near_pairs(random.Random(16), 4000, 60))
    flat = pa.array([t for pair in pairs for t in pair])
    bits = minhash.signatures(*minhash.bags(flat), len(flat)).view(np.uint64)
    same = lambda v: (v[::2] == v[1::2]).reshape(len(pairs), minhash.BANDS, minhash.ROWS).all(2)
    true, small = same(bits), same(textbytes.mix(bits).astype(np.uint8))
    chosen = np.flatnonzero(true.any(1) & (small.argmax(1) < true.argmax(1)))
    assert len(chosen)
    rows = list(enumerate(t for k in chosen for t in pairs[k]))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 201 + k) for k in range(30)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long"), Staged(spark)).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long"), Staged(spark)).count() == 0


def test_written_tables_can_be_cleared(spark):
    staged = Staged(spark)
    staged.put(spark.range(3), "some")
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged.root)
    there = lambda: folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    assert there()
    staging.clear(spark)
    assert not there()


def test_language(spark):
    rng = random.Random(9)
    words = {"aa": ["bla", "blu", "blo"], "bb": ["zig", "zag", "zog"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang) for i in range(120) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(200, None, "aa"), (201, "", None), (202, "123 !", "bb"), (203, "ZIG zag", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = docs.where("false")
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_language_kernel():
    """Against sets of n-grams and a solution of ridge regression in plain numpy."""
    rng = random.Random(21)
    texts = ["".join(rng.choice(["ab ", "cd", "É", "x", "YZ "]) for _ in range(rng.randint(2, 40))) for _ in range(30)] + ["a", ""]
    langs = [rng.choice("pq") for _ in texts]
    model = langid.train(texts, langs, landmarks=6, ridge=1e-2)

    def grams(t):
        b = t.encode()
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
        return {b[k : k + n] for n in langid.LENGTHS for k in range(len(b) - n + 1)}

    def kernel(x, y):
        return np.array([[len(grams(s) & grams(t)) / max(1, len(grams(s)) * len(grams(t))) ** 0.5 for t in y] for s in x])

    marks = [t for lang in "pq" for t in [t for t, own in zip(texts, langs) if own == lang][:6]]
    k_nm, k_mm = kernel(texts, marks), kernel(marks, marks)
    assert np.abs(model.kernel(pa.array(texts)) - k_nm).max() < 0.02  # few n-grams share a hash
    y = np.array([[1.0 if own == lang else -1.0 for lang in "pq"] for own in langs])
    w = np.array([len(langs) / (2 * langs.count(own)) for own in langs])[:, None]
    alpha = np.linalg.solve(k_nm.T @ (w * k_nm) + 1e-2 * len(texts) * k_mm + 1e-8 * len(texts) * np.eye(len(marks)), k_nm.T @ (w * y))
    assert np.abs(model.margins(pa.array(texts)) - k_nm @ alpha).max() < 0.1


def test_language_of_long_and_repeated_texts(spark):
    rows = [(i, "bla blu blo " * 5, "aa") for i in range(20)] + [(100 + i, "zig zag zog " * 5, "bb") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "blu bla " * 60_000), (1, "blu bla " * 60_000), (None, "zog zig"), (2, "zog zig")], "doc_id long, text string").withColumn("LANG_pred", langid.F.lit("x"))
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, langid.fit(docs)).collect()]
    assert sorted(got, key=str) == sorted([(1, "aa"), (1, "aa"), (None, "bb"), (2, "bb")], key=str)


def test_no_language_is_left_out(spark):
    rows = [(k * 100 + i, f"w{chr(97 + k // 26)}{chr(97 + k % 26)} " * 9, f"l{k}") for k in range(70) for i in range(4)]
    rows += [(9000 + i, "zzyx qqvj " * 900, "long") for i in range(6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.langs) == {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}


def test_revisits(spark):
    def record(i, url, ts, kind, etag=None, modified=None, headers=None):
        return (i, url, ts, kind, etag, modified, f"d{i}" if kind == "response" else None, headers or None, "more")

    rows = [
        record(1, "http://www.a.org:80/x/#f", 1, "response", '"e1"', None, {"etag": '"e1"', "date": "1"}),
        record(2, "https://A.org/x", 2, "revisit", 'W/"e1"', None, {"date": "2"}),
        record(3, "https://a.org/x?utm_source=q", 3, "revisit", '"e2"'),
        record(4, "https://a.org/x", 4, "response", None, "Mon"),
        record(5, "https://a.org/x", 4, "revisit", None, "Mon"),
        record(6, "https://a.org/x", 5, "revisit", None, "Tue"),
        record(7, "https://b.org/", 5, "revisit"),
        record(8, None, 5, "revisit"),
        record(9, "https://a.org/x", None, "revisit"),
        record(10, "https://a.org/x", 9, "revisit"),
        record(11, "https://a.org/x?b=2&a=1", 9, "response"),
        record(12, "https://a.org/x?a=1&b=2", 10, "revisit", None, None, {"content-length": "0"}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, chunk string")
    got = {r.record_id: r for r in revisit.resolve(df).collect()}
    assert [(i, got[i].verdict, got[i].refers_to) for i in sorted(got)] == [
        (1, "full", None), (2, "resolved", 1), (3, "mismatch", None), (4, "full", None), (5, "resolved", 4), (6, "mismatch", None),
        (7, "unresolved", None), (8, "unresolved", None), (9, "unresolved", None), (10, "resolved", 4), (11, "full", None), (12, "resolved", 11),
    ]
    assert got[2].headers == {"etag": '"e1"', "date": "2"} and got[2].digest == "d1"
    assert "content-length" not in got[12].headers
    assert revisit.resolve(df.where("false")).count() == 0


def test_warc_files(spark, tmp_path):
    def block(kind, rid, url, body):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2020-01-0{rid}T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    import gzip

    data = block("warcinfo", 9, "", "x") + block("response", 1, "http://a/", 'HTTP/1.1 200 OK\r\nETag: "e"\r\n\r\nhello') + block("revisit", 2, "http://a/", 'HTTP/1.1 304 Not Modified\r\nETag: "e"\r\n\r\n')
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    got = {r.record_id: r for r in revisit.resolve(revisit.read_warc(spark, f"file://{tmp_path}")).collect()}
    assert got["2"].verdict == "resolved" and got["2"].digest == hashlib.sha1(b"hello").hexdigest()


def test_damaged_warc_files(spark, tmp_path):
    import gzip

    def block(kind, rid, body, size=None, status="200 OK"):
        body = f"HTTP/1.1 {status}\r\nETag: \"e\"\r\n\r\n{body}"
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-0{rid[0]}T00:00:00Z\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n{body}\r\n\r\n".encode()

    whole = block("response", "1", "hello")
    files = {"a": whole + block("revisit", "2a", "", "x1"), "b": whole + block("response", "2b", "y", 999), "c": gzip.compress(whole)[:-12], "d": b"", "e": gzip.compress(whole) + b"\x1f\x8bjunk"}
    found = {}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        found[name] = [(r.record_id, r.kind, r.status) for r in revisit.read_warc(spark, f"file://{tmp_path}/{name}").collect()]
    assert found["a"] == [("1", "response", 200), ("2a", "damaged", 200)] or found["a"] == [("1", "response", 200), ("2a", "damaged", None)]
    assert found["b"] == [("1", "response", 200), ("2b", "damaged", None)]
    assert [k for _, k, _ in found["c"]][-1] == "damaged" and found["d"] == []
    assert found["e"][0] == ("1", "response", 200) and found["e"][-1][1] == "damaged"
    (tmp_path / "s.warc").write_bytes(whole + block("response", "2", "gone", status="404 Not Found") + block("revisit", "3", "", status="304 Not Modified"))
    got = {r.record_id: r for r in revisit.resolve(revisit.read_warc(spark, f"file://{tmp_path}/s.warc")).collect()}
    assert got["3"].verdict == "resolved" and got["3"].refers_to == "1" and got["2"].verdict == "full"


def test_decontamination(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((20, 13, 15, 4, 1))] + [("none", None), (None, "w1 w2"), ("i0", "Xx yy"), ("blank", "!!")]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(20)]
    rows += [(30, "so " + items[0][1].upper() + ", end"), (31, None), (32, ""), (33, items[2][1][3:]), (34, items[3][1].replace(" ", "--")), (30, "xx YY")]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def check(size):
        hits = decontam.scan(table(spark, rows), bench, column="hits", block_bytes=size)
        name = next(c for c in hits.columns if c not in SCHEMA.replace(",", "").split())
        got = sorted((r.doc_id, r.text or "", r[name].n_words, tuple(r[name].words), tuple(r[name]["items"])) for r in hits.collect())
        want = []
        for i, t in rows:
            w = WORD.findall((t or "").encode().lower())
            hit, found = set(), set()
            for item, x in items:
                v = WORD.findall((x or "").encode().lower())
                n = min(13, len(v))
                for a in range(len(v) - n + 1) if v and item is not None else ():
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == v[a : a + n]:
                            hit.update(range(b, b + n))
                            found.add(item)
            want.append((i, t or "", len(w), tuple(sorted(hit)), tuple(sorted(found))))
        assert got == sorted(want)

    check(1 << 20)
    check(60)  # several passes
    kept = decontam.clean(table(spark, rows), bench)
    assert kept.columns == table(spark, rows).columns and 31 in {r.doc_id for r in kept.collect()}
    assert decontam.clean(table(spark, rows), bench.where("false")).count() == len(rows)
    assert decontam.report(empty(spark), bench).count() == 0


def test_repeats(spark, texts):
    rng = random.Random(17)
    base = "".join(rng.choice("abé ") for _ in range(400))
    rows = [(k, base[a : a + rng.randint(0, 150)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) + rng.choice(["", base * 2, "a" * 200])) for k in rng.sample(range(1000), 40) for a in [rng.randint(0, 300)]]
    rows += [(2001, None), (2002, ""), (2003, "\x00" * 120), (2004, "\x00" * 70 + "b" * 60), (2005, "x" * 49)]
    first = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(data[i][k : k + 50], i)
    got = {r.doc_id: r for r in runindex.remove_repeats(table(spark, rows)).collect()}
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(x), sum(gone), len(runs))
        assert [(s.start, s.end) for s in got[i].spans] == runs
        assert got[i].kept_sha256 == hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()
    assert runindex.remove_repeats(empty(spark)).count() == 0
    assert runindex.remove_repeats(table(spark, [(None, base), (5, base), (5, base)])).agg({"n_removed": "sum"}).first()[0] == 0


def labelled(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_rules(spark, texts):
    got = {}
    labels = labelled(spark, [(i, i % 2) for i in range(40)] + [(3, None)], "quality")
    docs = table(spark, texts)
    for r in rules.apply_rules(docs, rules.fit(docs, labels)).collect():
        got[r.doc_id] = r
    for i, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        before, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in before
                before.add(line)
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat), failed)
        assert not (failed and r.kept)
    assert rules.apply_rules(empty(spark), rules.fit(docs, labels.where("false"))).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3)).astype(np.float32)
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3) | (rng.random(3000) < 0.1)).astype(float)
    trees = rules.grow(x, y, {0: -1}, trees=30)
    for row in x[:50]:
        line = np.repeat(row[None], 40, 0)
        line[:, 0] = np.linspace(0, 1, 40)
        assert (np.diff(trees.margin(line)) <= 1e-9).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


def test_quality(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    held = docs.where((langid.remainder(4) == 2)).join(labels, "doc_id")
    rows = quality.classify(held, model).collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.9
    odd = table(spark, [(1, None), (2, ""), (3, "a"), (None, "b")])
    out = quality.classify(odd, model)
    assert out.columns == [*odd.columns, "score_"] and all(0 <= r.score_ <= 1 for r in out.collect())
    assert quality.classify(empty(spark), model).count() == 0
    assert quality.classify(odd, quality.fit(odd, labels.where("false"))).count() == 4


def test_average_is_of_vectors():
    rng = np.random.default_rng(0)
    model = quality.Classifier(rng.normal(size=quality.BUCKETS), 0.25)
    texts = pa.array(["one two two three", "", None, "ébc"])
    score = model.score(texts)
    for t, s in zip(texts.to_pylist(), score):
        ids = np.concatenate([b for b, _ in quality.features(*textbytes.buffers(pa.array([t], pa.string())))])
        assert s == pytest.approx(1 / (1 + np.exp(-(model.weight[ids].mean() if len(ids) else 0) - 0.25)))


def test_marginals_are_exact():
    rng = np.random.default_rng(4)
    pairs = rng.normal(size=(2, 2))
    sizes = [0, 1, 5, 64, 65, 200, 0, 130]
    emit = rng.normal(size=sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = toxicity.marginals(emit, first, pairs)
    step = np.exp(pairs)
    for a, b in zip(first, first[1:]):
        f, alpha = np.array([1.0, 0.0]), []
        for t in range(a, b):
            f = f @ step * [1, np.exp(emit[t])]
            f /= f.sum()
            alpha.append(f)
        beta = np.ones(2)
        for t in range(b - 1, a - 1, -1):
            p = alpha[t - a] * beta
            assert got[t] == pytest.approx(p[1] / p.sum(), abs=1e-9)
            beta = step @ (beta * [1, np.exp(emit[t])])
            beta /= beta.sum()


def test_pairs_by_enumeration():
    """Marginals of neighbouring states, and the likelihood's gradient, over all ways to label short texts."""
    from itertools import product

    rng = np.random.default_rng(6)
    pairs = rng.normal(size=(2, 2))
    sizes = [1, 4, 0, 6]
    emit = rng.normal(size=sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.zeros((len(emit), 2, 2))
    p = toxicity.marginals(emit, first, pairs, edges)

    def logs(pairs, a, b):
        ways = list(product((0, 1), repeat=b - a))
        return ways, np.array([sum(pairs[x, y] + y * e for x, y, e in zip((0, *way), way, emit[a:b])) for way in ways])

    for a, b in zip(first, first[1:]):
        ways, score = logs(pairs, a, b)
        share = np.exp(score) / np.exp(score).sum()
        for t in range(b - a):
            want = np.zeros((2, 2))
            for way, w in zip(ways, share):
                want[(0, *way)[t], way[t]] += w
            assert np.abs(edges[a + t] - want).max() < 1e-9 and p[a + t] == pytest.approx(want[:, 1].sum())
        # the gradient of the log likelihood of a labelling: its counts less expected ones
        if b > a:
            label = ways[len(ways) // 3]
            count = np.zeros((2, 2))
            for x, y in zip((0, *label), label):
                count[x, y] += 1
            for x, y in product((0, 1), repeat=2):
                step = np.zeros((2, 2))
                step[x, y] = 1e-6
                values = []
                for sign in (1, -1):
                    _, score = logs(pairs + sign * step, a, b)
                    values.append(score[len(ways) // 3] - np.log(np.exp(score).sum()))
                assert (values[0] - values[1]) / 2e-6 == pytest.approx((count - edges[a:b].sum(0))[x, y], abs=1e-4)


def test_toxicity(spark):
    rng = random.Random(19)
    clean = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 150))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["badthing", "nastyone", "badthings"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "!!")]
    docs = table(spark, rows)
    model = toxicity.fit(docs, labelled(spark, labels, "toxic"))
    got = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    assert np.mean([(got[i].score >= 0.5) == bool(y) for i, y in labels]) > 0.97
    text = dict(rows)
    for i, y in labels[:30]:
        for s in got[i].spans:
            assert y and any(x in text[i].encode()[s.start : s.end].decode() for x in ("bad", "nasty"))
    assert not got[900].spans and not got[901].spans
    assert toxicity.tag(empty(spark), model).count() == 0
