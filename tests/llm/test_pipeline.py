"""The pipeline and the registered queries on the smallest tables."""

import __spark_entry__
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        out.cache()
        assert out.columns == columns, name
        assert 0.5 * rows < out.count() <= rows
        assert out.select("doc_id").distinct().count() == out.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_all_ten_are_registered():
    names = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= names.keys()


def test_odd_rows_by_brute_force(spark, small, tmp_path):
    """Every stage on nulls, empty and long texts, ties, repeats and clashing columns, against plain Python on the stage's own input."""
    import random
    from collections import Counter

    from test_lines import expected
    from test_operators import WORD, bag

    from textsieve.llm import quality

    rng = random.Random(23)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).toPandas()
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    item = next(r.text for r in bench.collect() if len(WORD.findall((r.text or "").lower().encode())) > 15)
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)]
    rows += [(9001, None), (9002, ""), (9003, rows[0][1]), (9004, rows[1][1] + " end"), (9005, rows[2][1] + "\n" + item), (9006, "the same line of words\n" * 2000), (9007, rows[3][1]), (9007, rows[3][1]), (None, rows[4][1]), (9008, "***"), (9009, item.upper())]
    rng.shuffle(rows)
    schema = "doc_id long, text string, n_chars long, SCORE string, Hits string, Going string, N_removed string"
    odd = spark.createDataFrame([(i, t, len(t or ""), "a", "b", "c", "d") for i, t in rows], schema)
    labels = spark.read.parquet(f"{small}/../sf0.01/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stages[name](spark, df, str(tmp_path)).select("doc_id", "text")
    content = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    trained = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")
    model = quality.fit(odd.select("doc_id", "text"), labels)
    scored = model.score(quality.pa.array([t for _, t in rows]))
    assert content(run("quality classifier", odd)) == Counter(r for r, s in zip(rows, scored) if s >= 0.7)
    assert trained.count() > odd.count()

    gone, want = expected(rows), Counter()
    for i, t in rows:
        mine = gone.get(i, ()) if i is not None and t is not None else ()
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in mine) if mine else t
        if not mine or left.strip():
            want[i, left] += 1
    out = stages["line dedup"](spark, odd, str(tmp_path))
    assert content(out) == want and out.columns == odd.columns and out.where("SCORE = 'a' AND Hits = 'b' AND Going = 'c' AND N_removed = 'd'").count() == sum(want.values())

    keyed = sorted({r for r in rows if r[0] is not None and r[1] and bag(r[1])})
    group = list(range(len(keyed)))
    bags = [bag(t) for _, t in keyed]

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(keyed)):
        for b in range(a):
            if 5 * sum((bags[a] & bags[b]).values()) >= 4 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    kept = content(run("MinHash near-dedup", odd))
    roots = Counter(keyed[find(k)][0] for k in {find(k) for k in range(len(keyed))})
    assert Counter(i for i, t in kept.elements() if i is not None and t and bag(t)) == roots
    assert {r for r in kept if r[0] is None or not r[1]} == {r for r in rows if r[0] is None or not r[1]}

    def contaminated(text):
        words, hit = WORD.findall((text or "").lower().encode()), set()
        for n in {len(w) for w in windows}:
            hit |= {k + j for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for j in range(n)}
        return bool(hit) and 20 * len(hit) >= len(words)

    windows = set()
    for r in bench.collect():
        w = WORD.findall((r.text or "").lower().encode())
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    assert content(run("benchmark decontamination", odd)) == Counter(r for r in rows if not contaminated(r[1]))

    packed = stages["best-fit packing"](spark, odd, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in rows)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:])) for s in sequences.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0
