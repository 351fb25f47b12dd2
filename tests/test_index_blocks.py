"""Postings as blocks of slices: what is written, merged and read."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsieve.sources import index as ix
from textsieve.sources.index import TrigramIndex


@pytest.fixture
def rows(spark):
    return spark.range(5000).select(F.col("id"), F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(" of words")).alias("body"))


def stored(spark, index):
    (run,) = index.catalogue.runs
    return run, spark.read.parquet(f"{index.root}/{run.folder}")


def pairs(df):
    return sorted((r.gram, r.id) for r in df.select("gram", "id").collect())


def test_runs_merge_by_slice(spark, rows, tmp_path):
    """Runs of fewer slices are cut, keys that came twice are there once, and a gram has one block in each slice."""
    whole = TrigramIndex.create(rows, f"file://{tmp_path}/w", "id", "body")
    index = TrigramIndex.create(rows.where("id % 3 = 0"), f"file://{tmp_path}/i", "id", "body")
    index.append(rows.where("id % 3 = 1"))
    index.append(rows.where("id % 3 <> 1 AND id < 4000"))
    index.append(rows.where("id >= 4000 AND id % 3 = 2"))
    index.compact(all_runs=True)
    run, kept = stored(spark, index)
    assert run.bits == 2 and run.n_postings == whole.catalogue.runs[0].n_postings == kept.select(F.explode("ids")).count()
    assert kept.count() == kept.select("slice", "gram").distinct().count() < run.n_postings / 10
    assert pairs(index.postings()) == pairs(whole.postings())


def test_merge_leaves_hidden_rows_out(spark, rows, tmp_path):
    index = TrigramIndex.create(rows, f"file://{tmp_path}/i", "id", "body")
    index.delete(rows.where("id % 2 = 0").select("id"))
    index.append(rows.where("id = 4"))
    index.compact(all_runs=True)
    run, kept = stored(spark, index)
    ids = kept.select("slice", F.explode("ids").alias("id"))
    assert ids.where("id % 2 = 0 AND id <> 4").isEmpty() and ids.select("id").distinct().count() == 2501
    assert ids.where(F.col("slice") != ix.slice_of(F.col("id"), run.bits)).isEmpty()


def test_runs_of_the_layout_before(spark, rows, tmp_path):
    """Rows (gram, id) are read, hidden, replaced and merged like blocks."""
    index = TrigramIndex.create(rows, f"file://{tmp_path}/i", "id", "body")
    run = index.catalogue.runs[0]
    want = pairs(index.postings())
    index.postings().sortWithinPartitions("gram", "id").write.parquet(f"{index.root}/run-old")
    data = json.loads(index.files.read(f"catalogue-{index.catalogue.version}.json"))
    old = {k: v for k, v in data["runs"][0].items() if k != "bits"} | {"folder": "run-old"}
    index.files.write(f"catalogue-{index.catalogue.version + 1}.json", json.dumps(data | {"runs": [old], "version": index.catalogue.version + 1}))
    index = TrigramIndex(spark, index.root)
    assert index.catalogue.runs[0].bits is None and pairs(index.postings()) == want
    changed = rows.where("id % 3 = 0").withColumn("body", F.reverse("body"))
    index.update(changed)
    fresh = TrigramIndex.create(rows.where("id % 3 <> 0").unionByName(changed), f"file://{tmp_path}/f", "id", "body")
    assert pairs(index.postings()) == pairs(fresh.postings())
    index.compact(all_runs=True)
    assert pairs(index.postings()) == pairs(fresh.postings()) and stored(spark, index)[0].bits == 2 and run.n_rows == 5000


def test_rare_grams_are_counted_in_blocks(spark, rows, tmp_path):
    index = TrigramIndex.create(rows, f"file://{tmp_path}/i", "id", "body", min_frequency=100)
    run, kept = stored(spark, index)
    n = kept.groupBy("gram").agg(F.sum("n").alias("n"))
    every = TrigramIndex.create(rows, f"file://{tmp_path}/w", "id", "body").postings().groupBy("gram").count()
    assert not run.complete and {tuple(r) for r in n.collect()} == {tuple(r) for r in every.where("count >= 100").collect()}
    assert sum(name.startswith("run-") for name in index.files.names()) == 1


def test_building_moves_texts_only(spark, rows):
    """One exchange, of rows by slice, and tasks that grow in number with the rows."""
    texts = rows.withColumnRenamed("body", "text")
    plan = ix.blocks(texts, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan
    assert [ix.bits_for(n) for n in (0, 1, 2048, 2049, 5000, 2_500_000)] == [0, 0, 0, 1, 2, 11]
    assert [ix.by_slice(texts.withColumn("slice", F.lit(0)), bits).rdd.getNumPartitions() for bits in (0, 2, 11)] == [1, 2, 256]


def test_grams_of_many_rows_at_once():
    """Rows' grams are found by one sort, in 32 or 64 bits, as one by one: of null, short, repeated, astral and very varied texts."""
    many = "".join(chr(k) for k in range(0x20, 0xD800)) + "".join(chr(k) for k in range(0x10000, 0x24000))
    texts = ["abcabc", "", "ab", "zab", "a\x00\x00\x00b", "\U0001f600\U0001f601\U0001f602x", "日本語日本語", "abc" * 500, *(f"row {k}" for k in range(119)), many]
    for some in (texts, texts[:8], [many], ["ab", "c"], [""]):
        code = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        gram, n, row = ix.grams_of_rows(code, np.repeat(np.arange(len(some), dtype=np.uint32), [len(t) for t in some]), len(some))
        assert (np.diff(gram.astype(object)) > 0).all()
        got = list(zip(np.repeat(gram, n).tolist(), row.tolist()))
        want = {(ord(t[i]) << 42 | ord(t[i + 1]) << 21 | ord(t[i + 2]), k) for k, t in enumerate(some) for i in range(len(t) - 2)}
        assert len(got) == len(want) and set(got) == want


def test_blocks_of_odd_rows(spark):
    """Rows are gathered over groups of TOGETHER rows and CHARS characters, and a gram has one block in a slice."""
    texts = [None, "", "ab", "abc", "x" * (ix.CHARS + 5) + "abc", "ünï\U0001f600é", None, *(f"line {k} abc" for k in range(3 * ix.TOGETHER))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = ix.blocks(rows, 0).collect()
    assert len({r.gram for r in found}) == len(found) and all(r.n == len(r.ids) for r in found)
    assert sorted((r.gram, i) for r in found for i in r.ids) == sorted({(t[i : i + 3], k) for k, t in enumerate(texts) if t for i in range(len(t) - 2)})


def test_blocks_of_frequent_grams_are_not_moved(spark, rows, tmp_path):
    """Only blocks of fewer rows than asked for meet the counts; the others stream, and none of their rows is lost."""
    whole = TrigramIndex.create(rows, f"file://{tmp_path}/w", "id", "body")
    index = TrigramIndex.create(rows, f"file://{tmp_path}/i", "id", "body", min_frequency=100)
    whole.catalogue.min_frequency = 100
    plan = whole._often(whole.catalogue.runs[0])._jdf.queryExecution().sparkPlan().toString()
    assert plan.startswith("Union") and "GreaterThanOrEqual(n,100)" in plan and "LessThan(n,100)" in plan
    few, much = plan.index("LeftSemi"), plan.index("GreaterThanOrEqual(n,100)")
    assert much < few  # the first input of the union, beside the join
    n = {g: k for g, k in whole.postings().groupBy("gram").count().collect()}
    assert pairs(index.postings()) == [(g, i) for g, i in pairs(whole.postings()) if n[g] >= 100]
    blocks = spark.read.parquet(f"{index.root}/{index.catalogue.runs[0].folder}")
    assert blocks.where("n < 100").count() > 0
