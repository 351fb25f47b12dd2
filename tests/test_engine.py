"""Column functions, SQL functions, index, joins and streaming on Spark."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textsieve.functions import columns as c
from textsieve.functions import trigrams as t
from textsieve.operators import joins, search
from textsieve.sources.index import TrigramIndex, estimate
from textsieve.sources.tables import load_csv
from textsieve.streaming.ingest import ingest

WORDS = ["foobar", "fooar", "foovbar", "foopar", "unrelated", "hello world", "colour is color", "café crème", "", None, "zzz nothing here", "100% sure_thing"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "id long, body string").cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_scalars(spark):
    row = spark.createDataFrame([("colour", "boxtr", "zzz", None, "foxtrot", "faxtrat")], "a string, b string, z string, n string, f string, g string").select(
        c.amatch("a", "color", 1).alias("m"), c.amatch_cost("b", "fox", 2).alias("b"), c.amatch_cost("z", "fox", 2).alias("z"), c.amatch("n", "x", 1).alias("n"), c.amatch("z", "x", 0).alias("no"), c.similarity("f", "fox", 2).alias("one"), F.round(c.similarity("g", "fox", 2), 3).alias("some"), c.similarity("z", "fox", 0).alias("none"), c.similarity("n", "fox", 2).alias("null"), c.amatch("a", "color", 2, 1, 1, 1).alias("w"), c.amatch("z", "", 0).alias("empty"),
    ).first()
    assert tuple(row) == (True, 1, None, None, False, 1.0, 0.857, 0.0, None, True, True)
    with pytest.raises(ValueError):
        c.amatch("a", "x", -1)
    with pytest.raises(c.rx.RegexError):
        c.amatch("a", "(", 1)


def test_column_patterns(spark):
    df = spark.createDataFrame([("hello", "helo", 1), ("abc", "x+", 0), (None, "a", 1), ("a", None, 1)], "a string, p string, i int")
    assert [r[0] for r in df.select(c.amatch_cost(F.col("a"), F.col("p"), 1)).collect()] == [1, 1, None, None]
    assert [r[0] for r in df.select(c.amatch(F.col("a"), F.col("p"), 1)).collect()] == [True, True, None, None]
    assert df.select(c.amatch_detail("a", F.col("p"), 1).alias("d")).where("d IS NOT NULL").count() >= 1


def test_trigrams(spark):
    pairs = [("foo", "foobar", 0.375), ("hello", "hallo", 1 / 3), ("abc", "xyz", 0.0), ("cat", "category", 0.3), ("aaa", "aaa", 1.0), ("", "", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, s double")
    got = df.select("s", t.trgm_similarity(F.col("a"), F.col("b")).alias("x"), t.trgm_sim_op(F.col("a"), F.col("b")).alias("op"), t.trgm_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r.x == pytest.approx(r.s, abs=1e-6) and r.op == (r.s >= 0.3) and r.d == pytest.approx(1 - r.s, abs=1e-6)


@pytest.mark.parametrize("op,right", [("%~~", "foobar@1"), ("%~~", "foobar@2"), ("%~~", "fo+bar"), ("~~", "%oo%a_"), ("~~*", "%FOO%"), ("~", "^fo"), ("~*", "^FO"), ("=", "foobar"), ("!~~", "%o%"), ("!~", "o"), ("%~~", "crème@1"), ("~~", "100\\% s%")])
def test_index_gives_what_a_scan_gives(spark, docs, tmp_path, op, right):
    index = TrigramIndex.create(docs, f"file://{tmp_path}/i", "id", "body")
    spark.conf.set("textsieve.index_below", "2")
    try:
        assert ids(search.search(docs, "body", op, right, index)) == ids(search.search(docs, "body", op, right))
    finally:
        spark.conf.unset("textsieve.index_below")


def test_index_life(spark, docs, tmp_path):
    root = f"file://{tmp_path}/i"
    spark.conf.set("textsieve.index_below", "2")
    try:
        index = TrigramIndex.create(docs.where("id % 2 = 0"), root, "id", "body")
        for k in (1, 3, 5, 7, 9, 11):
            index.append(docs.where(f"id = {k}"))
        want = ids(search.search(docs, "body", "%~~", "foobar@1"))
        assert ids(search.search(docs, "body", "%~~", "foobar@1", TrigramIndex(spark, root))) == want
        assert index.run_catalog().count() == 7
        index.compact()
        assert index.run_catalog().count() < 7
        index.delete(docs.where("id = 0").select("id"))
        left = docs.where("id <> 0")
        assert ids(search.search(docs, "body", "%~~", "foobar@1", index)) == [i for i in want if i]
        index.compact(all_runs=True)
        assert index.run_catalog().count() == 1 and not index.catalogue.deleted and not index.vacuum() and index.vacuum(0)
        assert ids(search.search(left, "body", "~~", "%foo%", index)) == ids(search.search(left, "body", "~~", "%foo%"))
        assert index.format_status().count() == 1 and index.min_format_version() == 1 and index.histogram().count() >= 2 and index.small_files() >= 1
        index.upgrade()
        with pytest.raises(FileExistsError):
            TrigramIndex.create(docs, root, "id", "body")
        with pytest.raises(ValueError):
            TrigramIndex.create(docs, root + "2", "id", "body", most_emissions=3)
        index.drop()
        with pytest.raises(FileNotFoundError):
            TrigramIndex(spark, root)
    finally:
        spark.conf.unset("textsieve.index_below")
    assert estimate(docs, "body").first().est_rows == len(WORDS)
    assert TrigramIndex.create(docs.where("false"), root + "4", "id", "body").n_rows() == 0


@pytest.fixture
def any_index(spark):
    """Indexes are used however much they narrow."""
    spark.conf.set("textsieve.index_below", "2")
    yield
    spark.conf.unset("textsieve.index_below")


def uses(index, df, *args, **options):
    plan = search.search(df, *args, index=index, **options)._jdf.queryExecution().toString()
    return "LeftSemi" in plan


def test_partial_index(spark, docs, tmp_path, any_index):
    index = TrigramIndex.create(docs, f"file://{tmp_path}/i", "id", "body", where="id > 1 AND id < 9")
    everything = ids(search.search(docs, "body", "%~~", "foobar@1"))
    assert ids(search.search(docs, "body", "%~~", "foobar@1", index)) == everything == [0, 1, 2, 3] and not uses(index, docs, "body", "%~~", "foobar@1")
    some = {"where": "id < 9 and body is not null AND id  >  1"}
    assert uses(index, docs, "body", "%~~", "foobar@1", **some)
    assert ids(search.search(docs, "body", "%~~", "foobar@1", index, **some)) == [2, 3]
    for other in ("id > 1", "id > 1 AND id < 9 OR id = 0", "id > 1 AND (id < 9 OR id = 0)", "id > 1 AND id < 90"):
        assert not uses(index, docs, "body", "%~~", "foobar@1", where=other)


def test_expression_index(spark, tmp_path, any_index):
    rows = spark.createDataFrame([(0, "foobar"), (1, "nothing"), (2, "A FOOBAR")], "id long, body string")
    for k, text in enumerate(("lower(body)", F.lower("body"))):
        index = TrigramIndex.create(rows.where("id < 2"), f"file://{tmp_path}/{k}", "id", text)
        index.append(rows.where("id = 2"), text)
        assert ids(search.search(rows, "body", "~~", "%FOOBAR%", index)) == [2] and not uses(index, rows, "body", "~~", "%FOOBAR%")
        assert ids(search.search(rows, text, "~~", "%foobar%", index)) == [0, 2] and uses(index, rows, text, "~~", "%foobar%")
        with pytest.raises(ValueError):
            index.append(rows, "body")


def test_index_that_lacks_rare_grams(spark, docs, tmp_path, any_index):
    rare = TrigramIndex.create(docs.where("id <> 9"), f"file://{tmp_path}/i", "id", "body", min_frequency=2)
    rare.append(docs.where("id = 9"))
    rare.append(spark.createDataFrame([(20, "zzz unrelated")], docs.schema))
    more = docs.unionByName(spark.createDataFrame([(20, "zzz unrelated")], docs.schema))
    for _ in range(2):
        assert ids(search.search(more, "body", "~~", "%unrelated%", rare)) == [4, 20]
        assert ids(search.search(more, "body", "~~", "%foo%", rare)) == [0, 1, 2, 3]
        rare.compact(all_runs=True)


def test_index_through_changes(spark, tmp_path, any_index):
    """Rows that are added, deleted, changed and added again, and merges: a search through the index is a scan."""
    rng = random.Random(4)
    schema = "id long, body string"
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 9)))
    now = {k: word() for k in range(12)}
    index = TrigramIndex.create(spark.createDataFrame(list(now.items()), schema), f"file://{tmp_path}/i", "id", "body", min_frequency=2)
    for step in range(9):
        keys = rng.sample(range(14), 3)
        match rng.choice(["update", "delete", "append", "compact", "merge"]):
            case "update":
                now |= (new := {k: word() for k in keys})
                index.update(spark.createDataFrame(list(new.items()), schema))
            case "delete":
                index.delete(spark.createDataFrame([(k,) for k in keys], "id long"))
                now = {k: v for k, v in now.items() if k not in keys}
            case "append":
                now |= (new := {100 + 3 * step + j: word() for j in range(3)})
                TrigramIndex(spark, index.root).append(spark.createDataFrame(list(new.items()), schema))  # another writer
            case "compact":
                index.compact(levels=1)
            case "merge":
                index.compact(all_runs=True)
        rows = spark.createDataFrame(list(now.items()), schema)
        index = TrigramIndex(spark, index.root)
        for right in ("%abc%", "%bca%", f"%{word()}%"):
            assert ids(search.search(rows, "body", "~~", right, index)) == ids(search.search(rows, "body", "~~", right)), (step, right)
    assert index.rebuild(rows).n_rows == len(now) and len(index.catalogue.runs) == 1 and not index.catalogue.deleted


def test_two_writers(spark, docs, tmp_path):
    first = TrigramIndex.create(docs.where("id < 4"), f"file://{tmp_path}/i", "id", "body")
    second = TrigramIndex(spark, first.root)
    first.append(docs.where("id = 4"))
    second.append(docs.where("id = 5"))
    assert [r.run_id for r in TrigramIndex(spark, first.root).catalogue.runs] == [1, 2, 3]


def test_ranking_keeps_columns(docs):
    own = docs.withColumn("DIST", F.lit("mine")).withColumn("Rank", F.lit("too"))
    got = search.nearest(own, "body", "foobar@1", "id", 1)
    assert got.columns == [*own.columns, "dist_"] and got.first().DIST == "mine"
    got = search.nearest_by_group(own.withColumn("g", F.lit(1)), "body", "foobar@1", "g", "id", 1)
    assert got.columns[-2:] == ["dist_", "rank_"] and got.first().Rank == "too"


def test_ranking(docs):
    got = [(r.id, r.dist) for r in search.nearest(docs, "body", "foobar@2", "id", 4).collect()]
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1)]
    top = search.nearest_by_group(docs.withColumn("g", F.col("id") % 2), "body", "foobar@2", "g", "id", 1)
    assert sorted((r.g, r.id) for r in top.collect()) == [(0, 0), (1, 1)]


def test_joins(spark, docs):
    words = spark.createDataFrame([(1, "foobar"), (2, "helo"), (3, "a"), (4, None), (5, "n.t")], "w long, word string")
    got = {(r.id, r.w, r.dist) for r in joins.fuzzy_join(docs, words, "body", "word", 1, "id", "w").collect()}
    want = set()
    for i, b in enumerate(WORDS):
        for w, x in ((1, "foobar"), (2, "helo"), (3, "a"), (5, "n.t")):
            if b is not None and (d := c.nfa.compiled(x.replace(".", "\\.")).costs([b], 1)[0]) is not None:
                want.add((i, w, d))
    assert got == want
    pairs = joins.similarity_join(docs, docs.select(F.col("id").alias("j"), F.col("body").alias("b")), "body", "b", "id", "j", 0.3)
    every = docs.join(docs.select(F.col("id").alias("j"), F.col("body").alias("b")), t.trgm_sim_op(F.col("body"), F.col("b"), 0.3))
    assert {(r.id, r.j) for r in pairs.collect()} == {(r.id, r.j) for r in every.select("id", "j").collect()}


def test_sql(spark, docs):
    c.register(spark)
    docs.createOrReplaceTempView("t")
    assert spark.sql("SELECT id FROM t WHERE amatch(body, 'foobar', 1)").count() == 4
    assert spark.sql("SELECT d.cost FROM t, LATERAL amatch_detail(body, 'foobar', 1) d").count() == 4
    assert spark.sql("SELECT text_similarity('foxtrot', 'fox', 2), amatch_cost('boxtr', 'fox', 2), word_similarity('cat', 'category'), amatch_weighted('colour', 'color', 2, 1, 1, 1)").first()[:2] == (1.0, 1)


def test_settings(spark):
    df = spark.createDataFrame([("foo", "foobar")], "a string, b string")
    similar = lambda: df.select(t.trgm_sim_op(F.col("a"), F.col("b"))).first()[0]
    assert similar()
    spark.sql("SET textsieve.similarity_threshold = 0.4")
    spark.sql("SET textsieve.match_timeout_ms = 20")
    try:
        assert not similar()
        with pytest.raises(Exception, match="MatchTimeout"):
            spark.createDataFrame([("abc" * 20_000,)], "a string").select(c.amatch_detail("a", "(a|b|c)*d(a|b)*e", 3)).collect()
    finally:
        for name in ("similarity_threshold", "match_timeout_ms"):
            spark.conf.unset(f"textsieve.{name}")


def test_sql_functions(spark, docs):
    c.register(spark)
    docs.createOrReplaceTempView("t")
    one = lambda sql: spark.sql(f"SELECT {sql}").first()[0]
    assert one("trgm_similarity('foo', 'foobar')") == pytest.approx(0.375) and one("trgm_similarity('', '')") == 0 and one("trgm_similarity(NULL, 'a')") is None
    assert one("trgm_distance('foo', 'foobar')") == pytest.approx(0.625) and one("trgm_sim_op('foo', 'foobar')") and not one("trgm_sim_op('foo', 'foobar', 0.4)")
    assert one("word_distance('cat', 'category') + word_similarity('cat', 'category')") == pytest.approx(1) and one("word_sim_op('cat', 'a cat sat')")
    assert one("strict_word_distance('cat', 'a cat sat')") == 0 and one("strict_word_sim_op('cat', 'a cat sat', 0.9D)")
    assert one("pattern_in('abc@2:1,2,3')").asDict() == {"pattern": "abc", "max_cost": 2, "cost_ins": 1, "cost_del": 2, "cost_subst": 3} and one("pattern_match(NULL, 'a@1')") is None
    assert one("parse_debug('a|b')") == c.parse_debug("a|b") and one("extract_debug('abc', 0)") == c.extract_debug("abc", 0) and one("textsieve_version()") == c.version()
    assert [r.id for r in spark.sql("SELECT id, pattern_distance(body, 'foobar@1') AS d FROM t WHERE pattern_match(body, 'foobar@1') ORDER BY d, id").collect()] == [0, 1, 2, 3]
    assert one("pattern_similarity('foxtrot', 'fox@2')") == 1.0
    with pytest.raises(Exception, match="bad pattern"):
        one("pattern_match('a', 'abc@x')")
    odd = spark.createDataFrame([("abc@1",), (None,), ("a",)], "p string")
    assert [r[0] and r[0].max_cost for r in odd.select(c.pattern_in(F.col("p"))).collect()] == [1, None, 0]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"one, two"\n2,three\n')
    assert [r.body for r in load_csv(spark, f"file://{tmp_path}/a.csv").orderBy("id").collect()] == ["one, two", "three"]


def test_stream(spark, docs, tmp_path):
    root = f"file://{tmp_path}/i"
    TrigramIndex.create(docs.where("false"), root, "id", "body")
    docs.where("id < 6").write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(f"file://{tmp_path}/in")
        ingest(stream, root, f"file://{tmp_path}/mark").awaitTermination()
        docs.where("id >= 6").write.mode("append").parquet(f"file://{tmp_path}/in")
    index = TrigramIndex(spark, root)
    assert index.n_rows() == len(WORDS) and len(index.catalogue.runs) >= 2


def test_entry(spark, small):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "dist"] and df.count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) >= 50


def test_prefilter_stays_in_the_jvm(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = docs.where(c.amatch("text", "thanedble", 0)).select("doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "StringContains(text,thanedble)" in plan


@pytest.mark.parametrize("name", ["amatch_detail", "amatch_detail_cost", "amatch_weighted"])
def test_costly_matches_are_dealt_out(spark, small, name):
    """A compact table is one task to read, but its rows are matched by all cores."""
    assert "RoundRobinPartitioning" in __spark_entry__.queries()[name](spark, small)._jdf.queryExecution().toString()


def test_similar_classes(spark):
    """Copies are one class, every link between different texts is there, and pairs of classes and members are the pairs of rows."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["Supplier#%09d" % i for i in range(60)]
    texts += ["Copy", "copy", "copy!"] * 20 + [None, "", "-"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, body string")
    other = rows.select(F.col("id").alias("j"), F.col("body").alias("b"))
    for least in (0.15, 0.5, 0.8, 1.0):
        every = rows.join(other, t.trgm_sim_op(F.col("body"), F.col("b"), least)).select("id", "j", t.trgm_similarity(F.col("body"), F.col("b")).alias("s")).collect()
        assert sorted(every) == sorted(joins.similarity_join(rows, other, "body", "b", "id", "j", least).collect())
        found = joins.similarity_classes(rows, other, "body", "b", "id", "j", least)
        member = found.where("similarity = 1").select(F.col("j").alias("of"), F.col("id").alias("j"))
        assert sorted((r.id, r.j, r.s) for r in every) == sorted(found.join(member, found["j"] == member["of"]).select("id", member["j"], "similarity").collect())
        copies = found.where("class_id = 120 AND j = 120").collect()
        assert len(copies) == 60 and {r.n_right for r in copies} == {60}


ODD = [(1, "Copy"), (2, "copy"), (3, "copy!"), (4, None), (None, "copy"), (5, ""), (6, "-"), (7, "ab ba"), (8, "ba ab"), (8, "ba  ab"), (9, "Supplier#000000111"), (10, "Supplier#000001111"), (11, "Supplier#000001112"), (9, "Supplier#000000111")]


def test_similarity_join_tells_rows(spark, tmp_path):
    """All pairs of rows are told: copies, different names of equal trigrams, rows that share a key or have none."""
    rows = spark.createDataFrame(ODD, "s_suppkey long, s_name string")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = __spark_entry__.queries()["similarity_join"](spark, str(tmp_path))
    assert got.columns == ["s_suppkey", "other", "similarity"]
    other = rows.select(F.col("s_suppkey").alias("other"), F.col("s_name").alias("o_name"))
    names = F.col("s_name"), F.col("o_name")
    want = rows.join(other, t.trgm_sim_op(*names, 0.8)).select("s_suppkey", "other", F.round(t.trgm_similarity(*names).cast("double"), 5).alias("similarity"))
    assert Counter(got.collect()) == Counter(want.collect())
    found = {(r.s_suppkey, r.other) for r in got.collect()}
    assert {(9, 10), (10, 9), (2, 3), (7, 8), (None, 1), (None, None)} <= found


def test_pairs_of_copies_are_dealt_out(spark):
    """The pairs of one class are made by many tasks, in blocks."""
    copies = spark.range(1200).select("id", F.lit("one and the same").alias("body"))
    pairs = joins.similarity_join(copies, copies.select(F.col("id").alias("j"), F.col("body").alias("b")), "body", "b", "id", "j", 0.8)
    tasks = pairs.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum(F.col("id") * 1200 + F.col("j"))).collect()
    n = 1200 * 1200
    assert sum(r[1] for r in tasks) == n and sum(r[2] for r in tasks) == n * (n - 1) // 2
    assert max(r[1] for r in tasks) < n / 3


def test_class_members_have_the_right_rows(spark):
    left = spark.createDataFrame([(1, "Copy"), (2, "other words")], "id long, body string")
    right = spark.createDataFrame([(11, "copy"), (12, "copy!"), (13, "words, other"), (14, "none")], "j long, b string")
    found = joins.similarity_classes(left, right, "body", "b", "id", "j", 0.8)
    members = joins.class_members(right, "b", "j").withColumnsRenamed({"j": "row", "class_id": "j"})
    told = found.join(members, "j").select("id", "row", "similarity").collect()
    assert sorted(told) == sorted(joins.similarity_join(left, right, "body", "b", "id", "j", 0.8).collect())
    assert sorted((r.id, r.row) for r in told) == [(1, 11), (1, 12), (2, 13)]
