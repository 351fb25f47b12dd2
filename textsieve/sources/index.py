"""A persistent trigram index: postings in runs, as Parquet, with a catalogue of runs.

Layout under the index's folder: catalogue-<n>.json (the newest number counts), and a folder for
each run with postings and for each tombstone set.  Postings are blocks (slice, gram, n, ids): rows
are dealt into 2^bits slices by the hash of their key, a block has the ids of a gram in a slice, and
files are sorted by gram.  So building moves texts and not their many postings, and slices are merged
each by itself.  Files are written before the catalogue that names them, so that a job that fails leaves the index as it was; of two
writers, the later one applies its change to what the other has committed.

A tombstone hides rows of the runs that were there before it, so a key may be deleted and added
again.  A run that rare grams were left out of is incomplete: a gram that it lacks tells nothing.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.shipping import ensure

FORMAT = 1
GRAM = 3
EMISSION_SORT_BYTES, EMISSION_INDEX_BYTES = 64, 16
#: Rows of a slice, at most about, slices of a task, and postings that a task gathers.
SLICE_ROWS, SLICES_OF_TASK, MOST_POSTINGS = 2048, 8, 1 << 22
#: Rows of which grams are found together, and their characters at most; one row may have more.
TOGETHER, CHARS = 128, 1 << 19


def characters(text: Column) -> Column:
    """A text's characters as an array, in one pass; substring() would count from the start for each."""
    return F.regexp_extract_all(text, F.lit("[\\s\\S]"), F.lit(0))


def windows(chars: Column, n: int) -> Column:
    """The distinct runs of n neighbouring elements, as texts."""

    def of(c: Column) -> Column:
        last = F.size(c) - n
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
        return F.when(last >= 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # as a variable of a lambda, the characters are found once and not for each run
    return F.get(F.transform(F.array(chars), of), F.lit(0))


def grams(text: Column) -> Column:
    """The distinct runs of three characters of the whole text, case and all; null for null."""
    return F.when(text.isNotNull(), windows(characters(text), GRAM))


def strings(code: np.ndarray) -> pa.Array:
    """Rows of code points as texts."""
    n = len(code)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    ends = np.cumsum(size)
    begin = ends.reshape(code.shape) - size
    data = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for length, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        mine = size == length
        at, c = begin[mine], code[mine]
        data[at] = lead | (c >> np.uint32(6 * (length - 1)))
        for k in range(1, length):
            data[at + k] = 0x80 | (c >> np.uint32(6 * (length - 1 - k)) & np.uint32(0x3F))
    off = np.concatenate([[0], ends[code.shape[1] - 1 :: code.shape[1]]]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(data))


def slice_of(id_: Column, bits: int) -> Column:
    """The slice of a key: the first bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(id_), 64 - bits).cast("int") if bits else F.lit(0)


def bits_for(rows: int) -> int:
    """Slices for so many rows, as a power of two."""
    return max(0, (max(rows, 1) - 1) // SLICE_ROWS).bit_length()


def by_slice(rows: DataFrame, bits: int) -> DataFrame:
    """Rows with a `slice`, dealt out so that a task has whole slices, one after the other."""
    n = min(1 << bits, max(rows.sparkSession.sparkContext.defaultParallelism, (1 << bits) // SLICES_OF_TASK))
    return rows.repartitionById(n, F.floor(F.col("slice").cast("long") * n / (1 << bits)).cast("int")).sortWithinPartitions("slice")


def each_slice(batches):
    """(slice, part of a batch) of batches in the order of slices."""
    for batch in batches:
        number = batch.column("slice").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else []
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(number[a]), batch.slice(a, b - a)


def block_batch(slice_: np.ndarray, gram: pa.Array, cut: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """Blocks k of ids[cut[k]:cut[k + 1]]."""
    lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), ids)
    return pa.RecordBatch.from_arrays([pa.array(slice_.astype(np.int32)), gram, pa.array(np.diff(cut).astype(np.int32)), lists], ["slice", "gram", "n", "ids"])


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def schema_of(kind: str) -> str:
    return f"slice int, gram string, n int, ids array<{kind}>"


def grams_of_rows(code: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of characters, and whose they are: the distinct grams as numbers, how many of the n_rows rows have each, and these rows, gram by gram.

    A gram is sorted as ranks of its letters among those there are, with the row in the last bits: one
    row of up to 2^21 letters, or TOGETHER of up to CHARS characters, fit in 64 bits, and most in 32.
    """
    there = np.zeros(int(code.max(initial=0)) + 1, bool)
    there[code] = True
    letters = np.flatnonzero(there).astype(np.uint64)
    wide, low = int(len(letters) - 1).bit_length() if len(letters) else 0, int(n_rows - 1).bit_length()
    assert 3 * wide + low <= 64
    kind = np.uint32 if 3 * wide + low <= 32 else np.uint64
    rank = (np.cumsum(there) - 1).astype(kind)[code]
    key = rank[:-2].copy()
    for shift, more in ((wide, rank[1:-1]), (wide, rank[2:]), (low, row[:-2])):
        key <<= kind(shift)
        key |= more.astype(kind, copy=False)
    key = key[row[2:] == row[:-2]]
    key.sort()
    key = key[starts_of(key)]
    row, gram = (key & kind((1 << low) - 1)).astype(np.int32), key >> kind(low)
    first = starts_of(gram)
    x, y, z = (letters[gram[first] >> kind(k * wide) & kind((1 << wide) - 1)] for k in (2, 1, 0))
    return x << np.uint64(42) | y << np.uint64(21) | z, np.diff(np.append(first, len(key))), row


def blocks(rows: DataFrame, bits: int) -> DataFrame:
    """Blocks of the distinct grams of each row of (id, text); null and short texts have none."""
    ensure(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        now, ids, found, n_ids, n = None, [], [], 0, 0

        def flush():
            if not n:
                return
            grams_, counts, own = (np.concatenate(v) for v in zip(*found))
            every, back = np.unique(grams_, return_inverse=True)
            key = np.repeat(back.astype(np.uint64) << np.uint64(32), counts) | own.astype(np.uint64)
            key.sort()
            first = starts_of(key >> np.uint64(32))
            three = np.stack([every >> np.uint64(42), every >> np.uint64(21) & np.uint64(0x1FFFFF), every & np.uint64(0x1FFFFF)], 1)
            of = pa.concat_arrays(ids).take(pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            yield block_batch(np.full(len(first), now), strings(three.astype(np.uint32)), np.append(first, len(key)), of)

        for slice_, part in each_slice(batches):
            ends = np.cumsum(pc.fill_null(pc.utf8_length(part.column("text")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < part.num_rows:
                if slice_ != now or n > MOST_POSTINGS:
                    yield from flush()
                    now, ids, found, n_ids, n = slice_, [], [], 0, 0
                before = ends[at - 1] if at else 0
                some = part.slice(at, min(TOGETHER, max(1, int(np.searchsorted(ends, before + CHARS, "right")) - at)))
                text = "".join(x for x in some.column("text").to_pylist() if x is not None)
                code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                size = np.diff(ends[at : at + some.num_rows], prepend=before)
                of_gram, count, own = grams_of_rows(code, np.repeat(np.arange(some.num_rows, dtype=np.uint32), size), some.num_rows)
                found.append((of_gram, count, own + n_ids))
                n += len(own)
                ids.append(some.column("id"))
                n_ids += some.num_rows
                at += some.num_rows
        yield from flush()

    sliced = rows.withColumn("slice", slice_of(F.col("id"), bits))
    return by_slice(sliced, bits).mapInArrow(work, schema_of(kind))


def resliced(rows: DataFrame, bits: int, kind: str) -> DataFrame:
    """Blocks (run, gram, ids) cut into more slices, without moving them."""

    def work(batches):
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
            parts = np.searchsorted(ends, np.arange(0, ends[-1] + 1 if len(ends) else 0, MOST_POSTINGS // 2), "left")
            for a, b in zip(parts, np.append(parts[1:], batch.num_rows)):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                own = np.repeat(np.arange(some.num_rows), some.column("n").to_numpy())
                slice_ = some.column("to").flatten().to_numpy()
                order = np.lexsort([own, slice_])
                own, slice_ = own[order], slice_[order]
                first = starts_of(slice_.astype(np.int64) * some.num_rows + own)
                out = block_batch(slice_[first], some.column("gram").take(pa.array(own[first])), np.append(first, len(own)), some.column("ids").flatten().take(pa.array(order)))
                yield out.append_column("run", some.column("run").take(pa.array(own[first])))

    to = rows.withColumn("to", F.transform("ids", lambda i: slice_of(i, bits)))
    return to.select("run", "gram", "n", "ids", "to").mapInArrow(work, f"{schema_of(kind)}, run long")


def merged(rows: DataFrame, bits: int, kind: str) -> DataFrame:
    """Blocks with each (gram, id) once, from blocks with their `run` and, without a gram, ids that are hidden in runs before `run`."""
    ensure(rows.sparkSession)

    def work(batches):
        now, parts = None, []

        def flush():
            table = pa.Table.from_batches(parts).combine_chunks() if parts else None
            if table is None or not table.num_rows:
                return
            lists, count = table.column("ids").combine_chunks(), table.column("n").to_numpy()
            own = np.repeat(np.arange(table.num_rows), count)
            codes = lists.flatten().dictionary_encode(null_encoding="encode")
            id_, n_ids = codes.indices.to_numpy().astype(np.int64), len(codes.dictionary)
            grams_ = table.column("gram").combine_chunks().dictionary_encode()
            gram, run = grams_.indices.fill_null(-1).to_numpy()[own], table.column("run").to_numpy()[own]
            hidden = np.zeros(n_ids, np.int64)
            np.maximum.at(hidden, id_[gram < 0], run[gram < 0])
            live = (gram >= 0) & (run >= hidden[id_])
            key = np.unique(gram[live].astype(np.int64) * n_ids + id_[live])
            if len(key):
                gram, id_ = key // n_ids, key % n_ids
                first = starts_of(gram)
                yield block_batch(np.full(len(first), now), grams_.dictionary.take(pa.array(gram[first])), np.append(first, len(key)), codes.dictionary.take(pa.array(id_)))

        for slice_, part in each_slice(batches):
            if slice_ != now:
                yield from flush()
                now, parts = slice_, []
            parts.append(part)
        yield from flush()

    return by_slice(rows, bits).mapInArrow(work, schema_of(kind))


@dataclass
class Run:
    run_id: int
    level: int
    folder: str
    n_rows: int
    n_postings: int
    min_gram: str | None
    max_gram: str | None
    format_version: int = FORMAT
    complete: bool = True
    bits: int | None = None  # of slices; None: rows (gram, id), as runs were written before


@dataclass
class Tombstone:
    folder: str
    before: int  # the first run that it doesn't hold for


@dataclass
class Catalogue:
    key: str
    text: str  # what is indexed, as Spark writes the expression
    expression: str | None  # the same as SQL, if it was given so
    key_type: str
    where: str | None = None
    min_frequency: int = 1
    runs: list[Run] = field(default_factory=list)
    deleted: list[Tombstone] = field(default_factory=list)
    next_run: int = 1
    version: int = 0

    @classmethod
    def load(cls, text: str) -> Catalogue:
        data = json.loads(text)
        return cls(**{**data, "runs": [Run(**r) for r in data["runs"]], "deleted": [Tombstone(**t) for t in data["deleted"]]})


def shown(text: str | Column, columns: list[str] | None = None) -> tuple[str, Column, str | None]:
    """A column's or SQL expression's canonical form, the expression itself, and its SQL, if it was given."""
    if isinstance(text, Column):
        return text._jc.toString(), text, None
    column = F.col(f"`{text}`") if columns and text in columns else F.expr(text)
    return column._jc.toString().replace("`", ""), column, text


def conjuncts(where: str | None) -> frozenset[str]:
    """The parts that AND joins in a condition, as texts; one with other connectives or quotes is one part."""
    if where is None:
        return frozenset()
    if re.search(r"\b(or|between|case)\b|['\"`]|--|/\*|\|\|", where, re.I):
        return frozenset([where.strip()])
    parts, depth = [""], 0
    for x in re.split(r"(\s+and\s+|[()])", where, flags=re.I):
        depth += (x == "(") - (x == ")")
        if depth == 0 and x.strip().lower() == "and":
            parts.append("")
        else:
            parts[-1] += x
    return frozenset(" ".join(p.split()) for p in parts)


class Files:
    """Small files through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path("."))] if self.fs.exists(self.path(".")) else []

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), False)  # fails if another writer was faster
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self, name: str) -> list[tuple[str, int]]:
        return [(x.getPath().getName(), x.getLen()) for x in self.fs.listStatus(self.path(name))]

    def changed(self) -> list[tuple[str, float]]:
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in self.fs.listStatus(self.path("."))]

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class TrigramIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self._load()

    def _load(self) -> None:
        newest = max((int(n[10:-5]) for n in self.files.names() if n.startswith("catalogue-") and n.endswith(".json")), default=None)
        if newest is None:
            raise FileNotFoundError(f"no index in {self.root}")
        self.catalogue = Catalogue.load(self.files.read(f"catalogue-{newest}.json"))

    @classmethod
    def create(cls, df: DataFrame, root: str, key: str, text: str | Column, where: str | None = None, min_frequency: int = 1, most_emissions: int | None = None) -> TrigramIndex:
        """Indexes `text`, a column of df, an SQL expression or a Column, of rows that `where` holds for.

        Searches use the index only for the same expression, and a partial one only where they ask for
        its condition too.  most_emissions: an index that would have more postings isn't built.
        min_frequency: grams of fewer rows aren't kept; such an index still answers right, as a gram
        that a run of it doesn't have narrows nothing.
        """
        spark = df.sparkSession
        files = Files(spark, root)
        if any(n.startswith("catalogue-") for n in files.names()):
            raise FileExistsError(f"{root} has an index")
        name, _, sql = shown(text, df.columns)
        start = Catalogue(key, name, sql, df.schema[key].dataType.simpleString(), where, min_frequency)
        files.write("catalogue-0.json", json.dumps(asdict(start)))
        index = cls(spark, root)
        index.append(df, text, most_emissions=most_emissions)
        return index

    def _commit(self, change: Callable[[Catalogue], None], attempts: int = 20) -> None:
        """Applies a change to the newest catalogue; if another writer was faster, to the one that it wrote."""
        for left in reversed(range(attempts)):
            self._load()
            change(self.catalogue)
            self.catalogue.version += 1
            try:
                self.files.write(f"catalogue-{self.catalogue.version}.json", json.dumps(asdict(self.catalogue)))
                return
            except Py4JJavaError:
                if not left or f"catalogue-{self.catalogue.version}.json" not in self.files.names():
                    raise

    def _write(self, postings: DataFrame, level: int, n_rows: int, complete: bool, bits: int, in_order: bool = False) -> Run:
        folder = f"run-{uuid.uuid4().hex}"
        postings = postings.select("slice", "gram", "n", "ids")
        postings = postings if in_order else postings.sortWithinPartitions("gram")
        # small pages, of which a search reads those of its grams
        postings.write.option("parquet.page.row.count.limit", "1000").parquet(f"{self.root}/{folder}")
        n, low, high = self.spark.read.schema(schema_of(self.catalogue.key_type)).parquet(f"{self.root}/{folder}").agg(F.sum("n"), F.min("gram"), F.max("gram")).first()
        return Run(0, level, folder, n_rows, n or 0, low, high, complete=complete, bits=bits)

    def _rows(self, df: DataFrame, text: str | Column | None) -> DataFrame:
        name, value, _ = shown(self.catalogue.expression if text is None else text, df.columns) if text is not None or self.catalogue.expression else (None, None, None)
        if name != self.catalogue.text:
            raise ValueError(f"this index is of {self.catalogue.text}; give that expression")
        rows = df.where(self.catalogue.where) if self.catalogue.where else df
        return rows.select(F.col(self.catalogue.key).cast(self.catalogue.key_type).alias("id"), value.cast("string").alias("text"))

    def _build(self, df: DataFrame, text: str | Column | None, level: int, most_emissions: int | None, first: bool) -> Run:
        rows = self._rows(df, text)
        n_rows = rows.count()
        bits = bits_for(n_rows)
        postings = blocks(rows, bits)
        if most_emissions is not None and (n := postings.agg(F.sum("n")).first()[0] or 0) > most_emissions:
            raise ValueError(f"the index would have {n} postings, more than {most_emissions}")
        if not first or self.catalogue.min_frequency <= 1:
            return self._write(postings, level, n_rows, True, bits)
        whole = self._write(postings, level, n_rows, True, bits)
        run = self._write(self._often(whole), level, n_rows, False, bits, in_order=True)
        self.files.delete(whole.folder)
        return run

    def _often(self, whole: Run) -> DataFrame:
        """Blocks of a run, of grams that enough rows have, in the order of its files.

        A block of so many ids tells by itself, and streams from file to file; only those of fewer are
        moved and sorted, by more tasks for more slices.
        """
        least = self.catalogue.min_frequency
        every = self._read([whole.folder], schema_of(self.catalogue.key_type))
        often = every.groupBy("gram").agg(F.sum("n").alias("rows")).where(F.col("rows") >= least)
        few, groups = every.where(F.col("n") < least), (1 << whole.bits) // SLICES_OF_TASK
        if groups > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            few = few.repartition(groups, "gram")
        few = few.join(often.select("gram"), "gram", "left_semi").select(*every.columns).sortWithinPartitions("gram")
        return every.where(F.col("n") >= least).unionByName(few)

    @staticmethod
    def _enter(c: Catalogue, run: Run) -> None:
        run.run_id = c.next_run
        c.runs.append(run)
        c.next_run += 1

    def append(self, df: DataFrame, text: str | Column | None = None, level: int = 0, most_emissions: int | None = None) -> Run:
        """Adds rows as a run of their own; null texts have no postings."""
        run = self._build(df, text, level, most_emissions, first=not self.catalogue.runs)
        self._commit(lambda c: self._enter(c, run))
        return run

    def rebuild(self, df: DataFrame, text: str | Column | None = None) -> Run:
        """Puts a run of df's rows in the place of all runs; readers of the old ones aren't disturbed until vacuum()."""
        run = self._build(df, text, 0, None, first=True)

        def change(c: Catalogue) -> None:
            c.runs, c.deleted = [], []
            self._enter(c, run)

        self._commit(change)
        return run

    def drop(self) -> None:
        """Deletes the index with all its files."""
        self.files.delete(".")

    def delete(self, ids: DataFrame) -> None:
        """Hides rows by their keys in all runs that there are; runs added later may have the keys again."""
        folder = f"deleted-{uuid.uuid4().hex}"
        ids.select(F.col(ids.columns[0]).alias("id")).distinct().write.parquet(f"{self.root}/{folder}")
        self._commit(lambda c: c.deleted.append(Tombstone(folder, c.next_run)))

    def update(self, df: DataFrame, text: str | Column | None = None) -> Run:
        """Hides what is indexed of df's keys and adds df's rows, in one commit."""
        folder = f"deleted-{uuid.uuid4().hex}"
        df.select(F.col(self.catalogue.key).alias("id")).distinct().write.parquet(f"{self.root}/{folder}")
        run = self._build(df, text, 0, None, first=False)

        def change(c: Catalogue) -> None:
            c.deleted.append(Tombstone(folder, c.next_run))
            self._enter(c, run)

        self._commit(change)
        return run

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def _live(self, runs: list[Run], wanted: list[str] | None = None) -> DataFrame:
        """(gram, id) of runs, of the wanted grams, without rows that tombstones hide."""
        kind = self.catalogue.key_type
        by_tombs: dict[tuple[str, ...], list[tuple[str, bool]]] = {}
        for r in runs:
            if r.n_postings and (wanted is None or any(r.min_gram <= g <= r.max_gram for g in wanted)):
                by_tombs.setdefault(tuple(t.folder for t in self.catalogue.deleted if r.run_id < t.before), []).append((r.folder, r.bits is not None))
        out = None
        for tombs, folders in by_tombs.items():
            df = None
            for wide in (True, False):
                if not (some := [f for f, is_wide in folders if is_wide == wide]):
                    continue
                part = self._read(some, schema_of(kind) if wide else f"gram string, id {kind}")
                part = part.where(F.col("gram").isin(wanted)) if wanted is not None else part
                part = part.select("gram", F.explode("ids").alias("id")) if wide else part
                df = part if df is None else df.unionByName(part)
            df = df.join(self._read(list(tombs), f"id {kind}"), "id", "left_anti").select("gram", "id") if tombs else df
            out = df if out is None else out.unionByName(df)
        return self._read([], f"gram string, id {kind}") if out is None else out

    def postings(self, wanted: list[str] | None = None) -> DataFrame:
        """(gram, id) of all runs that may have one of the wanted grams, without deleted rows."""
        return self._live(self.catalogue.runs, wanted)

    def _sliced(self, runs: list[Run], bits: int) -> DataFrame:
        """(slice, run, gram, n, ids) of runs, and of the tombstones that hold for them, without a gram."""
        kind = self.catalogue.key_type
        out = None
        for r in runs:
            run = F.lit(r.run_id).cast("long").alias("run")
            if r.bits is None:
                part = self._read([r.folder], f"gram string, id {kind}").select(slice_of(F.col("id"), bits).alias("slice"), run, "gram", F.lit(1).alias("n"), F.array("id").alias("ids"))
            else:
                part = self._read([r.folder], schema_of(kind))
                if r.bits >= bits:
                    part = part.select(F.shiftright("slice", r.bits - bits).alias("slice"), run, "gram", "n", "ids")
                else:
                    part = resliced(part.select(run, "gram", "n", "ids"), bits, kind)
            out = part if out is None else out.unionByName(part)
        for t in self.catalogue.deleted:
            if any(r.run_id < t.before for r in runs):
                ids = self._read([t.folder], f"id {kind}")
                out = out.unionByName(ids.select(slice_of(F.col("id"), bits).alias("slice"), F.lit(t.before).cast("long").alias("run"), F.lit(None).cast("string").alias("gram"), F.lit(1).alias("n"), F.array("id").alias("ids")))
        return out

    def compact(self, levels: int = 4, all_runs: bool = False) -> None:
        """Merges runs: level n holds at most 2^n of them; deleted rows leave with their runs."""
        while True:
            live = self.catalogue.runs
            by_level = {lv: [r for r in live if r.level == lv] for lv in sorted({r.level for r in live})}
            if all_runs or len(live) > 2**levels:
                mine, level = live, levels
            else:
                full = next((lv for lv, rs in by_level.items() if len(rs) > 2**lv), None)
                if full is None:
                    return
                mine, level = by_level[full], full + 1
            n_rows = sum(r.n_rows for r in mine)
            bits = bits_for(n_rows)
            df = merged(self._sliced(mine, bits), bits, self.catalogue.key_type)
            for r in mine:
                if not r.complete:  # what it lacks would seem whole beside the others
                    df = df.join(self._read([r.folder], "gram string").distinct(), "gram", "left_semi")
            run = self._write(df, level, n_rows, all(r.complete for r in mine), bits)
            gone, hidden = {r.run_id for r in mine}, {t.folder for t in self.catalogue.deleted}

            def change(c: Catalogue, run=run, gone=gone, hidden=hidden) -> None:
                if not gone <= {r.run_id for r in c.runs} or {t.folder for t in c.deleted} != hidden:
                    raise RuntimeError("another writer has changed the runs that were merged; merge again")
                c.runs = [r for r in c.runs if r.run_id not in gone]
                self._enter(c, run)
                c.deleted = [t for t in c.deleted if any(r.run_id < t.before for r in c.runs)]

            self._commit(change)
            all_runs = False

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Deletes folders and catalogues that the newest catalogue doesn't name and that are older than so many seconds, which no job still reads or writes."""
        self._load()
        keep = {r.folder for r in self.catalogue.runs} | {t.folder for t in self.catalogue.deleted} | {f"catalogue-{self.catalogue.version}.json"}
        old = time.time() - older_than
        gone = [n for n, at in self.files.changed() if n.split("-")[0] in ("run", "deleted", "catalogue") and n not in keep and at <= old]
        for n in gone:
            self.files.delete(n)
        return gone

    def usable(self, grams_: list[str]) -> set[str]:
        """Grams that no incomplete run may have left out."""
        out = set(grams_)
        for r in self.catalogue.runs:
            if not r.complete and out:
                out &= {g for (g,) in self._live([r], sorted(out)).select("gram").distinct().collect()}  # as many as the pattern has
        return out

    def upgrade(self) -> None:
        """Rewrites runs of older formats; does nothing if there are none."""
        if any(r.format_version < FORMAT for r in self.catalogue.runs):
            self.compact(all_runs=True)

    def frequencies(self, wanted: list[str]) -> dict[str, int]:
        """How many rows have each of the grams of a pattern."""
        rows = self.postings(wanted).groupBy("gram").agg(F.count("*").alias("n")).collect()  # as many as the pattern has grams
        return {g: 0 for g in wanted} | {r["gram"]: r["n"] for r in rows}

    def n_rows(self) -> int:
        return sum(r.n_rows for r in self.catalogue.runs)

    def run_catalog(self) -> DataFrame:
        """Runs, the newest first."""
        rows = [(r.run_id, r.level, r.n_rows, r.n_postings, r.min_gram, r.max_gram) for r in sorted(self.catalogue.runs, key=lambda r: -r.run_id)]
        return self.spark.createDataFrame(rows, "run_id long, level int, n_tuples long, n_trigrams long, min_gram string, max_gram string")

    def format_status(self) -> DataFrame:
        """Files by format version."""
        rows = [(r.format_version, name) for r in self.catalogue.runs for name, _ in self.files.size(r.folder) if name.startswith("part-")]
        return self.spark.createDataFrame(rows, "format_version int, name string").groupBy("format_version").agg(F.count("*").alias("page_count"))

    def min_format_version(self) -> int:
        return min((r.format_version for r in self.catalogue.runs), default=FORMAT)

    def histogram(self) -> DataFrame:
        """Files and bytes by kind: postings, tombstones and catalogues."""
        rows = [("postings", n) for r in self.catalogue.runs for name, n in self.files.size(r.folder) if name.startswith("part-")]
        rows += [("tombstones", n) for t in self.catalogue.deleted for name, n in self.files.size(t.folder) if name.startswith("part-")]
        rows += [("catalogue", n) for name, n in self.files.size(".") if name == f"catalogue-{self.catalogue.version}.json"]
        total = sum(n for _, n in rows) or 1
        return self.spark.createDataFrame(rows, "kind string, size long").groupBy("kind").agg(F.count("*").alias("n_pages"), F.sum("size").alias("used_bytes"), F.round(100.0 * F.sum("size") / total, 1).alias("used_pct"))

    def small_files(self, below: int = 1 << 20) -> int:
        return sum(n < below for r in self.catalogue.runs for name, n in self.files.size(r.folder) if name.startswith("part-"))


def estimate(df: DataFrame, text: str | Column, sample: int = 2000) -> DataFrame:
    """One row: rows sampled, rows, postings expected and the MB to sort and to store them.

    The first `sample` rows in the order that df has them are looked at.
    """
    value = F.col(text) if isinstance(text, str) else text
    some = df.limit(sample).select(F.coalesce(F.size(grams(value)), F.lit(0)).alias("n")).agg(F.count("*").alias("sample_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rows = df.agg(F.count("*").alias("est_rows"))
    share = F.when(F.col("sample_rows") > 0, F.col("n") / F.col("sample_rows")).otherwise(0.0)
    emissions = F.round(share * F.col("est_rows")).cast("long")
    mb = lambda b: F.round(F.col("est_trigrams") * b / (1 << 20), 3)
    # both sides are one row
    return some.join(rows, F.lit(True)).select("sample_rows", "est_rows", emissions.alias("est_trigrams")).withColumn("est_temp_mb", mb(EMISSION_SORT_BYTES)).withColumn("est_index_mb", mb(EMISSION_INDEX_BYTES))
