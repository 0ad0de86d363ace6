"""Shared pieces: scratch tables in the cluster's shared folder, exact two-level ranks, connected components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsketch.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of a bounded size, whatever the length of the texts in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def keep(df: DataFrame, new: set[str], apply, condition) -> DataFrame:
    """Rows of apply(df) that meet the condition, with df's own columns, also those named as apply's results are."""
    own = {c: f"_own_{c}" for c in df.columns if c in new}
    return apply(df.withColumnsRenamed(own)).filter(condition).select(*[F.col(own.get(c, c)).alias(c) for c in df.columns])


class Scratch:
    """Tables written below spark.checkpoint.dir, which every executor can read.

    A written table cuts the lineage: a lost executor costs only the tasks it was running.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.at = spark, shared_folder(spark, "dnsketch"), {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        old, self.at[name] = self.at.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.at.pop(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def ranked(df: DataFrame, group: list[str], order: list, out: str, buckets: int = 64, keys: list | None = None) -> DataFrame:
    """A gapless rank from 0 within each group, without sorting a whole group in one task.

    Rows are dealt to hash buckets, ranked there, and shifted by the counts of the buckets before;
    the table of counts has (groups x buckets) rows and is joined, not collected.
    """
    b, n = f"_{out}_bucket", f"_{out}_n"
    df = df.withColumn(b, F.pmod(F.xxhash64(*(keys or order)), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"_{out}_{g}") for g in group], F.col(b).alias(f"_{out}_b"), before.alias(f"_{out}_base"))
    inner = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1
    placed = df.withColumn(f"_{out}_r", inner)
    cond = placed[b] == counts[f"_{out}_b"]
    for g in group:
        cond = cond & placed[g].eqNullSafe(counts[f"_{out}_{g}"])
    placed = placed.join(counts, cond)
    keep = [c for c in df.columns if c != b]
    return placed.select(*[placed[c] for c in keep], (F.col(f"_{out}_r") + F.col(f"_{out}_base")).cast("long").alias(out))


class UnionFind:
    """Union-find over arbitrary 64-bit ids; the root of a set is its smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)


def _forest(batches):
    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uf.union(a, b)
    nodes = [x for x in uf.up if uf.find(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([uf.find(x) for x in nodes], pa.int64())], ["a", "b"])


#: Links that one task may hold for the last union-find (16 bytes each on the wire, well below 1 GB in Python).
ONE_TASK_LINKS = 1_000_000


def components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """Links (a, b) -> (node, component): the smallest id reachable, for every node that has a link.

    Every partition first reduces its links to a forest; large-star and small-star rounds follow until the links fit
    the documented bound, and one executor task finishes them. Nothing is collected to the driver.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = scratch.save(e.mapInArrow(_forest, "a long, b long"), "cc")
    while e.count() > one_task:
        both = e.union(e.select("b", "a"))
        low = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "cc_low")
        large = both.join(low, both.a == low.u).filter("b > a").selectExpr("b as a", "m as b").distinct()
        large = scratch.save(large, "cc_large")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "cc_low")
        small = large.join(low, large.a == low.u).select(F.explode(F.array(F.struct(F.col("b").alias("v"), "m"), F.struct(F.col("a").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        changed = small.exceptAll(e.select("a", "b")).limit(1).count() or e.exceptAll(small).limit(1).count()
        e = scratch.save(small, "cc")
        if not changed:
            break
    else:
        e = e.repartition(1).mapInArrow(_forest, "a long, b long")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select("component", "component").distinct()).toDF("node", "component")


def release() -> None:
    """Gives free memory back to the system at the end of a task: a Python worker outlives its tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def batches_of(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Slices of a batch whose text column has about so many bytes: very long texts do not pile up."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def words_of(texts: pa.Array, lower: bool, stops: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space as one binary array, and the number of words of each text (null: none).

    stops: a full stop or comma at the end of a word is a word of its own if an ASCII letter or digit, or a letter of
    Latin-1, stands before it.
    """
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    space = SPACE[data]
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    inner = ends[:-1][ends[:-1] < len(data)]
    first[inner] = solid[inner]  # a text starts a word of its own
    if stops and len(data):
        last = np.append(space[1:], True)
        last[ends[1:][ends[1:] > 0] - 1] = True
        at = np.flatnonzero(last & ((data == 46) | (data == 44)) & ~first)
        before = data[at - 1]
        latin = (data[np.maximum(at - 2, 0)] == 0xC3) & (at > 1) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        first[at[ALNUM[before] | latin]] = True
    starts = np.flatnonzero(first)
    bounds = starts - np.searchsorted(np.flatnonzero(space), starts)
    body = data[solid]
    bounds = np.append(bounds, len(body)).astype(np.int64)
    counts = np.diff(np.searchsorted(starts, ends))
    body = LOWER[body] if lower else body
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)]), counts


def listed(words: pa.Array) -> list[bytes]:
    """The words of a binary array (none has a space) as a list, without an Arrow scalar for each."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    out = np.full(len(data) + len(words), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = data
    return out.tobytes().split(b" ")[:-1]
