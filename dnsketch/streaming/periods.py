"""Structured Streaming: period sketches and minute counters from a stream of lookups.

Every micro-batch adds its own parts (bitmaps, registers, counts) under its number and overwrites them if it is run
again, so a restart neither loses nor doubles anything; readers merge the parts of a period. Nothing of a period is held
in memory between batches, however large its sketch is, and late rows simply add to their period.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dnsketch.model import BloomConfig
from dnsketch.operators import hll, metrics, sketch

PARTS = ("counts", "bloom", "hll")


def events_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """The events of a folder, a file or a directory of files, as a stream, so many files a batch."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a stream takes a plain path for a directory; a pattern may also match one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/events.parque[t]")


def add_parts(rows: DataFrame, cfg: BloomConfig, path: str, batch: int) -> None:
    """One micro-batch of lookups (ts, ip, host, qtype, entity) as parts."""
    keyed = rows.withColumn("period_end", sketch.period_end(F.col("ts"), cfg.period))
    counts = keyed.groupBy("period_end").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_request"), F.max("ts").alias("last_request"))
    for name, df in (("counts", counts), ("bloom", sketch.bitmaps(sketch.filter_tokens(rows, cfg), cfg)), ("hll", sketch.registers(rows, cfg))):
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def run_periods(lookups: DataFrame, cfg: BloomConfig, path: str, dimension: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts the query; `dimension` is called with each batch, so what it reads by path is read anew every time."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            add_parts(dimension(batch) if dimension else batch, cfg, path, number)
        finally:
            batch.unpersist()

    return lookups.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()


def periods(spark: SparkSession, path: str, cfg: BloomConfig) -> sketch.State:
    """The parts of all batches, merged."""
    t = {name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/batch=*") for name in PARTS}
    bloom, regs = (_merged(name, t[name]) for name in ("bloom", "hll"))
    head = _merged("counts", t["counts"]).withColumnRenamed("n", "number_of_requests").withColumn("period_begin", F.col("first_request"))
    return sketch.State(sketch.described(head, regs, cfg), bloom, sketch.bits_set(bloom), regs, cfg)


def compact(spark: SparkSession, path: str, cfg: BloomConfig) -> None:
    """Merges the parts of all batches but the last, which a restart may write again, into one; run it while no query is.

    The merged table is complete before any part goes; after a crash in between, `_merged` still has all of them.
    """
    fs, hadoop = _files(spark, path)
    for name in PARTS:
        old = sorted((x.getPath() for x in fs.globStatus(hadoop(f"{path}/{name}/batch=*")) or []), key=lambda p: int(p.getName().partition("=")[2]))[:-1]
        if len(old) < 2:
            continue
        t = spark.read.parquet(*[p.toString() for p in old])
        _merged(name, t).write.mode("overwrite").parquet(f"{path}/_merged/{name}")
        for p in old:
            fs.delete(p, True)
        fs.rename(hadoop(f"{path}/_merged/{name}"), hadoop(f"{path}/{name}/batch=-1"))


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _merged(name: str, t: DataFrame) -> DataFrame:
    if name == "bloom":
        return t.groupBy("period_end", "filter_idx", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    if name == "hll":
        return hll.merged(t, ["period_end", "kind"])
    return t.groupBy("period_end").agg(F.sum("n").alias("n"), F.min("first_request").alias("first_request"), F.max("last_request").alias("last_request"))


def run_counters(log: DataFrame, path: str) -> StreamingQuery:
    """Counters of each minute; each batch writes its own parts, so rows may come in any order and however late."""

    def put(batch: DataFrame, number: int) -> None:
        c = metrics.counters(batch, None, F.window("ts", "60 seconds")["start"])
        c.write.mode("overwrite").parquet(f"{path}/minutes/batch={number}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/_minutes").trigger(availableNow=True).start()


def counters(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all batches, added up."""
    t = spark.read.option("basePath", f"{path}/minutes").parquet(f"{path}/minutes/batch=*")
    sums = {c: F.sum(c) for c in t.columns if c not in ("window_start", "batch")}
    sums["n_qsec"] = F.floor(F.sum("n_proc") / 60)  # a rate: of the sum, not the sum of rates
    return t.groupBy("window_start").agg(*[x.alias(c) for c, x in sums.items()])
