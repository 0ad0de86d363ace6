"""What a query of the catalogue is: a function of (session, folder), and the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dnsketch.model import BloomConfig
from dnsketch.operators import sketch
from dnsketch.session import shared_folder
from dnsketch.sources import dims, dnslog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_STORED: dict[tuple, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lookups(spark: SparkSession, d: str) -> DataFrame:
    return dnslog.lookups(dnslog.dns_log(spark, d), dims.entity_prefixes(spark, d))


def stored(spark: SparkSession, d: str, cfg: BloomConfig) -> sketch.State:
    """The state of a folder's log, built and laid down once for a session; searches read what is stored.

    It is built anew if one of the folder's tables has changed, or the stored state is gone.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def stamp(name: str) -> tuple:
        p = path_of(f"{d}/{name}.parquet")
        s = p.getFileSystem(conf).getFileStatus(p)
        return s.getModificationTime(), s.getLen()

    key = (spark.sparkContext.applicationId, d, cfg, *map(stamp, ("events", "pages", "nation", "region")))
    path = _STORED.get(key)
    if path:
        p = path_of(f"{path}/hll")  # the last table that is written
        if p.getFileSystem(conf).exists(p):
            return sketch.load(spark, path, cfg)
    path = shared_folder(spark, "state")
    state = sketch.store(lookups(spark, d), cfg, path)
    _STORED[key] = path
    return state
