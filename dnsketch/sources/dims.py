"""Organisations, sectors and blacklists derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.functions.names import registrable
from dnsketch.model import UNKNOWN
from dnsketch.sources.dnslog import page_hosts, table


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("k"), "n_name", "r_name")


def entity_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, net, plen, ord: 10/8, 10.k/16 for even nations, 10.k.0/24 for every fifth (its region), so prefixes nest."""
    base, n = 10 << 24, nations(spark, sf_dir)
    k = F.col("k")
    top = spark.range(1).select(F.lit("BACKBONE").alias("entity"), F.lit(base).cast("long").alias("net"), F.lit(8).alias("plen"), F.lit(0).cast("long").alias("ord"))
    mid = n.filter(k % 2 == 0).select(F.col("n_name").alias("entity"), (k * 65536 + base).alias("net"), F.lit(16).alias("plen"), (k + 1).alias("ord"))
    low = n.filter(k % 5 == 0).select(F.col("r_name").alias("entity"), (k * 65536 + base).alias("net"), F.lit(24).alias("plen"), (k + 101).alias("ord"))
    return top.union(mid).union(low)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity -> sector (its region); BACKBONE and UNKNOWN have none."""
    n = nations(spark, sf_dir)
    return n.select(F.col("n_name").alias("entity"), F.col("r_name").alias("sector")).union(n.select("r_name", "r_name")).distinct()


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name: hosts of every fifth page, last two labels of every seventh, ten names that nobody asks for; lower case, distinct."""
    h = page_hosts(spark, sf_dir)
    gone = spark.range(10).select(F.concat(F.lit("absent-"), F.col("id"), F.lit(".invalid")).alias("name"))
    names = h.filter("page_id % 5 = 0").select(F.col("host").alias("name")).union(h.filter("page_id % 7 = 0").select(registrable(F.col("host")))).union(gone)
    return names.select(F.trim(F.lower("name")).alias("name")).dropDuplicates()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_prefixes(spark, sf_dir).select("entity").distinct()


def campaign(names: DataFrame, entities: DataFrame) -> DataFrame:
    """name, entity, token: every name alone, under each organisation and under UNKNOWN.

    The product is what a campaign searches for. It is made by giving each name the array of organisations, a bounded
    scalar (an organisation is a customer, not a row of data), instead of by a join.
    """
    every = entities.select("entity").union(entities.sparkSession.range(1).select(F.lit(UNKNOWN))).distinct()
    tags = every.agg(F.array_sort(F.collect_set("entity"))).scalar()
    rows = names.select("name", F.explode(F.concat(F.array(F.lit(None).cast("string")), tags)).alias("entity"))
    return rows.withColumn("token", F.concat(F.coalesce(F.concat("entity", F.lit("@")), F.lit("")), "name"))
