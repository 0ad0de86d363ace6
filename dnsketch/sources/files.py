"""Text inputs and outputs: configuration, subnet definitions, CSV and log files, reports."""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
import re
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.functions.inet import prefix
from dnsketch.functions.names import evaluated
from dnsketch.model import GROUND_TRUTH, MAIL_LOG, SUBNETS, THREATS, BloomConfig

NESTING = 10
CONFIG_KEYS = {"period_length": "period", "number_of_filters": "filters", "number_of_bits_per_filter": "bits", "number_of_hashes": "hashes", "number_of_filters_per_user": "per_user", "flatten_threshold": "flatten"}
OPEN = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


def lines(path: str) -> list[str]:
    """Lines of a small text file, also gzip, bzip2 or xz; the last one must end in a line feed."""
    with OPEN.get(os.path.splitext(path)[1], open)(path, "rt") as f:
        text = f.read()
    if text and not text.endswith("\n"):
        raise ValueError(f"{path}: the last line does not end")
    return text.splitlines()


def config(path: str, depth: int = 0) -> dict[str, str]:
    """keyword value lines; # and ; start comments; include FILE or FOLDER [if_exist] reads others in order of name."""
    if depth > NESTING:
        raise ValueError(f"{path}: includes are nested too deeply")
    out: dict[str, str] = {}
    for line in lines(path):
        line = re.split(r"[#;]", line, maxsplit=1)[0].strip()
        if not line:
            continue
        key, _, value = line.partition(" ")
        value = value.strip()
        if key != "include":
            out[key] = value
            continue
        target, optional = (value[: -len("if_exist")].strip(), True) if value.endswith(" if_exist") else (value, False)
        target = os.path.join(os.path.dirname(path), target)
        if os.path.isdir(target):
            for name in sorted(n for n in os.listdir(target) if re.fullmatch(r"[\w-]+(\.conf)?", n)):
                out |= config(os.path.join(target, name), depth + 1)
        elif os.path.exists(target) or not optional:
            out |= config(target, depth + 1)
    return out


def bloom_config(values: dict[str, str]) -> BloomConfig:
    """The geometry in a configuration; every number but flatten_threshold is required."""
    missing = [k for k in CONFIG_KEYS if k not in values and k != "flatten_threshold"]
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    got = {v: int(values[k]) for k, v in CONFIG_KEYS.items() if k in values}
    assert set(got) <= {f.name for f in fields(BloomConfig)}
    return BloomConfig(**got)


def subnet_definitions(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON definitions (one per row) -> entity, af, hi, lo, plen, ord. Trailing commas are forgiven; other broken JSON fails, so does a broken prefix."""
    clean = F.regexp_replace(column, r",(\s*[\]}])", "$1")
    groups = texts.select(F.posexplode(F.from_json(clean, SUBNETS, {"mode": "FAILFAST"})["subnet_activity"]).alias("g", "a"))
    each = groups.select("g", F.col("a.entity").alias("entity"), F.posexplode("a.prefixes").alias("p", "m")).select("g", "p", "entity", F.explode("m").alias("ip", "plen"))
    text = F.concat_ws("/", "ip", F.col("plen").cast("string"))
    out = each.withColumn("x", prefix(text)).withColumn("ok", F.assert_true(F.col("x.plen").isNotNull(), F.concat(F.lit("no prefix: "), text)))
    return out.filter("ok is null").select("entity", "x.af", "x.hi", "x.lo", "x.plen", (F.col("g").cast("long") * 1_000_000 + F.col("p")).alias("ord"))


def subnet_file(spark: SparkSession, path: str) -> DataFrame:
    return subnet_definitions(spark.read.text(path, wholetext=True))


def first_column(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """The first column of a CSV without a header, trimmed, lower case, distinct: blacklists and lists of organisations."""
    return spark.read.csv(path).select(F.lower(F.trim("_c0")).alias(name)).filter(F.col(name) != "").dropDuplicates()


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a DNS log in CSV: ts, client, type, name."""
    rows = spark.read.csv(path, schema=GROUND_TRUTH, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).filter("kind = 'Q(Q)'")
    return rows.select(F.timestamp_seconds("ts").alias("ts"), "client", "type", evaluated("fqdn").alias("name"))


def mail_log(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, schema=MAIL_LOG, sep=" ")
    return rows.select(F.to_timestamp("ts").alias("ts"), "ip")


def customers(spark: SparkSession, path: str, prefix_column: str, name_column: str) -> DataFrame:
    """entity, prefix of a sheet with a header; its column names are the caller's."""
    return spark.read.csv(path, header=True).select(F.col(f"`{name_column}`").alias("entity"), F.trim(f"`{prefix_column}`").alias("prefix"))


def sector_map(spark: SparkSession, path: str, name_column: str, sector_column: str) -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col(f"`{name_column}`").alias("entity"), F.col(f"`{sector_column}`").alias("sector"))


def threat_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", THREATS)["response"]).alias("r")).select("r.Event.*")


def result_hosts(results: DataFrame, column: str = "value") -> DataFrame:
    """Host keys of the first group of search results in JSON, with the range of time they cover."""
    j = F.from_json(column, "first_request long, last_request long, groups array<struct<hostnames map<string,long>>>")
    return results.select(j.alias("j")).select("j.first_request", "j.last_request", F.explode(F.map_keys(F.get("j.groups", F.lit(0))["hostnames"])).alias("host"))


def experiment_log(text: DataFrame, column: str = "value") -> DataFrame:
    """day, inside, total: each `Statistics for D.hs.json:` line with the `[a / b]` line behind it, per file.

    The text of a file is one row, so a pair of lines is one match and no order of rows is needed.
    """
    pair = r"Statistics for (\S+?)\.hs\.json:\s*\n[^\[\n]*\[\s*(\d+)\s*/\s*(\d+)\s*\]"
    found = text.select(*[F.regexp_extract_all(column, F.lit(pair), i).alias(f"x{i}") for i in (1, 2, 3)])
    z = found.select(F.explode(F.arrays_zip("x1", "x2", "x3")).alias("z"))
    return z.select(F.col("z.x1").alias("day"), F.col("z.x2").cast("long").alias("inside"), F.col("z.x3").cast("long").alias("total"))


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """sector,count · day,inside,total · time,actfpr,fillrate: whatever the columns are."""
    df.write.mode("overwrite").csv(path, header=header)


def write_results(results: DataFrame, path: str) -> None:
    """One folder of JSON lines per period."""
    results.select("period_end", F.col("result").alias("value")).write.mode("overwrite").partitionBy("period_end").text(path)
