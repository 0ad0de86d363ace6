"""DNS lookups: the log derived from the star-schema tables, text logs, and what a lookup adds to a sketch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.functions.inet import address, packed
from dnsketch.functions.names import entity_or_unknown, normalised, reverse_pointer, tokens
from dnsketch.model import ACCEPTED_TYPES
from dnsketch.operators.lpm import client_entities, match_bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host of every page whose url has a host."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host")).filter("host <> ''")


def dns_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """event_id, ts, client, ip, qname, qclass, qtype, msg_type: a query log from events (a table or a stream) and pages."""
    hosts, n = page_hosts(spark, sf_dir), table(spark, sf_dir, "pages").agg(F.count(F.lit(1))).scalar()
    events = table(spark, sf_dir, "events") if events is None else events
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_id") % n).alias("page_id"))
    r, u, turn = F.col("event_id") % 12, F.col("user_id"), F.floor(F.col("event_id") / 12)
    qtype = F.when((r <= 3) | (r == 11), "A").when(r <= 5, "AAAA").when(r == 6, "NS").when(r == 7, "MX").when(r == 8, "PTR").when(r == 9, "TXT").otherwise("SRV")
    octets = F.when(u % 7 == 0, F.array(F.lit(172), F.lit(16), F.lit(0), u % 256)).otherwise(F.array(F.lit(10), u % 25, u % 3, u % 256))
    client = F.concat_ws(".", octets.cast("array<string>"))
    log = e.join(hosts, "page_id").select("event_id", "ts", client.alias("client"), (((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]).alias("ip"), "host", F.when(r == 11, "CH").otherwise("IN").alias("qclass"), qtype.alias("qtype"))
    name = F.when(F.col("qtype") == "PTR", reverse_pointer(F.col("client"))).otherwise(F.col("host"))
    name = F.when(turn % 3 == 0, F.upper(name)).otherwise(name)
    name = F.when(turn % 2 == 0, F.concat(name, F.lit("."))).otherwise(name)
    return log.select("event_id", "ts", "client", "ip", name.alias("qname"), "qclass", "qtype", F.lit("CLIENT_QUERY").alias("msg_type"))


def client_query(df: DataFrame) -> DataFrame:
    return df.filter("msg_type = 'CLIENT_QUERY' and qname is not null")


def accepted(qclass: Column | None = None, qtype: Column | None = None) -> Column:
    """Class IN and one of the accepted types."""
    return ((F.col("qclass") if qclass is None else qclass) == "IN") & (F.col("qtype") if qtype is None else qtype).isin(*ACCEPTED_TYPES)


def lookups(log: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Accepted queries with a client: event_id, ts, client, ip, host, qtype, entity (null without a prefix)."""
    rows = client_query(log).filter(accepted() & F.col("ip").isNotNull())
    rows = rows.select("event_id", "ts", "client", "ip", normalised("qname").alias("host"), "qtype")
    return rows.join(client_entities(rows, prefixes), "ip", "left")


def any_lookups(log: DataFrame, prefixes: DataFrame | None) -> DataFrame:
    """Accepted queries of clients of either family: ts, client, addr (4 or 16 bytes), host, qtype, entity.

    prefixes: definitions as files.subnet_definitions() gives them. Rows whose client is no address are left out.
    """
    rows = client_query(log).filter(accepted() & F.col("client").isNotNull())
    rows = rows.select("ts", normalised("qname").alias("host"), "qtype", address(F.col("client")).alias("a")).filter("a.af is not null")
    rows = rows.select("ts", F.col("a.text").alias("client"), "a.af", "a.hi", "a.lo", "host", "qtype")
    rows = rows.withColumn("entity", F.lit(None).cast("string")) if prefixes is None else match_bits(rows, prefixes)
    return rows.select("ts", "client", packed(F.col("af"), F.col("hi"), F.col("lo")).alias("addr"), "host", "qtype", "entity")


def token_rows(rows: DataFrame, with_entity: bool = True) -> DataFrame:
    """One row per lookup and token."""
    entity = entity_or_unknown(F.col("entity")) if with_entity else None
    return rows.withColumn("token", F.explode(tokens(F.col("host"), F.col("qtype"), entity)))


LINE = r"^(\d+) (\S+) (\S+?)\.?/(\d+)/(\d+)$"


def parse_text_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """`epoch client host./type/class` lines; comments and broken lines are left out."""
    def part(i: int) -> Column:
        return F.regexp_extract(column, LINE, i)

    rows = lines.filter(~F.col(column).startswith("#") & F.col(column).rlike(LINE))
    return rows.select(F.timestamp_seconds(part(1).cast("long")).alias("ts"), part(2).alias("client"), part(3).alias("qname"), part(4).cast("int").alias("qtype"), part(5).cast("int").alias("qclass"))


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """Text log files; gzip and bzip2 are read as they are."""
    return parse_text_log(spark.read.text(path))
