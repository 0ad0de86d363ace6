"""Longest-prefix match as equi-joins: a distinct address is tried at each prefix length there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsketch.functions.inet import masked_halves


def masked(ip: Column, plen: Column) -> Column:
    """An IPv4 number with only its first plen bits."""
    rest = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - plen).cast("int"))
    return ip - F.pmod(ip, rest)


def registered(prefixes: DataFrame) -> DataFrame:
    """entity, net, plen with host bits cleared; of equal prefixes the first (by ord) counts."""
    net = masked(F.col("net"), F.col("plen")).alias("net")
    return prefixes.select("entity", net, "plen", "ord").groupBy("net", "plen").agg(F.min_by("entity", "ord").alias("entity"))


def client_entities(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """ip, entity of every distinct address that has a prefix.

    The lengths in use (33 at most) are a scalar subquery; each address makes one probe per length, and both sides are
    joined on (length, masked address), so there is no nested loop and the side that is sent is the planner's choice.
    """
    known = registered(prefixes)
    lengths = known.agg(F.array_sort(F.collect_set("plen"))).scalar()
    probes = rows.select("ip").distinct().withColumn("plen", F.explode(lengths))
    probes = probes.withColumn("net", masked(F.col("ip"), F.col("plen")))
    return probes.join(known, ["plen", "net"]).groupBy("ip").agg(F.max_by("entity", "plen").alias("entity"))


def match_bits(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The same for IPv4 and IPv6 at once: addresses (af, hi, lo) and prefixes (af, hi, lo, plen, entity, ord).

    Works for every length, /0 and lengths that are no multiple of 8 included. The lengths in use, 162 at most, are a
    scalar; each distinct address makes a probe for each length of its family.
    """
    hi, lo = masked_halves(F.col("hi"), F.col("lo"), F.col("plen"))
    known = prefixes.select("af", "plen", hi.alias("phi"), lo.alias("plo"), "entity", "ord").groupBy("af", "plen", "phi", "plo").agg(F.min_by("entity", "ord").alias("entity"))
    lengths = known.agg(F.collect_set(F.struct("af", "plen"))).scalar()
    once = addresses.select("af", "hi", "lo").distinct().withColumn("l", F.explode(lengths)).filter("l.af = af").withColumn("plen", F.col("l.plen"))
    probes = once.select("af", "hi", "lo", "plen", hi.alias("phi"), lo.alias("plo"))
    best = probes.join(known, ["af", "plen", "phi", "plo"]).groupBy("af", "hi", "lo").agg(F.max_by("entity", "plen").alias("entity"))
    return addresses.join(best, ["af", "hi", "lo"], "left")
