"""Evaluation and reporting over search results: sectors, Pareto, ground truth, suffix matches, threat intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsketch.functions.names import entity_part, host_part, registrable, suffixes
from dnsketch.model import THREAT_LEVELS
from dnsketch.session import written


def hits_by_entity(hits: DataFrame, token: str = "token") -> DataFrame:
    """Hits per organisation: what stands before @ ; tokens without one are left out."""
    return hits.select(entity_part(F.col(token)).alias("entity")).filter("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("hits"))


def occurrences(names: DataFrame, name: str = "name") -> DataFrame:
    """name, n: each name once, with how often it came."""
    return names.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def hit_domains(hits: DataFrame, token: str = "token") -> DataFrame:
    return hits.select(host_part(F.col(token)).alias("domain")).distinct()


def by_sector(counts: DataFrame, sectors: DataFrame) -> DataFrame:
    """Inner join: organisations without a sector are dropped (unmatched() lists them)."""
    return counts.join(sectors, "entity").groupBy("sector").agg(F.sum("hits").alias("count"))


def unmatched(counts: DataFrame, sectors: DataFrame) -> DataFrame:
    return counts.join(sectors, "entity", "left_anti")


def pareto(counts: DataFrame, name: str, count: str, share: float = 0.8) -> DataFrame:
    """The largest rows until their running sum reaches the share of all; the row that reaches it is included.

    Ties are broken by name. Rows are sorted in ranges of (count, name) whose bounds Spark samples, so that a tail of equal
    counts is many ranges, and written; ranges are summed, and a row's sum is that of the ranges before and of its own range so far.
    """
    sorted_ = written(counts.select(name, count).repartitionByRange(F.desc(count), F.asc(name)).withColumn("_range", F.spark_partition_id()), "pareto")
    sums = sorted_.groupBy("_range").agg(F.sum(count).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    total = F.floor(F.lit(share) * counts.agg(F.sum(count)).scalar())
    inside = F.sum(count).over(Window.partitionBy("_range").orderBy(F.desc(count), name).rowsBetween(Window.unboundedPreceding, 0))
    out = sorted_.withColumn("_inside", inside).join(before, "_range").withColumn("running", F.col("_before") + F.col("_inside"))
    return out.filter(F.col("running") - F.col(count) < total).select(name, count, "running")


def top(counts: DataFrame, name: str, count: str, n: int = 30) -> DataFrame:
    """The n largest, ties by name; a bounded heap per task."""
    return counts.orderBy(F.desc(count), name).limit(n)


def excluding(tokens: DataFrame, labels: list[str], token: str = "token") -> DataFrame:
    """Without tokens of these organisations; plain tokens stay."""
    e = entity_part(F.col(token))
    return tokens.filter(e.isNull() | ~e.isin(labels))


def only(tokens: DataFrame, labels: list[str], token: str = "token") -> DataFrame:
    return tokens.filter(entity_part(F.col(token)).isin(labels))


def scored(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """inside, total, percent: how many of the wanted are found."""
    flag = found.select(key).distinct().withColumn("_in", F.lit(True))
    c = wanted.select(key).distinct().join(flag, key, "left")
    inside, total = F.count_if(F.col("_in")), F.count(F.lit(1))
    return c.agg(inside.alias("inside"), total.alias("total"), F.when(total > 0, F.round(100.0 * inside / total, 2)).alias("percent"))


def missed(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def suffix_matches(hosts: DataFrame, names: DataFrame, host: str = "host", name: str = "name") -> DataFrame:
    """host, name: every name that is the host or a suffix of it."""
    parts = hosts.select(host).distinct().withColumn("_suffix", F.explode(suffixes(F.col(host))))
    return parts.join(names.select(name).distinct(), F.col("_suffix") == F.col(name)).select(host, name)


def fallback_matches(hosts: DataFrame, names: DataFrame, host: str = "host", name: str = "name") -> DataFrame:
    """host, matched: the name equal to the host, else the one equal to its registrable domain."""
    n = names.select(F.col(name).alias("_n")).distinct()
    h = hosts.select(host).distinct()
    exact = n.withColumnRenamed("_n", "_exact")
    domain = n.withColumnRenamed("_n", "_domain")
    got = h.join(exact, F.col(host) == F.col("_exact"), "left").join(domain, registrable(F.col(host)) == F.col("_domain"), "left")
    return got.select(host, F.coalesce("_exact", "_domain").alias("matched")).filter("matched is not null")


def registrable_by_list(hosts: DataFrame, public: DataFrame, host: str = "host", suffix: str = "suffix") -> DataFrame:
    """host, domain: the longest listed public suffix and one label before it; the last two labels where none is listed.

    A host that is itself a public suffix has no domain of its own (null).
    """
    h = hosts.select(host).distinct().withColumn("_suffix", F.explode(suffixes(F.col(host))))
    listed = h.join(public.select(F.col(suffix).alias("_suffix")).distinct(), "_suffix").groupBy(host).agg(F.max(F.size(F.split("_suffix", r"\."))).alias("_n"))
    labels = F.split(F.col(host), r"\.")
    own = F.when(F.col("_n").isNull(), registrable(F.col(host))).when(F.size(labels) > F.col("_n"), F.concat_ws(".", F.slice(labels, F.size(labels) - F.col("_n"), F.col("_n") + 1)))
    return hosts.select(host).distinct().join(listed, host, "left").select(host, own.alias("domain"))


def complete_days(periods: DataFrame, length: int, end: str = "period_end") -> DataFrame:
    """Days with as many states as they have periods. A state counts for the day in which it ends."""
    need = 86_400 // length
    return periods.groupBy(F.to_date(end).alias("day")).agg(F.count(F.lit(1)).alias("states")).withColumn("complete", F.col("states") >= need)


def pending(states: DataFrame, results: DataFrame, key: str = "period_end") -> DataFrame:
    return states.select(key).distinct().join(results.select(key), key, "left_anti")


def prefix_lists(prefixes: DataFrame) -> DataFrame:
    """entity, json of its prefixes as [{"ip": length}, ...]; of equal prefixes the last (by ord) counts."""
    last = prefixes.groupBy("ip", "plen").agg(F.max_by("entity", "ord").alias("entity"), F.max("ord").alias("ord"))
    lists = last.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("ord", "ip", "plen"))).alias("p"))
    return lists.select("entity", F.to_json(F.transform("p", lambda x: F.create_map(x["ip"], x["plen"]))).alias("prefixes"))


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with side; counts of repeated rows matter."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def latest(files: DataFrame, n: int = 2, by: str = "modified", name: str = "name") -> DataFrame:
    return files.orderBy(F.desc(by), name).limit(n)


def has_attribute(attributes: Column, kind: str = "domain") -> Column:
    return F.coalesce(F.exists(attributes, lambda a: F.lower(a["type"]) == kind), F.lit(False))


def ioc_ratio(events: DataFrame) -> DataFrame:
    """Events, those with a domain attribute, and the percentage."""
    flag = has_attribute(F.col("Attribute"))
    n, of = F.count_if(flag), F.count(F.lit(1))
    return events.agg(n.alias("with_domain"), of.alias("events"), F.when(of > 0, F.round(100.0 * n / of, 2)).alias("percent"))


def threat_level(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in THREAT_LEVELS.items() for x in kv]), level.cast("int"))


def tlp(tags: Column) -> Column:
    """The text behind the colon of the last tag whose name has tlp in it."""
    found = F.filter(tags, lambda t: F.contains(F.lower(t["name"]), F.lit("tlp")))
    return F.split_part(F.get(found, F.size(found) - 1)["name"], F.lit(":"), F.lit(2))


def enriched(attributes: DataFrame, events: DataFrame) -> DataFrame:
    """attributes(domain, event_id) with the info, level and TLP of their event."""
    e = events.select("event_id", "info", threat_level(F.col("threat_level_id")).alias("threat_level"), tlp(F.col("Tag")).alias("tlp"))
    return attributes.join(e, "event_id")
