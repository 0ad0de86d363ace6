"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS (default: all) the number of cores.
Every query is run once to warm up and once for its time; results are consumed in full by a sink that keeps nothing. Searches
read states that the first run has stored; bloom_bits_set, bloom_multi_filter, state_header, hll_estimate and ingest build them.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

HEADLINE = (
    "token_extract", "lpm_entity", "instrument_minutely", "bloom_bits_set", "bloom_multi_filter", "state_header", "hll_estimate",
    "combine_daily", "search_hits", "search_group_intersection", "hits_by_sector", "gt_recall", "pareto80", "suffix_match", "dryrun_advice", "threat_levels",
)


def main() -> None:
    from dataclasses import replace

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from dnsketch.model import BENCH
    from dnsketch.operators import sketch
    from dnsketch.plans import catalogue, registry
    from dnsketch.session import shared_folder
    from dnsketch.sources import dims, dnslog

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def timed(f) -> float:
        f().write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    took = {name: timed(lambda name=name: catalogue.QUERIES[name](spark, d)) for name in HEADLINE}
    # ingest: the decoded log is laid down first; the clock covers prefix match, tokens, bitmaps, registers and headers, written
    # as files, with the published filters (4 of 2^27 bits, 2 per client). ingest: one active state, as the published figure
    # has; ingest_20x: the same with 20 logs of other hosts and clients, where a job's fixed cost counts less; ingest_days:
    # the log as 30 daily states, 2 GB of nearly empty bitmaps
    log = dnslog.dns_log(spark, d).persist()
    log.count()
    prefixes = dims.entity_prefixes(spark, d).persist()
    prefixes.count()
    n = dnslog.lookups(log, prefixes).count()
    copies = log.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    many = copies.withColumn("qname", F.concat(F.lit("x"), F.col("i"), F.lit("."), F.col("qname"))).withColumn("ip", F.col("ip") + 64 * F.col("i")).drop("i").persist()
    many.count()

    def clocked(f) -> float:
        f()
        start = time.perf_counter()
        f()
        return round(time.perf_counter() - start, 3)

    one = replace(BENCH, period=100 * 86_400)
    for name, rows, cfg in (("ingest", log, one), ("ingest_20x", many, one), ("ingest_days", log, BENCH)):
        took[name] = clocked(lambda rows=rows, cfg=cfg: sketch.store(dnslog.lookups(rows, prefixes), cfg, shared_folder(spark, "ingest")))
    many.unpersist()
    # roll-up: 24 stored hourly states to a day, over all days
    hourly = registry.stored(spark, d, catalogue.HOURLY)
    took["roll_up"] = clocked(lambda: sketch.persist(sketch.combined(hourly), shared_folder(spark, "days")))
    cores = spark.sparkContext.defaultParallelism
    out = {"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rpartition("sf")[2], "lookups": n, "lookups_per_second": round(n / took["ingest"]), "lookups_per_second_20x": round(20 * n / took["ingest_20x"]), "per_core_20x": round(20 * n / took["ingest_20x"] / cores), "cores": cores, "cpus": cpus}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
