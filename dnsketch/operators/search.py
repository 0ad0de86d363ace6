"""Searching sketches: probing hashes, group intersections, flattening, and the JSON of a result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsketch.functions.formulas import actual_fpr, approx_count, fill_rate
from dnsketch.functions.hashing import offsets_udf
from dnsketch.model import BUCKET_BITS, JOB
from dnsketch.operators.sketch import State


def parse_jobs(jobs: DataFrame, column: str = "job") -> DataFrame:
    """JSON jobs -> job_id, group_no, group_id, host_key, hex. Unknown keys are ignored; a job that is no JSON fails.

    A missing id is 0. Groups without host names give no row.
    """
    parsed = jobs.select("job_id", F.from_json(column, JOB, {"mode": "FAILFAST"}).alias("j"))
    groups = parsed.select("job_id", F.posexplode("j.groups").alias("group_no", "g"))
    return groups.select("job_id", "group_no", F.coalesce("g.id", F.lit(0)).cast("long").alias("group_id"), F.explode("g.hostnames").alias("host_key", "hex"))


def is_hash(hexed: Column) -> Column:
    """64 hexadecimal digits, of either case; others are skipped with a warning and do not count as missed."""
    return F.coalesce(hexed.rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))


ASKED = 20_000  # bits that one list asks of a bucket, about


def _tested(asked: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """The asked bits that are set, for each bitmap of the bucket."""
    hexes, ends, filters = [], [], []
    if asked.num_rows and bitmaps.num_rows:
        bit = np.asarray(asked["bit"])
        place, shift = bit >> 3, (bit & 7).astype(np.uint8)
        for lo in range(0, bitmaps.num_rows, 64):
            some = bitmaps.slice(lo, 64)
            rows = np.frombuffer(b"".join(some["bitmap"].to_pylist()), np.uint8).reshape(some.num_rows, -1)
            i, j = np.nonzero(rows[:, place] >> shift & 1)
            ends.append(some["period_end"].take(pa.array(i)).combine_chunks())
            hexes.append(asked["hex"].take(pa.array(j)).combine_chunks())
            filters.append(pa.array(np.full(len(i), asked["f"][0].as_py(), np.int32)))
    kinds = {"period_end": bitmaps.schema.field("period_end").type, "hex": pa.string(), "filter_idx": pa.int32()}
    return pa.table({name: pa.chunked_array(parts, kind) for (name, kind), parts in zip(kinds.items(), (ends, hexes, filters), strict=True)})


def probe(hashes: DataFrame, state: State, periods: Column | None = None) -> DataFrame:
    """hashes(hex) x periods -> period_end, hex, filter_idx of every filter that has all the hash's bits.

    Offsets are made once per distinct hash and filter and dealt by (filter, bucket) into lists of about ASKED bits. A list
    meets all bitmaps of its bucket in one task, 4 KiB for each period, and only bits that are set leave as rows: neither a
    bitmap nor a list is copied for each pair. Only the bitmaps of buckets that a hash needs are tested.
    """
    cfg = state.config
    buckets = cfg.filters * -(-cfg.bits // BUCKET_BITS)
    once = hashes.select(F.lower("hex").alias("hex")).filter(is_hash(F.col("hex"))).distinct()
    lists = once.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * cfg.filters * cfg.hashes / (buckets * ASKED))).cast("int")).scalar()
    keyed = once.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(cfg.filters - 1))))
    bits = keyed.select("hex", "f", F.explode(offsets_udf(cfg.bits, cfg.hashes)(F.col("hex"), F.col("f"))).alias("o"))
    asked = bits.select("f", F.floor(F.col("o") / BUCKET_BITS).cast("int").alias("b"), F.pmod(F.xxhash64("hex"), lists).cast("int").alias("l"), (F.col("o") % BUCKET_BITS).cast("int").alias("bit"), "hex")
    bloom = state.bloom if periods is None else state.bloom.filter(periods)
    bloom = bloom.select("period_end", "filter_idx", "bucket", "bitmap", F.explode(F.sequence(F.lit(0), lists - 1)).alias("list"))
    hit = asked.groupBy("f", "b", "l").cogroup(bloom.groupBy("filter_idx", "bucket", "list")).applyInArrow(_tested, "period_end timestamp, hex string, filter_idx int")
    return hit.groupBy("period_end", "hex", "filter_idx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == min(cfg.hashes, cfg.bits)).select("period_end", "hex", "filter_idx")


def host_hits(jobs: DataFrame, state: State) -> DataFrame:
    """period_end, job_id, group_no, group_id, host_key, hits, mask of each job host and period; 0 and no bits where missed.

    A mask is one 64-bit number, so there may be 63 filters at most.
    """
    if state.config.filters > 63:
        raise ValueError("more than 63 filters need array masks")
    found = probe(jobs, state).groupBy("period_end", "hex").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("filter_idx"))).alias("mask"))
    wanted = jobs.filter(is_hash(F.col("hex"))).withColumn("hex", F.lower("hex"))
    periods = state.header.agg(F.array_sort(F.collect_set("period_end"))).scalar()
    every = wanted.withColumn("period_end", F.explode(periods))
    out = every.join(found, ["period_end", "hex"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)).cast("long"))
    return out.select("period_end", "job_id", "group_no", "group_id", "host_key", F.bit_count("mask").cast("long").alias("hits"), "mask")


def flatten(hits: DataFrame, state: State, threshold: int, on: str = "host_names") -> DataFrame:
    """Adds flattened: whether the period's estimate is below the threshold; then a host has 1 hit or none.

    The estimate is that of host names; on='clients' takes the other. Threshold 0 never flattens.
    """
    est = {"host_names": "est_host_names", "clients": "est_clients"}[on]
    flag = state.header.select("period_end", (F.coalesce(F.col(est), F.lit(0)) < threshold).alias("flattened"))
    flat = F.when(F.col("hits") >= state.config.per_user, 1).otherwise(0).cast("long")
    return hits.join(flag, "period_end").withColumn("hits", F.when(F.col("flattened"), flat).otherwise(F.col("hits")))


def group_hits(hits: DataFrame, state: State) -> DataFrame:
    """One row per group with a hit: hosts with hits, and in how many filters all of its hosts are."""
    keys = ["period_end", "job_id", "group_no", "group_id", "flattened"]
    g = hits.groupBy(*keys).agg(F.count_if(F.col("hits") > 0).alias("hosts_hit"), F.bit_and("mask").alias("both"), F.bool_and(F.col("hits") > 0).alias("every"))
    n = F.bit_count("both").cast("long")
    n = F.when(F.col("flattened"), F.when(n >= state.config.per_user, 1).otherwise(0)).otherwise(n)
    return g.filter("hosts_hit > 0").select(*keys, "hosts_hit", F.when(F.col("every"), n).otherwise(0).cast("long").alias("hits_by_all_hostnames"))


def results(jobs: DataFrame, state: State, threshold: int = 0) -> DataFrame:
    """period_end, job_id, result (JSON): period, geometry, filters, and the groups with their hosts.

    jobs has a row per job (job_id, job); a job without groups has neither groups nor flattened_results.
    """
    cfg = state.config
    specs = parse_jobs(jobs)
    hits = flatten(host_hits(specs, state), state, threshold)
    hosts = hits.filter("hits > 0").groupBy("period_end", "job_id", "group_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host_key", "hits")))).alias("hostnames"))
    groups = group_hits(hits, state).join(hosts, ["period_end", "job_id", "group_no"])
    listed = groups.groupBy("period_end", "job_id").agg(F.array_sort(F.collect_list(F.struct("group_no", F.col("group_id").alias("id"), F.to_json("hostnames").alias("hosts"), "hits_by_all_hostnames"))).alias("groups"))
    b = F.col("bits_set")
    filters = state.filter.groupBy("period_end").agg(F.array_sort(F.collect_list(F.struct("filter_idx", b.alias("number_of_bits_set"), approx_count(b, cfg.bits, cfg.hashes).alias("estimated_number_of_host_names"), F.format_string("%.10f", actual_fpr(fill_rate(b, cfg.bits), cfg.hashes)).alias("actual_false_positive_rate")))).alias("filters"))
    has_groups = F.col("has_groups")
    base = jobs.select("job_id", F.from_json("job", JOB, {"mode": "FAILFAST"})["groups"].isNotNull().alias("has_groups"))
    periods = state.header.join(filters, "period_end")
    every = base.withColumn("period_end", F.explode(state.header.agg(F.array_sort(F.collect_set("period_end"))).scalar())).join(periods, "period_end").join(listed, ["period_end", "job_id"], "left")
    group_json = F.transform(F.coalesce("groups", F.array().cast(listed.schema["groups"].dataType)), lambda g: F.concat(F.lit('{"hostnames":'), g["hosts"], F.lit(',"id":'), g["id"], F.lit(',"hits_by_all_hostnames":'), g["hits_by_all_hostnames"], F.lit("}")))
    fixed = F.to_json(
        F.struct(
            F.concat_ws(".", "major", "minor").alias("state_file_version"), *[F.col(c).cast("long").alias(c) for c in ("period_begin", "first_request", "last_request", "period_end")],
            F.coalesce("est_clients", F.lit(0)).alias("estimated_number_of_clients"), F.coalesce("est_host_names", F.lit(0)).alias("estimated_number_of_host_names"), "number_of_requests",
            "number_of_filters", "number_of_filters_per_user", "number_of_hashes", "number_of_bits_per_filter", F.lit(threshold).alias("flatten_threshold"),
            F.transform("filters", lambda f: F.struct(f["number_of_bits_set"].alias("number_of_bits_set"), f["estimated_number_of_host_names"].alias("estimated_number_of_host_names"), f["actual_false_positive_rate"].alias("actual_false_positive_rate"))).alias("filters"),
        )
    )
    flat = (F.coalesce("est_host_names", F.lit(0)) < threshold).cast("string")
    tail = F.when(has_groups, F.concat(F.lit(',"flattened_results":'), flat, F.lit(',"groups":['), F.concat_ws(",", group_json), F.lit("]}"))).otherwise(F.lit("}"))
    return every.select("period_end", "job_id", F.concat(F.substring(fixed, F.lit(1), F.length(fixed) - 1), tail).alias("result"))
