"""Period sketches as tables: header, Bloom bitmaps, bits per filter, HyperLogLog registers; building and combining."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.functions.formulas import actual_fpr, approx_count, fill_rate
from dnsketch.functions.hashing import bucketed_offsets, murmur_of, sha_low64
from dnsketch.functions.inet import ipv4_bytes
from dnsketch.model import BUCKET_BITS, FPR_ALARM, VERSION, BloomConfig
from dnsketch.operators import hll
from dnsketch.session import written
from dnsketch.sources.dnslog import token_rows

TABLES = ("header", "bloom", "filter", "hll")  # in the order in which they are laid down


@dataclass
class State:
    """The four tables of all periods; key: period_end."""

    header: DataFrame
    bloom: DataFrame
    filter: DataFrame
    hll: DataFrame
    config: BloomConfig


def period_end(ts: Column, length: int) -> Column:
    """The next multiple of the length since the epoch, as a timestamp."""
    s = ts.cast("long")
    return F.timestamp_seconds(s - F.pmod(s, F.lit(length)) + length)


def unsigned_mod(h: Column, n: int) -> Column:
    """The 64-bit pattern read as unsigned, modulo n."""
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(n)) * 2 + h.bitwiseAND(F.lit(1)), F.lit(n))


def addressed(rows: DataFrame) -> DataFrame:
    """rows with addr, the 4 or 16 bytes of the client's address; made of the IPv4 number ip where there is no such column."""
    return rows if "addr" in rows.columns else rows.withColumn("addr", ipv4_bytes(F.col("ip")))


def client_filters(rows: DataFrame, cfg: BloomConfig) -> DataFrame:
    """addr (and ip, if the rows have it), client_hash, filters array<int> of each distinct client."""
    keys = [c for c in ("addr", "ip") if c in (rows := addressed(rows)).columns]
    clients = rows.select(*keys).distinct().withColumn("client_hash", murmur_of(F.col("addr")))
    subsets = F.array(*[F.array(*[F.lit(i) for i in c]) for c in cfg.combos])
    return clients.withColumn("filters", subsets[unsigned_mod(F.col("client_hash"), len(cfg.combos)).cast("int")])


def filter_tokens(rows: DataFrame, cfg: BloomConfig) -> DataFrame:
    """period_end, filter_idx, token, distinct: dropping repeats before hashing is what makes the sketch cheap.

    The distinct has a map-side part, so that a host that half of all lookups ask for is one row per task.
    """
    keyed = addressed(rows).withColumn("period_end", period_end(F.col("ts"), cfg.period))
    if cfg.filters == 1:
        return token_rows(keyed).select("period_end", F.lit(0).alias("filter_idx"), "token").distinct()
    once = keyed.select("period_end", "addr", "host", "qtype", "entity").distinct()
    of = client_filters(keyed.select("addr"), cfg).select("addr", "filters")
    return token_rows(once.join(of, "addr").select("period_end", "host", "qtype", "entity", F.explode("filters").alias("filter_idx")).distinct()).select("period_end", "filter_idx", "token").distinct()


def bitmaps(tokens: DataFrame, cfg: BloomConfig) -> DataFrame:
    """period_end, filter_idx, bucket, bitmap: 4 KiB rows, least significant bit first.

    Spark makes the hash, Arrow batches the 256-bit arithmetic and gather a task's bits by bucket, two bytes a bit: what is
    shuffled is neither a row for each bit nor 4 KiB for each bucket of each task. Hashing spreads buckets evenly.
    """
    hashed = tokens.select("period_end", "filter_idx", F.unhex(F.sha2("token", 256)).alias("digest"))
    dealt = bucketed_offsets(hashed, cfg.bits, cfg.hashes, BUCKET_BITS).repartition("period_end", "filter_idx", "bucket")
    bits = dealt.select("period_end", "filter_idx", "bucket", F.explode("bits").alias("o"))
    return bits.groupBy("period_end", "filter_idx", "bucket").agg(F.bitmap_construct_agg(F.col("o").cast("long")).alias("bitmap"))


def bits_set(bloom: DataFrame) -> DataFrame:
    return bloom.groupBy("period_end", "filter_idx").agg(F.sum(F.bitmap_count("bitmap")).cast("long").alias("bits_set"))


def header(rows: DataFrame, registers: DataFrame, cfg: BloomConfig) -> DataFrame:
    keyed = rows.withColumn("period_end", period_end(F.col("ts"), cfg.period))
    h = keyed.groupBy("period_end").agg(F.min("ts").alias("period_begin"), F.min("ts").alias("first_request"), F.max("ts").alias("last_request"), F.count(F.lit(1)).alias("number_of_requests"))
    return described(h, registers, cfg)


def described(h: DataFrame, registers: DataFrame, cfg: BloomConfig) -> DataFrame:
    """Headers with the estimates of the registers and the geometry."""
    est = hll.estimated(registers, ["period_end", "kind"]).groupBy("period_end").pivot("kind", ["client", "host"]).agg(F.first("estimate"))
    cols = {"number_of_filters": cfg.filters, "number_of_bits_per_filter": cfg.bits, "number_of_hashes": cfg.hashes, "number_of_filters_per_user": cfg.per_user, "flatten_threshold": cfg.flatten, "major": VERSION[0], "minor": VERSION[1]}
    h = h.join(est.withColumnsRenamed({"client": "est_clients", "host": "est_host_names"}), "period_end", "left")
    return h.withColumns({k: F.lit(v).cast("long") for k, v in cols.items()})


def registers(rows: DataFrame, cfg: BloomConfig) -> DataFrame:
    """period_end, kind, reg, rank: clients by their Murmur hash, tokens by the first bytes of SHA-256."""
    keyed = addressed(rows).withColumn("period_end", period_end(F.col("ts"), cfg.period))
    clients = keyed.select("period_end", "addr").distinct().select("period_end", F.lit("client").alias("kind"), murmur_of(F.col("addr")).alias("h"))
    once = token_rows(keyed.select("period_end", "host", "qtype", "entity").distinct()).select("period_end", "token").distinct()
    hosts = once.select("period_end", F.lit("host").alias("kind"), sha_low64(F.col("token")).alias("h"))
    return hll.registers(clients.union(hosts), ["period_end", "kind"], "h")


def with_empty(state: State, periods: DataFrame) -> State:
    """The state with an empty one (no requests, no bits) for each of the periods (period_end) that it lacks."""
    none = periods.select("period_end").distinct().join(state.header.select("period_end"), "period_end", "left_anti")
    zero = {"number_of_requests": 0, "est_clients": 0, "est_host_names": 0, "number_of_filters": state.config.filters, "number_of_bits_per_filter": state.config.bits, "number_of_hashes": state.config.hashes, "number_of_filters_per_user": state.config.per_user, "flatten_threshold": state.config.flatten, "major": VERSION[0], "minor": VERSION[1]}
    begin = F.timestamp_seconds(F.col("period_end").cast("long") - state.config.period)
    header = none.withColumns({"period_begin": begin} | {k: F.lit(v).cast("long") for k, v in zero.items()})
    filters = none.select("period_end", F.explode(F.sequence(F.lit(0), F.lit(state.config.filters - 1))).alias("filter_idx"), F.lit(0).cast("long").alias("bits_set"))
    return State(state.header.unionByName(header, allowMissingColumns=True), state.bloom, state.filter.unionByName(filters), state.hll, state.config)


def build_state(rows: DataFrame, cfg: BloomConfig) -> State:
    """Accepted lookups (ts, addr or ip, host, qtype, entity) -> the tables of every period."""
    regs = registers(rows, cfg)
    bloom = bitmaps(filter_tokens(rows, cfg), cfg)
    return State(header(rows, regs, cfg), bloom, bits_set(bloom), regs, cfg)


def combined(state: State, length: int = 86_400, parity: bool = False) -> State:
    """States rolled up to longer periods: bitmaps or-ed, registers merged, headers summed.

    A state belongs to the period in which it ends, the end of a period being the first instant of the next. States of
    different geometry fail.
    """
    def to(c: str) -> Column:
        return period_end(F.col(c), length)

    same = F.count_distinct(F.struct("number_of_filters", "number_of_bits_per_filter", "number_of_hashes"))
    h = state.header.groupBy(to("period_end").alias("period_end")).agg(
        F.min("period_begin").alias("period_begin"), F.min("first_request").alias("first_request"), F.max("last_request").alias("last_request"), F.sum("number_of_requests").alias("number_of_requests"),
        *[F.max(c).alias(c) for c in ("number_of_filters", "number_of_bits_per_filter", "number_of_hashes", "number_of_filters_per_user", "flatten_threshold", "major", "minor")],
        same.alias("geometries"),
    )
    h = h.filter(F.assert_true(F.col("geometries") == 1, F.lit("states of different geometry cannot be combined")).isNull()).drop("geometries")
    regs = hll.merged(state.hll.withColumn("period_end", to("period_end")), ["period_end", "kind"], parity)
    est = hll.estimated(regs, ["period_end", "kind"]).groupBy("period_end").pivot("kind", ["client", "host"]).agg(F.first("estimate"))
    h = h.join(est.withColumnsRenamed({"client": "est_clients", "host": "est_host_names"}), "period_end", "left")
    bloom = state.bloom.withColumn("period_end", to("period_end")).groupBy("period_end", "filter_idx", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return State(h, bloom, bits_set(bloom), regs, state.config)


def filter_info(state: State) -> DataFrame:
    """bits set, fill rate, false-positive rate and estimate of every filter."""
    cfg, b = state.config, F.col("bits_set")
    fill = fill_rate(b, cfg.bits)
    return state.filter.select("period_end", "filter_idx", "bits_set", F.round(fill, 10).alias("fill_rate"), F.round(actual_fpr(fill, cfg.hashes), 10).alias("actual_fpr"), approx_count(b, cfg.bits, cfg.hashes).alias("estimate"))


def fpr_alarm(state: State, level: float = FPR_ALARM) -> DataFrame:
    """Filters whose false-positive rate is above the level, once per period."""
    fill = fill_rate(F.col("bits_set"), state.config.bits)
    return state.filter.filter(actual_fpr(fill, state.config.hashes) > level).select("period_end", "filter_idx", "bits_set")


def persist(state: State, path: str, mode: str = "overwrite") -> None:
    """The tables as Parquet, partitioned by period; the commit protocol publishes each at once."""
    spark = state.header.sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for name in TABLES:
            getattr(state, name).repartition("period_end").write.mode(mode).partitionBy("period_end").parquet(f"{path}/{name}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def store(rows: DataFrame, cfg: BloomConfig, path: str) -> State:
    """Builds the state of the lookups and persists it; what is derived from registers and bitmaps is derived from the stored ones."""
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        regs = written(registers(rows, cfg), "registers")
        bloom = written(bitmaps(filter_tokens(rows, cfg), cfg), "bitmaps")
        persist(State(header(rows, regs, cfg), bloom, bits_set(bloom), regs, cfg), path)
    finally:
        rows.unpersist()
    return load(spark, path, cfg)


def load(spark: SparkSession, path: str, cfg: BloomConfig) -> State:
    """Stored states; a geometry other than cfg's fails."""
    t = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    other = t["header"].filter((F.col("number_of_bits_per_filter") != cfg.bits) | (F.col("number_of_filters") != cfg.filters) | (F.col("number_of_hashes") != cfg.hashes)).limit(1).count()
    if other:
        raise ValueError("the stored states have another geometry")
    return State(config=cfg, **t)


def fpr_history(state: State) -> DataFrame:
    """time, actfpr, fillrate of every filter, by the period's begin."""
    fill = fill_rate(F.col("bits_set"), state.config.bits)
    time = F.date_format("period_begin", "yyyy-MM-dd'T'HH:mm:ss").alias("time")
    return state.header.select("period_end", time).join(state.filter, "period_end").select("time", F.round(actual_fpr(fill, state.config.hashes), 10).alias("actfpr"), F.round(fill, 10).alias("fillrate"))


def file_day(name: Column) -> Column:
    """The day in a period's file name, as dd-MM-yyyy."""
    return F.date_format(F.to_timestamp(F.regexp_replace(name, r"\.hs$", ""), "yyyy-MM-dd'T'HH:mm:ss"), "dd-MM-yyyy")


def file_name(end: Column) -> Column:
    """UTC name of a period's file, by its end."""
    return F.concat(F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".hs"))
