"""Queries over inputs and outputs in their own formats, over stored states, IPv6 clients and restarted streams.

Files are made from the tables, written to the shared folder and read back.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsketch.functions import formulas, names
from dnsketch.functions.inet import endpoint, ipv4_text, packed, prefix
from dnsketch.model import SINGLE, TINY, BloomConfig
from dnsketch.operators import analyst, hll, search, sketch
from dnsketch.plans import oracle as o
from dnsketch.plans.registry import lookups, query, stored
from dnsketch.session import shared_folder
from dnsketch.sources import dims, dnslog, files, wire
from dnsketch.streaming import periods


def secs(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _secs(c: str) -> str:
    return f"floor(epoch({c}))::BIGINT"


def _lines(spark: SparkSession, line: F.Column, rows: DataFrame, name: str, **options) -> str:
    """Rows as lines of text files in a new folder."""
    path = shared_folder(spark, name)
    rows.select(line.alias("value")).write.options(**options).text(path)
    return path


# ---- CSV and log files


@query(o.with_(o.HOSTS, o.LOG, last=f"SELECT {_secs('ts')} AS ts, client, qtype AS type, regexp_replace(qname, '\\.+$', '') AS name FROM log WHERE event_id % 5 <> 0"))
def ground_truth_csv(spark, d):
    """Queries (kind Q(Q)) of a resolver's log in CSV; every fifth line is a response."""
    kind = F.when(F.col("event_id") % 5 == 0, "R(Q)").otherwise("Q(Q)")
    log = dnslog.dns_log(spark, d)
    got = files.ground_truth(spark, _lines(spark, F.concat_ws(", ", secs("ts").cast("string"), kind, "client", "qclass", "qtype", "qname"), log, "truth"))
    return got.withColumn("ts", secs("ts"))


@query(o.with_(o.HOSTS, o.LOG, last=f"SELECT {_secs('ts')} AS ts, client AS ip FROM log"))
def mail_log_lines(spark, d):
    log = dnslog.dns_log(spark, d)
    got = files.mail_log(spark, _lines(spark, F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), "client"), log, "mail"))
    return got.select(secs("ts").alias("ts"), "ip")


@query(o.with_(o.HOSTS, last="SELECT DISTINCT lower(host) AS value FROM hosts"))
def blacklist_csv(spark, d):
    """The first column of a CSV without a header, in any case, with repeats and blank lines."""
    h = dnslog.page_hosts(spark, d)
    path = _lines(spark, F.when(F.col("page_id") % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.upper("host"), F.lit(" ,x,y"))), h.union(h.withColumn("page_id", F.col("page_id") * 9 + 1)), "black")
    return files.first_column(spark, path)


@query(o.with_(o.PREFIXES, last="SELECT DISTINCT lower(entity) AS entity FROM prefixes"))
def entities_csv(spark, d):
    """The organisations of the definitions, written as entities_out is and read back."""
    path = shared_folder(spark, "entities")
    files.write_csv(dims.entities(spark, d).withColumn("n", F.lit(1)), path, header=False)
    return files.first_column(spark, path, "entity")


@query(o.with_(o.SECTORS, last="SELECT entity, sector FROM sectors"))
def sector_map_csv(spark, d):
    path = shared_folder(spark, "sectors")
    files.write_csv(dims.sectors(spark, d).toDF("organisation", "code"), path)
    return files.sector_map(spark, path, "organisation", "code")


@query(o.with_(o.PREFIXES, last="SELECT entity, ((net // 16777216) % 256) || '.' || ((net // 65536) % 256) || '.0.0' AS ip, plen::INT AS plen FROM prefixes"))
def customers_csv(spark, d):
    """Prefixes of customers in a sheet, parsed."""
    path = shared_folder(spark, "customers")
    rows = dims.entity_prefixes(spark, d).select("entity", F.concat_ws("/", ipv4_text(F.col("net")), F.col("plen").cast("string")).alias("prefix"))
    files.write_csv(rows, path)
    got = files.customers(spark, path, "prefix", "entity").withColumn("p", prefix(F.col("prefix")))
    return got.select("entity", ipv4_text(F.shiftrightunsigned("p.hi", 32)).alias("ip"), F.col("p.plen").alias("plen"))


@query("SELECT * FROM (VALUES ('bits', 8388608), ('filters', 6), ('flatten', 0), ('hashes', 5), ('per_user', 3), ('period', 86400)) t(name, value)")
def config_file(spark, d):
    """A configuration with an included folder and comments; such files are read by the driver alone."""
    with tempfile.TemporaryDirectory() as top:
        os.mkdir(f"{top}/more")
        for name, text in (("more/a.conf", "number_of_hashes 4\n"), ("more/b.conf", "number_of_hashes 5 # five\n"), ("main.conf", "; main\nperiod_length 86400\nnumber_of_bits_per_filter 8388608\nnumber_of_filters 6\nnumber_of_filters_per_user 3\ninclude more\ninclude gone if_exist\n")):
            with open(f"{top}/{name}", "w") as f:
                f.write(text)
        cfg = files.bloom_config(files.config(f"{top}/main.conf"))
    return spark.createDataFrame([(k, getattr(cfg, k)) for k in files.CONFIG_KEYS.values()], "name string, value int")


_PER_DAY = "SELECT strftime(period_end, '%Y-%m-%d') AS day, count(DISTINCT host)::INT AS inside, count(*)::INT AS total FROM acc GROUP BY period_end"


@query(o.with_(*o.BASE, last=_PER_DAY))
def experiment_csv(spark, d):
    """Statistics of an experiment's log as day, inside, total: parsed, written as CSV and read back."""
    rows = lookups(spark, d).groupBy(sketch.period_end(F.col("ts"), 86_400).alias("p")).agg(F.count_distinct("host").alias("inside"), F.count(F.lit(1)).alias("total"))
    text = F.concat(F.lit("Statistics for "), F.date_format("p", "yyyy-MM-dd"), F.lit(".hs.json:\n  found [ "), "inside", F.lit(" / "), "total", F.lit(" ]\nother line"))
    one = rows.agg(F.concat_ws("\n", F.array_sort(F.collect_list(text))).alias("value"))
    path = shared_folder(spark, "experiment")
    files.write_csv(files.experiment_log(one), path)
    return spark.read.csv(path, header=True, schema="day string, inside int, total int")


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(TINY), last=f"SELECT strftime(a, '%Y-%m-%dT%H:%M:%S') AS time, round(pow(n::DOUBLE / {TINY.bits}, {TINY.hashes}), 10) AS actfpr, round(n::DOUBLE / {TINY.bits}, 10) AS fillrate FROM (SELECT period_end, filter_idx, count(*) AS n FROM fb GROUP BY ALL) JOIN (SELECT period_end, min(ts) AS a FROM acc GROUP BY 1) USING (period_end)"))
def fpr_history_csv(spark, d):
    path = shared_folder(spark, "fpr")
    files.write_csv(sketch.fpr_history(stored(spark, d, TINY)), path)
    return spark.read.csv(path, header=True, schema="time string, actfpr double, fillrate double")


@query(o.with_(*o.BASE, o.SECTORS, last="SELECT sector, count(*) AS count FROM (SELECT DISTINCT entity, host FROM acc WHERE entity IS NOT NULL) JOIN sectors USING (entity) GROUP BY sector"))
def sector_counts_csv(spark, d):
    """sector,count of hosts looked up by organisations, written as CSV and read back."""
    c = lookups(spark, d).filter("entity is not null").select("entity", "host").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("hits"))
    path = shared_folder(spark, "sector_counts")
    files.write_csv(analyst.by_sector(c, dims.sectors(spark, d)), path)
    return spark.read.csv(path, header=True, schema="sector string, count long")


@query(o.with_(o.HOSTS, last="SELECT lower(host) AS name, count(*) AS n FROM hosts GROUP BY 1"))
def blacklist_occurrences(spark, d):
    return analyst.occurrences(dnslog.page_hosts(spark, d).select(F.lower("host").alias("name")))


@query(o.with_(o.HOSTS, o.LOG, last=f"SELECT {_secs('ts')} AS ts, client, regexp_replace(qname, '\\.$', '') AS qname FROM log"))
def text_log_gzip(spark, d):
    """A compressed text log with comments and broken lines."""
    log = dnslog.dns_log(spark, d)
    line = F.concat_ws(" ", secs("ts").cast("string"), "client", F.concat(F.regexp_replace("qname", r"\.$", ""), F.lit("./1/1")))
    more = F.when(F.col("event_id") % 7 == 0, F.concat(line, F.lit("\n# comment\nbroken line"))).otherwise(line)
    return dnslog.text_log(spark, _lines(spark, more, log, "log", compression="gzip")).select(secs("ts").alias("ts"), "client", "qname")


@query(o.with_(o.HOSTS, o.LOG, last=f"SELECT {_secs('ts')} AS ts, client, regexp_replace(qname, '\\.$', '') || '.' AS qname FROM log WHERE event_id % 10 <> 3"))
def dnstap_guard(spark, d):
    """Frames that are too long, or are no message, are left out."""
    import pyarrow as pa

    def encoded(batches):
        for b in batches:
            f = [wire.encode_frame(*r[1:]) if r[0] % 10 != 3 else (b"x" * (wire.LARGEST_FRAME + 1) if r[0] % 1000 == 3 else b"\xff\xff") for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([wire.encode_stream(f)], pa.binary())], names=["content"])

    rows = dnslog.dns_log(spark, d).select("event_id", secs("ts").alias("ts"), "client", "qname", "qtype", "qclass")
    return dnslog.client_query(wire.decode_streams(rows.mapInArrow(encoded, "content binary"))).select("ts", "client", "qname")


# ---- parsing and formulas


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 AND user_id BETWEEN 10 AND 900 THEN user_id END AS n FROM events")
def strict_numbers(spark, d):
    """Digits only, within a range: signs, blanks, words and numbers out of range are none."""
    r = F.col("event_id") % 4
    u = F.col("user_id").cast("string")
    text = F.when(r == 0, u).when(r == 1, F.concat(F.lit("000"), u)).when(r == 2, F.concat(F.lit("+"), u)).otherwise(F.concat(u, F.lit(" x")))
    return dnslog.table(spark, d, "events").select("event_id", names.whole_number(text, 10, 900).alias("n"))


_ENDS = (("1.2.3.4", "1.2.3.4", None), ("1.2.3.4:53", "1.2.3.4", 53), ("[2001:DB8::1]", "2001:db8::1", None), ("[2001:db8:0::1]:8053", "2001:db8::1", 8053), ("*:53", "*", 53))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{a}', {p or 'NULL'})" for t, a, p in _ENDS) + ") t(text, address, port)")
def endpoints(spark, d):
    return spark.createDataFrame([(t, *endpoint(t)) for t, _, _ in _ENDS], "text string, address string, port int")


@query("SELECT p_partkey AS n, pow(1 - exp(-floor(10.0::DOUBLE * p_partkey / 4096)), 10) AS fpr FROM part")
def theoretical_fpr(spark, d):
    p = dnslog.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("n"), formulas.theoretical_fpr(F.lit(10), F.col("p_partkey"), F.lit(4096)).alias("fpr"))


@query("SELECT s_name AS name, s_suppkey AS modified FROM supplier ORDER BY s_suppkey DESC, s_name LIMIT 2")
def latest_two(spark, d):
    return analyst.latest(dnslog.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("modified")))


@query(o.with_(*o.BASE, last="SELECT DISTINCT strftime(period_end, '%Y-%m-%dT%H:%M:%S') || '.hs' AS file, strftime(period_end, '%d-%m-%Y') AS day FROM acc"))
def file_days(spark, d):
    f = stored(spark, d, SINGLE).header.select(sketch.file_name(F.col("period_end")).alias("file"))
    return f.select("file", sketch.file_day(F.col("file")).alias("day"))


# ---- stored states


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(SINGLE), last=f"SELECT row_number() OVER (ORDER BY period_end) AS nth, {_secs('period_end')} AS period_end, bits_set, n AS number_of_requests FROM (SELECT period_end, count(*) AS bits_set FROM fb GROUP BY 1) JOIN (SELECT period_end, count(*) AS n FROM acc GROUP BY 1) USING (period_end)"))
def stored_states(spark, d):
    """States laid down in files and read back, in order of time (one row a state)."""
    s = stored(spark, d, SINGLE)
    nth = F.row_number().over(Window.orderBy("period_end")).cast("long")
    return s.header.join(s.filter, "period_end").select(nth.alias("nth"), secs("period_end").alias("period_end"), "bits_set", "number_of_requests")


_ALL_HOURS = f"SELECT {_secs('t')} AS period_end, coalesce(n, 0) AS number_of_requests FROM (SELECT unnest(generate_series(min(period_end), max(period_end), INTERVAL 1 DAY)) AS t FROM (SELECT period_end FROM acc UNION ALL SELECT max(period_end) + INTERVAL 3 DAY FROM acc)) LEFT JOIN (SELECT period_end, count(*) AS n FROM acc GROUP BY 1) ON period_end = t"


@query(o.with_(*o.BASE, last=_ALL_HOURS))
def empty_states(spark, d):
    """Periods without a lookup have an empty state."""
    s = stored(spark, d, SINGLE)
    ends = s.header.agg(F.sequence(F.min("period_end"), F.max("period_end") + F.expr("interval 3 days"), F.expr("interval 1 day")).alias("e")).select(F.explode("e").alias("period_end"))
    e = sketch.with_empty(s, ends)
    return e.header.join(e.filter, "period_end").select(secs("period_end").alias("period_end"), "number_of_requests")


_FIRST_GROUP = f"""f AS (SELECT period_end, g, key, mask FROM hit WHERE mask <> 0), g1 AS (SELECT period_end, min(g) AS g FROM f GROUP BY 1),
req AS (SELECT period_end, {_secs('min(ts)')} AS first_request, {_secs('max(ts)')} AS last_request FROM acc GROUP BY 1)"""


def _result_sql() -> str:
    from dnsketch.plans import catalogue as c

    return o.with_(*c._TF, c._JOB, "ask AS (SELECT DISTINCT hex FROM job)", o.found_cte(TINY), c._HIT, _FIRST_GROUP, last="SELECT first_request, last_request, key AS host FROM f JOIN g1 USING (period_end, g) JOIN req USING (period_end)")


def result_files(spark, d):
    """Results in JSON, a folder per state, read back: the hosts of the first group with hits."""
    from dnsketch.plans import catalogue

    path = shared_folder(spark, "results")
    files.write_results(search.results(catalogue._jobs(spark, d), stored(spark, d, TINY)), path)
    return files.result_hosts(spark.read.text(path))


# ---- IPv6 clients: every third user has one

_SIX = f"""six AS (SELECT event_id, ts, {"CASE WHEN event_id % 3 = 0 THEN '2001:db8:0:' || ((ip % 7) + 1) || '::' || ((ip % 9) + 1) ELSE client END"} AS client6, event_id % 3 = 0 AS is6, (ip % 7) + 1 AS a, (ip % 9) + 1 AS b, ip, o, qtype, host FROM acc0),
defs AS (SELECT 'SIX' AS entity, 32 AS plen, 0 AS k UNION ALL SELECT 'NET' || range, 64, range FROM range(2, 8, 2)),
ent6 AS (SELECT client6, max_by(entity, plen) AS entity FROM (SELECT DISTINCT client6, a FROM six WHERE is6) JOIN defs ON plen = 32 OR k = a GROUP BY 1)"""


def _murmur16() -> str:
    """MurmurHash64A of the 16 address bytes, step by step."""
    mul = lambda x: f"CAST((({x})::UHUGEINT * {o.M64}::UHUGEINT) % {o.TWO64}::UHUGEINT AS UBIGINT)"
    start = o.MURMUR_SEED ^ (16 * int(o.M64) % (1 << 64))
    word0 = "((184::UBIGINT << 24) | (13 << 16) | (1 << 8) | 32 | (a::UBIGINT << 56))"
    return f"""m0 AS (SELECT DISTINCT client6, a, b FROM six WHERE is6),
m1 AS (SELECT client6, b, {mul(word0)} AS k FROM m0), m2 AS (SELECT client6, b, {mul('xor(k, k >> 47)')} AS k FROM m1), m3 AS (SELECT client6, b, {mul(f'xor({start}::UBIGINT, k)')} AS h FROM m2),
m4 AS (SELECT client6, h, {mul('b::UBIGINT << 56')} AS k FROM m3), m5 AS (SELECT client6, h, {mul('xor(k, k >> 47)')} AS k FROM m4), m6 AS (SELECT client6, {mul('xor(h, k)')} AS h FROM m5),
m7 AS (SELECT client6, {mul('xor(h, h >> 47)')} AS h FROM m6), murmur6 AS (SELECT client6, xor(h, h >> 47) AS h FROM m7),
murmur4 AS (SELECT client6, {o.murmur('o')} AS h FROM (SELECT DISTINCT client6, o FROM six WHERE NOT is6)), murmurs AS (SELECT * FROM murmur6 UNION ALL SELECT * FROM murmur4)"""


def _mixed_log(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    log = dnslog.dns_log(spark, d, events)
    six = F.concat(F.lit("2001:db8:0:"), F.col("ip") % 7 + 1, F.lit("::"), F.col("ip") % 9 + 1)
    return log.withColumn("client", F.when(F.col("event_id") % 3 == 0, six).otherwise(F.col("client")))


def _definitions(spark: SparkSession) -> DataFrame:
    text = '{"subnet_activity":[{"entity":"SIX","prefixes":[{"2001:db8::":32}]},' + ",".join(f'{{"entity":"NET{k}","prefixes":[{{"2001:db8:0:{k}::":64}}]}}' for k in (2, 4, 6)) + "]}"
    return files.subnet_definitions(spark.createDataFrame([(text,)], "value string"))


_V = (o.HOSTS, o.LOG, o.ACCEPTED, _SIX, _murmur16())


@query(o.with_(*_V, last="SELECT client6 AS client, entity, h::HUGEINT::VARCHAR AS h, (h % 6)::BIGINT AS combo FROM (SELECT DISTINCT client6 FROM six) LEFT JOIN ent6 USING (client6) JOIN murmurs USING (client6)"))
def ipv6_clients(spark, d):
    """Organisation, Murmur hash and filter subset of clients of both families."""
    rows = dnslog.any_lookups(_mixed_log(spark, d), _definitions(spark))
    h = F.col("client_hash")
    c = rows.select("client", "addr", "entity").distinct().join(sketch.client_filters(rows, TINY), "addr")
    return c.select("client", "entity", F.conv(F.hex(h), 16, 10).alias("h"), sketch.unsigned_mod(h, 6).cast("long").alias("combo"))


_ACC6 = "acc AS (SELECT event_id, ts, client6 AS client, ip, qtype, host, coalesce(entity, 'UNKNOWN') AS ent, date_trunc('day', ts) + INTERVAL 1 DAY AS period_end FROM six LEFT JOIN ent6 USING (client6))"
_REGS6 = "regs AS (SELECT period_end, (h % 16384)::INT AS reg, max(1 + CASE WHEN (h >> 14) = 0 THEN 49 ELSE least(49, bit_count((xor((h >> 14), (h >> 14) - 1) >> 1)::BIGINT)) END)::INT AS rank FROM (SELECT DISTINCT period_end, h FROM acc JOIN murmurs ON client6 = client) GROUP BY ALL)"
_STATE6 = f"SELECT {_secs('period_end')} AS period_end, count(*) AS bits_set, any_value(n) AS number_of_requests, any_value(estimate) AS est_clients FROM fb JOIN (SELECT period_end, count(*) AS n FROM acc GROUP BY 1) USING (period_end) JOIN (" + o.hll_estimate("regs", "period_end") + ") USING (period_end) GROUP BY period_end"


@query(o.with_(*_V, _ACC6, o.TOKENS, o.bits_cte(SINGLE), _REGS6, last=_STATE6))
def stream_dnstap_state(spark, d):
    """From frames to states: a stream of dnstap frame streams of clients of both families, sketched batch by batch."""
    import pyarrow as pa

    def encoded(batches):
        for b in batches:
            f = [wire.encode_frame(*r) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([wire.encode_stream(f)], pa.binary())], names=["content"])

    taps, path = shared_folder(spark, "taps"), shared_folder(spark, "stream")
    rows = _mixed_log(spark, d).select(secs("ts").alias("ts"), "client", "qname", "qtype", "qclass").repartition(3)
    rows.mapInArrow(encoded, "content binary").write.parquet(taps)
    stream = wire.decode_streams(spark.readStream.schema("content binary").option("maxFilesPerTrigger", 1).parquet(taps))
    found = lambda b: dnslog.any_lookups(b.withColumn("ts", F.timestamp_seconds("ts")), _definitions(spark))
    periods.run_periods(stream, SINGLE, path, found).awaitTermination()
    s = periods.periods(spark, path, SINGLE)
    return s.header.join(s.filter, "period_end").select(secs("period_end").alias("period_end"), "bits_set", "number_of_requests", "est_clients")


_DAY_BITS = f"SELECT {_secs('period_end')} AS period_end, count(*) AS bits_set, any_value(n) AS number_of_requests FROM fb JOIN (SELECT period_end, count(*) AS n FROM acc GROUP BY 1) USING (period_end) GROUP BY period_end"


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(SINGLE), last=_DAY_BITS))
def stream_restart(spark, d):
    """A stream that is stopped and resumed, with rows as late as its whole time, its parts merged in between: the same as one batch."""
    folder, path = shared_folder(spark, "events"), shared_folder(spark, "stream")
    events, prefixes = dnslog.table(spark, d, "events"), dims.entity_prefixes(spark, d)
    for k in (2, 0, 1):  # every run finds one more file, which spans the whole time
        events.filter(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        stream = dnslog.dns_log(spark, d, periods.events_stream(spark, folder))
        periods.run_periods(stream, SINGLE, path, lambda b: dnslog.lookups(b, prefixes)).awaitTermination()
    periods.compact(spark, path, SINGLE)
    s = periods.periods(spark, path, SINGLE)
    return s.header.join(s.filter, "period_end").select(secs("period_end").alias("period_end"), "bits_set", "number_of_requests")


def late(add) -> None:
    """Queries whose SQL needs pieces of the catalogue, which imports this module."""
    add(_result_sql())(result_files)
