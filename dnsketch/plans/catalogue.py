"""The catalogue of queries: name -> DataFrame over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.functions import bits, formulas, names
from dnsketch.functions.hashing import offsets_udf
from dnsketch.model import SINGLE, TINY, BloomConfig, lookup_combination
from dnsketch.operators import analyst, hll, metrics, search, sketch
from dnsketch.operators.lpm import client_entities
from dnsketch.plans import oracle as o
from dnsketch.plans.registry import QUERIES, SQL, query, stored
from dnsketch.sources import dims, dnslog, wire
from dnsketch.sources.dnslog import token_rows
from dnsketch.session import shared_folder
from dnsketch.streaming import periods

def _log(spark, d):
    return dnslog.dns_log(spark, d)


def _lookups(spark, d):
    return dnslog.lookups(_log(spark, d), dims.entity_prefixes(spark, d))


def _state(spark, d, cfg: BloomConfig) -> sketch.State:
    return sketch.build_state(_lookups(spark, d), cfg)


def _secs(c: str) -> str:
    return f"floor(epoch({c}))::BIGINT"


def secs(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- names, tokens, hashes


@query(o.with_(*o.BASE, o.TOKENS, last="SELECT token, count(*) AS n FROM tok GROUP BY token"))
def token_extract(spark, d):
    """Tokens of all accepted lookups with their number."""
    return token_rows(_lookups(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(o.with_(*o.BASE, o.TOKENS, last="SELECT DISTINCT token, sha256(token) AS sha FROM tok"))
def token_sha256(spark, d):
    return token_rows(_lookups(spark, d)).select("token").distinct().withColumn("sha", F.sha2("token", 256))


@query(o.with_(*o.BASE, o.token_cte("pt", "client", "(SELECT * FROM acc WHERE qtype = 'PTR')"), last="SELECT DISTINCT client, token FROM pt"))
def ptr_tokens(spark, d):
    """PTR lookups give the pointer and its tagged form only."""
    return token_rows(_lookups(spark, d).filter("qtype = 'PTR'")).select("client", "token").distinct()


@query(o.with_(o.HOSTS, o.LOG, last="SELECT DISTINCT client, o[4] || '.' || o[3] || '.' || o[2] || '.' || o[1] || '.in-addr.arpa' AS pointer FROM log"))
def reverse_pointers(spark, d):
    return _log(spark, d).select("client").distinct().withColumn("pointer", names.reverse_pointer(F.col("client")))


@query(o.with_(o.HOSTS, last="SELECT host, array_to_string(l[i:], '.') AS suffix FROM (SELECT host, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM (SELECT DISTINCT host FROM hosts))"))
def suffix_enumeration(spark, d):
    return dnslog.page_hosts(spark, d).select("host").distinct().select("host", F.explode(names.suffixes(F.col("host"))).alias("suffix"))


@query(o.with_(o.HOSTS, o.LOG, last="SELECT event_id, regexp_replace(qname, '\\.+$', '') AS name, lower(regexp_replace(qname, '\\.$', '')) AS host FROM log"))
def host_normalise(spark, d):
    return _log(spark, d).select("event_id", names.evaluated("qname").alias("name"), names.normalised("qname").alias("host"))


@query(o.with_(*o.BASE, o.TOKENS, "ft AS (SELECT DISTINCT sha256(token) AS hex, 0 AS f FROM tok)", o.offsets_cte("offs", "ft", SINGLE), last="SELECT hex, i, offs[i] AS off FROM (SELECT hex, offs, unnest(range(1, 11)) AS i FROM offs)"))
def bloom_offsets(spark, d):
    """The ten offsets of every distinct token, bit for bit."""
    t = token_rows(_lookups(spark, d)).select("token").distinct().select(F.sha2("token", 256).alias("hex"))
    return t.select("hex", F.posexplode(offsets_udf(SINGLE.bits, SINGLE.hashes)("hex", F.lit(0))).alias("i", "off")).withColumn("i", (F.col("i") + 1).cast("long"))


@query(o.with_(*o.BASE, o.CLIENTS, last="SELECT ip, h::HUGEINT::VARCHAR AS h, (h % 6)::BIGINT AS combo FROM clients"))
def client_combos(spark, d):
    """Murmur hash of each client (as unsigned text) and the number of its filter subset."""
    c = sketch.client_filters(_lookups(spark, d), TINY)
    h = F.col("client_hash")
    return c.select("ip", F.conv(F.hex(h), 16, 10).alias("h"), sketch.unsigned_mod(h, 6).cast("long").alias("combo"))


@query("SELECT i, a, b FROM (SELECT row_number() OVER (ORDER BY a, b) - 1 AS i, a, b FROM (SELECT a.range AS a, b.range AS b FROM range(7) a, range(7) b WHERE a.range < b.range))")
def combination_table(spark, d):
    """The 21 pairs of 7 filters in order, by rank."""
    rows = [(i, *lookup_combination(7, 2, i)) for i in range(21)]
    return spark.createDataFrame(rows, "i long, a long, b long")


# ---- filters, counters, windows


@query(o.with_(o.HOSTS, o.LOG, last="SELECT qtype, qclass, count(*) AS n, count(*) FILTER (qclass = 'IN' AND qtype IN ('A','NS','MX','AAAA','PTR')) AS accepted FROM log GROUP BY qtype, qclass"))
def type_filter_histogram(spark, d):
    return _log(spark, d).groupBy("qtype", "qclass").agg(F.count(F.lit(1)).alias("n"), F.count_if(dnslog.accepted()).alias("accepted"))


_COUNT = """SELECT epoch(date_trunc('minute', ts))::BIGINT AS minute, count(*) AS n_proc, count(*) FILTER (ok) AS n_acc, 0::BIGINT AS n_skip, count(*) // 60 AS n_qsec,
  count(*) FILTER (ok AND qtype = 'A') AS n_qa, count(*) FILTER (ok AND qtype = 'AAAA') AS n_qaaaa, count(*) FILTER (ok AND qtype = 'NS') AS n_qns, count(*) FILTER (ok AND qtype = 'MX') AS n_qmx, count(*) FILTER (ok AND qtype = 'PTR') AS n_qptr,
  count(*) FILTER (ok AND entity IS NOT NULL) AS n_qcat, count(*) FILTER (ok AND entity IS NULL) AS n_qncat, 0::BIGINT AS n_invfrm
  FROM (SELECT log.*, entity, qclass = 'IN' AND qtype IN ('A','NS','MX','AAAA','PTR') AS ok FROM log LEFT JOIN lpm USING (ip)) GROUP BY 1"""


@query(o.with_(o.HOSTS, o.LOG, o.PREFIXES, o.ENTITY, last=_COUNT))
def instrument_minutely(spark, d):
    c = metrics.counters(_log(spark, d), dims.entity_prefixes(spark, d), F.window("ts", "60 seconds")["start"])
    return c.select(secs("window_start").alias("minute"), *[F.col(x) for x in c.columns[1:]])


@query(o.with_(o.HOSTS, o.LOG, o.PREFIXES, o.ENTITY, last="SELECT client, coalesce(entity, 'UNKNOWN') AS entity FROM cl LEFT JOIN lpm USING (ip)"))
def lpm_entity(spark, d):
    """The organisation of every client."""
    log = _log(spark, d).select("ip", "client").distinct()
    return log.join(client_entities(log, dims.entity_prefixes(spark, d)), "ip", "left").select("client", names.entity_or_unknown(F.col("entity")).alias("entity"))


@query(o.with_(*o.BASE, last="SELECT event_id, qtype FROM acc WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"))
def time_range(spark, d):
    """Accepted lookups of an inclusive range of time."""
    return _lookups(spark, d).filter(F.col("ts").between("2024-01-05", "2024-01-10")).select("event_id", "qtype")


# ---- sketches


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(SINGLE), last=f"SELECT {_secs('period_end')} AS period_end, count(*) AS bits_set FROM fb GROUP BY period_end"))
def bloom_bits_set(spark, d):
    """Set bits of each day's filter."""
    b = sketch.bits_set(sketch.bitmaps(sketch.filter_tokens(_lookups(spark, d), SINGLE), SINGLE))
    return b.select(secs("period_end").alias("period_end"), "bits_set")


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(TINY), last=f"SELECT {_secs('period_end')} AS period_end, filter_idx, count(*) AS bits_set FROM fb GROUP BY period_end, filter_idx"))
def bloom_multi_filter(spark, d):
    """Four small filters, two of them per client."""
    b = sketch.bits_set(sketch.bitmaps(sketch.filter_tokens(_lookups(spark, d), TINY), TINY))
    return b.select(secs("period_end").alias("period_end"), "filter_idx", "bits_set")


def _info(cfg: BloomConfig) -> str:
    x = "bits_set"
    return f"SELECT {_secs('period_end')} AS period_end, filter_idx, bits_set, round(bits_set::DOUBLE / {cfg.bits}, 10) AS fill_rate, round(pow(bits_set::DOUBLE / {cfg.bits}, {cfg.hashes}), 10) AS actual_fpr, {o.estimate(x, cfg)} AS estimate FROM (SELECT period_end, filter_idx, count(*) AS bits_set FROM fb GROUP BY period_end, filter_idx)"


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(TINY), last=_info(TINY)))
def bloom_estimates(spark, d):
    s = sketch.filter_info(_state(spark, d, TINY))
    return s.withColumn("period_end", secs("period_end"))


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(TINY), last=f"SELECT {_secs('period_end')} AS period_end, filter_idx, bits_set FROM (SELECT period_end, filter_idx, count(*) AS bits_set FROM fb GROUP BY ALL) WHERE pow(bits_set::DOUBLE / {TINY.bits}, {TINY.hashes}) > 0.001"))
def fpr_alarm(spark, d):
    return sketch.fpr_alarm(_state(spark, d, TINY)).withColumn("period_end", secs("period_end"))


_HEADER = f"""SELECT {_secs('period_end')} AS period_end, {_secs('min(ts)')} AS first_request, {_secs('max(ts)')} AS last_request, count(*) AS number_of_requests FROM acc GROUP BY period_end"""


@query(o.with_(*o.BASE, last=_HEADER))
def state_header(spark, d):
    h = _state(spark, d, SINGLE).header
    return h.select(*[secs(c).alias(c) for c in ("period_end", "first_request", "last_request")], "number_of_requests")


@query(o.with_(*o.BASE, last=f"SELECT {_secs('period_end')} AS period_end, count(DISTINCT ip) AS clients FROM acc GROUP BY period_end"))
def distinct_clients_exact(spark, d):
    r = _lookups(spark, d).select(sketch.period_end(F.col("ts"), 86_400).alias("period_end"), "ip").distinct()
    return r.groupBy("period_end").agg(F.count(F.lit(1)).alias("clients")).withColumn("period_end", secs("period_end"))


@query(o.with_(*o.BASE, o.TOKENS, o.CLIENTS, o.REGS, last=f"SELECT {_secs('period_end')} AS period_end, kind, reg, rank FROM regs"))
def hll_registers(spark, d):
    """All used registers of clients and tokens of each day."""
    return sketch.registers(_lookups(spark, d), SINGLE).withColumn("period_end", secs("period_end"))


@query(o.with_(*o.BASE, o.TOKENS, o.CLIENTS, o.REGS, last=o.hll_estimate("(SELECT epoch(period_end)::BIGINT AS period_end, kind, reg, rank FROM regs)", "period_end, kind")))
def hll_estimate(spark, d):
    e = hll.estimated(sketch.registers(_lookups(spark, d), SINGLE), ["period_end", "kind"])
    return e.withColumn("period_end", secs("period_end"))


@query(o.with_(*o.BASE, o.TOKENS, o.CLIENTS, o.REGS, last=o.hll_estimate("(SELECT kind, reg, max(rank) AS rank FROM regs GROUP BY kind, reg)", "kind")))
def hll_union(spark, d):
    """Days merged to one sketch by the maximum of each register."""
    return hll.estimated(hll.merged(sketch.registers(_lookups(spark, d), SINGLE), ["kind"]), ["kind"])


@query(o.with_(*o.BASE, o.TOKENS, o.CLIENTS, o.REGS, last=o.hll_estimate("(SELECT kind, reg, bit_or(rank) AS rank FROM regs GROUP BY kind, reg)", "kind")))
def hll_union_parity(spark, d):
    """The same by the bitwise or, the overestimating merge that stored sketches of the older system have."""
    return hll.estimated(hll.merged(sketch.registers(_lookups(spark, d), SINGLE), ["kind"], parity=True), ["kind"])


@query(o.with_(*o.BASE, o.TOKENS, last=f"SELECT {_secs('period_end')} AS period_end, count(DISTINCT token) AS tokens, true AS close FROM tok GROUP BY period_end"))
def hll_native(spark, d):
    """Spark's own sketch at the same precision (another hash): whether it is within 3 % of the exact number, four standard errors."""
    t = token_rows(_lookups(spark, d)).select(sketch.period_end(F.col("ts"), 86_400).alias("period_end"), "token").distinct()
    n = t.groupBy("period_end").agg(F.count(F.lit(1)).alias("tokens")).join(hll.native(t, ["period_end"], "token"), "period_end")
    return n.select(secs("period_end").alias("period_end"), "tokens", (F.abs(F.col("estimate") - F.col("tokens")) <= 0.03 * F.col("tokens") + 1).alias("close"))


# ---- roll-up and reports

HOURLY = BloomConfig(1, 65_536, 4, 1, 3_600)
_HOUR = "hr AS (SELECT * REPLACE (date_trunc('hour', ts) + INTERVAL 1 HOUR AS period_end) FROM acc)"
_DAY_OF = "(date_trunc('day', period_end) + INTERVAL 1 DAY)"  # an hour that ends at midnight belongs to the next day


@query(o.with_(*o.BASE, _HOUR, o.token_cte("tok", "period_end, ip", "hr"), "dt AS (SELECT " + _DAY_OF + " AS period_end, ip, token FROM tok)",
    o.bits_cte(HOURLY).replace("FROM tok", "FROM dt"), f"h AS (SELECT {_DAY_OF} AS d, min(ts) AS a, max(ts) AS z, count(*) AS n FROM hr GROUP BY 1)",
    last=f"SELECT {_secs('d')} AS period_end, {_secs('a')} AS first_request, {_secs('z')} AS last_request, n AS number_of_requests, count(*) AS bits_set FROM h JOIN fb ON d = period_end GROUP BY ALL"))
def combine_daily(spark, d):
    """Hourly states combined to days: bitmaps or-ed, requests summed once."""
    s = sketch.combined(_state(spark, d, HOURLY))
    return s.header.join(s.filter, "period_end").select(*[secs(c).alias(c) for c in ("period_end", "first_request", "last_request")], "number_of_requests", "bits_set")


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(SINGLE), last=f"SELECT {_secs('a')} AS period_begin, {o.estimate('b', SINGLE)} AS estimate FROM (SELECT period_end, count(*) AS b FROM fb GROUP BY 1) JOIN (SELECT period_end, min(ts) AS a FROM acc GROUP BY 1) USING (period_end)"))
def plot_csv(spark, d):
    s = _state(spark, d, SINGLE)
    return s.header.join(sketch.filter_info(s), "period_end").select(secs("period_begin").alias("period_begin"), "estimate")


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(SINGLE), last=f"SELECT strftime(period_end, '%Y-%m-%dT%H:%M:%S') || '.hs' AS file, 'bits set ' || b || ', fill rate ' || printf('%.10f', b::DOUBLE / {SINGLE.bits}) || ', estimated host names ' || {o.estimate('b', SINGLE)} AS line FROM (SELECT period_end, count(*) AS b FROM fb GROUP BY 1)"))
def info_report(spark, d):
    """One line of the report for every filter."""
    i = sketch.filter_info(_state(spark, d, SINGLE))
    line = F.concat(F.lit("bits set "), F.col("bits_set"), F.lit(", fill rate "), F.format_string("%.10f", formulas.fill_rate(F.col("bits_set"), SINGLE.bits)), F.lit(", estimated host names "), F.col("estimate"))
    return i.select(sketch.file_name(F.col("period_end")).alias("file"), line.alias("line"))


@query(o.with_(*o.BASE, _HOUR, last=f"SELECT {_secs('day')} AS day, states, states >= 24 AS complete FROM (SELECT date_trunc('day', period_end) AS day, count(*) AS states FROM (SELECT DISTINCT period_end FROM hr) GROUP BY 1)"))
def day_completeness(spark, d):
    """Days with all 24 hourly states."""
    p = _lookups(spark, d).select(sketch.period_end(F.col("ts"), 3_600).alias("period_end")).distinct()
    c = analyst.complete_days(p, 3_600)
    return c.select(secs(F.col("day").cast("timestamp")).alias("day"), "states", "complete")


@query(o.with_(*o.BASE, last=f"SELECT DISTINCT {_secs('period_end')} AS period_end FROM acc WHERE day(period_end) % 3 <> 0"))
def pending_states(spark, d):
    """States without a result (here every third day has one)."""
    p = _lookups(spark, d).select(sketch.period_end(F.col("ts"), 86_400).alias("period_end")).distinct()
    return analyst.pending(p, p.filter(F.dayofmonth("period_end") % 3 == 0)).select(secs("period_end").alias("period_end"))


# ---- sizing


_DRY = """d AS (SELECT date_trunc('hour', ts) AS w, token FROM (SELECT ts, unnest(list_concat([host], CASE WHEN qtype = 'PTR' THEN [] ELSE list_append(l[1:n-1], CASE WHEN n > 1 THEN l[n-1] || '.' || l[n] ELSE '' END) END)) AS token FROM (SELECT *, string_split(host, '.') AS l, len(string_split(host, '.')) AS n FROM acc)))"""


@query(o.with_(*o.BASE, _DRY, last=f"SELECT {_secs('w')} AS window_start, count(DISTINCT token) AS n FROM d GROUP BY w"))
def dryrun_hourly(spark, d):
    return metrics.distinct_tokens(_lookups(spark, d), 3_600).withColumn("window_start", secs("window_start"))


_ADVICE = """SELECT n, one_in::BIGINT AS one_in, floor(m * 1.1::DOUBLE)::BIGINT AS m, ceil((m // n) * ln(2))::BIGINT AS k FROM (
  SELECT n, one_in, (ceil(trunc(-(n * ln(1.0::DOUBLE / one_in)) / (ln(2) * ln(2))) / 100000) * 100000)::BIGINT AS m FROM (SELECT max(c) AS n FROM (SELECT count(DISTINCT token) AS c FROM d GROUP BY w)), (SELECT unnest([1000, 10000, 100000]) AS one_in))"""


@query(o.with_(*o.BASE, _DRY, last=_ADVICE))
def dryrun_advice(spark, d):
    """Sizes for the busiest hour."""
    return metrics.advice(metrics.distinct_tokens(_lookups(spark, d), 3_600).agg(F.max("n").alias("n")), "n").withColumn("one_in", F.col("one_in").cast("long"))


@query("SELECT m, k, (k * ceil(log2(m)))::BIGINT AS bits, k * ceil(log2(m)) > 512 AS warn FROM (VALUES (1048576, 10), (8388608, 5), (134217728, 10), (491040000, 10), (491040000, 18)) t(m, k)")
def required_entropy(spark, d):
    rows = [(m, k, formulas.required_entropy(m, k)) for m, k in ((1048576, 10), (8388608, 5), (134217728, 10), (491040000, 10), (491040000, 18))]
    return spark.createDataFrame(rows, "m int, k int, bits long").withColumn("warn", F.col("bits") > 512)


# ---- searches


def _asked(spark, d):
    return dims.campaign(dims.blacklist(spark, d), dims.entities(spark, d))


@query(o.with_(o.HOSTS, o.PREFIXES, o.BLACK, o.CAMPAIGN, last="SELECT name, entity, token FROM camp"))
def blacklist_cross_entities(spark, d):
    """Everything a campaign asks: each name alone and under each organisation."""
    return _asked(spark, d)


_ASK = "ask AS (SELECT DISTINCT sha256(token) AS hex FROM camp)"
_FOUND = (*o.BASE, o.TOKENS, o.bits_cte(SINGLE), o.BLACK, o.CAMPAIGN, _ASK, o.found_cte(SINGLE))


def _hits(spark, d, cfg=SINGLE) -> DataFrame:
    """period_end, token, hits and exact for the campaign: what the sketch says beside what the log says."""
    rows, camp = _lookups(spark, d), _asked(spark, d).select("token").withColumn("hex", F.sha2("token", 256))
    found = search.probe(camp, stored(spark, d, cfg)).groupBy("period_end", "hex").agg(F.count(F.lit(1)).alias("hits"))
    truth = token_rows(rows.withColumn("period_end", sketch.period_end(F.col("ts"), cfg.period)).select("period_end", "host", "qtype", "entity").distinct()).select("period_end", "token").distinct().withColumn("exact", F.lit(True))
    return found.join(camp, "hex").join(truth, ["period_end", "token"], "left").select("period_end", "token", "hits", F.coalesce("exact", F.lit(False)).alias("exact"))


@query(o.with_(*_FOUND, "ex AS (SELECT DISTINCT period_end, token FROM tok)", last=f"SELECT {_secs('found.period_end')} AS period_end, camp.token, count(*) AS hits, bool_or(ex.token IS NOT NULL) AS exact FROM found JOIN camp ON hex = sha256(camp.token) LEFT JOIN ex ON ex.token = camp.token AND ex.period_end = found.period_end GROUP BY ALL"))
def search_hits(spark, d):
    """Which blacklisted names were probably looked up, by which organisation, on which day."""
    return _hits(spark, d).withColumn("period_end", secs("period_end"))


_TF = (*o.BASE, o.TOKENS, o.bits_cte(TINY), o.BLACK, o.CAMPAIGN)
#: A job of groups: group g has the campaign's plain names whose length mod 5 is g.
_JOB = "job AS (SELECT length(name) % 5 AS g, name AS key, sha256(name) AS hex FROM black)"
_HIT = f"""hit AS (SELECT period_end, job.g, job.key, coalesce(m.mask, 0) AS mask FROM job CROSS JOIN (SELECT DISTINCT period_end FROM acc)
  LEFT JOIN (SELECT period_end, hex, bit_or(1::BIGINT << filter_idx) AS mask FROM found GROUP BY 1, 2) m USING (period_end, hex))"""


def _jobs(spark, d) -> DataFrame:
    """One job as JSON, made from the blacklist."""
    b = dims.blacklist(spark, d).select((F.length("name") % 5).alias("id"), "name")
    g = b.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.sha2("name", 256).alias("h"))))).alias("hostnames"))
    one = g.select("id", F.concat(F.lit('{"id":'), F.col("id"), F.lit(',"hostnames":'), F.to_json("hostnames"), F.lit("}")).alias("j"))
    groups = one.agg(F.array_sort(F.collect_list(F.struct("id", "j"))).alias("a"))
    return groups.select(F.lit(1).alias("job_id"), F.concat(F.lit('{"groups":['), F.concat_ws(",", F.transform("a", lambda x: x["j"])), F.lit('],"comment":"ignored"}')).alias("job"))


@query(o.with_(*_TF, _JOB, "ask AS (SELECT DISTINCT hex FROM job)", o.found_cte(TINY), _HIT, last=f"SELECT {_secs('period_end')} AS period_end, g::BIGINT AS group_id, count(*) FILTER (mask <> 0) AS hosts_hit, (CASE WHEN bool_and(mask <> 0) THEN bit_count(bit_and(mask)) ELSE 0 END)::BIGINT AS hits_by_all_hostnames FROM hit GROUP BY period_end, g HAVING count(*) FILTER (mask <> 0) > 0"))
def search_group_intersection(spark, d):
    """In how many filters all hosts of a group are."""
    s = stored(spark, d, TINY)
    h = search.flatten(search.host_hits(search.parse_jobs(_jobs(spark, d)), s), s, 0)
    return search.group_hits(h, s).select(secs("period_end").alias("period_end"), "group_id", "hosts_hit", "hits_by_all_hostnames")


@query(o.with_(*_TF, o.CLIENTS, o.REGS, "est AS (" + o.hll_estimate("(SELECT period_end, reg, rank FROM regs WHERE kind = 'host')", "period_end") + ")", _JOB, "ask AS (SELECT DISTINCT hex FROM job)", o.found_cte(TINY), _HIT,
    last=f"SELECT {_secs('period_end')} AS period_end, key AS host_key, CASE WHEN estimate < 500 THEN (bit_count(mask) >= {TINY.per_user})::BIGINT ELSE bit_count(mask)::BIGINT END AS hits, estimate < 500 AS flattened FROM hit JOIN est USING (period_end)").replace(o.CLIENTS + ",\nhashes", "hashes"))
def search_flattened(spark, d):
    """Host hits after flattening of the quiet periods."""
    s = stored(spark, d, TINY)
    h = search.flatten(search.host_hits(search.parse_jobs(_jobs(spark, d)), s), s, 500)
    return h.select(secs("period_end").alias("period_end"), "host_key", "hits", "flattened")


_JSON = """f AS (SELECT period_end, g, key, mask, estimate < 500 AS fl, CASE WHEN estimate < 500 THEN (bit_count(mask) >= 2)::BIGINT ELSE bit_count(mask)::BIGINT END AS hits FROM hit JOIN est USING (period_end)),
grp AS (SELECT period_end, g, bool_and(hits > 0) AS every, bit_count(bit_and(mask))::BIGINT AS n FROM f GROUP BY 1, 2),
req AS (SELECT period_end, count(*) AS number_of_requests FROM acc GROUP BY 1)"""


@query(o.with_(*_TF, o.CLIENTS, o.REGS, "est AS (" + o.hll_estimate("(SELECT period_end, reg, rank FROM regs WHERE kind = 'host')", "period_end") + ")", _JOB, "ask AS (SELECT DISTINCT hex FROM job)", o.found_cte(TINY), _HIT, _JSON,
    last=f"SELECT {_secs('period_end')} AS period_end, number_of_requests, fl AS flattened, g::BIGINT AS group_id, key AS host_key, hits, (CASE WHEN NOT every THEN 0 WHEN fl THEN (n >= {TINY.per_user})::BIGINT ELSE n END)::BIGINT AS hits_by_all FROM f JOIN grp USING (period_end, g) JOIN req USING (period_end) WHERE hits > 0").replace(o.CLIENTS + ",\nhashes", "hashes"))
def search_job_json(spark, d):
    """The JSON of a job's result for every day, read back: period, requests, groups and their hosts."""
    r = search.results(_jobs(spark, d), stored(spark, d, TINY), 500)
    j = F.from_json("result", "period_end long, number_of_requests long, flattened_results boolean, groups array<struct<id long, hits_by_all_hostnames long, hostnames map<string,long>>>")
    g = r.select(j.alias("j")).select("j.period_end", "j.number_of_requests", F.col("j.flattened_results").alias("flattened"), F.explode("j.groups").alias("g"))
    return g.select("period_end", "number_of_requests", "flattened", F.col("g.id").alias("group_id"), F.col("g.hits_by_all_hostnames").alias("hits_by_all"), F.explode("g.hostnames").alias("host_key", "hits"))


_HT = "ht AS (SELECT DISTINCT token FROM found JOIN camp ON hex = sha256(camp.token))"
_HE = "he AS (SELECT string_split(token, '@')[1] AS entity, count(*) AS hits FROM ht WHERE contains(token, '@') GROUP BY 1)"


@query(o.with_(*_FOUND, _HT, _HE, last="SELECT entity, hits FROM he"))
def hits_by_entity(spark, d):
    return analyst.hits_by_entity(_hits(spark, d).select("token").distinct())


@query(o.with_(*_FOUND, _HT, last="SELECT DISTINCT regexp_replace(token, '^[^@]*@', '') AS domain FROM ht"))
def hit_domains(spark, d):
    return analyst.hit_domains(_hits(spark, d).select("token").distinct())


@query(o.with_(*_FOUND, _HT, _HE, o.SECTORS, last="SELECT sector, sum(hits)::BIGINT AS count FROM he JOIN sectors USING (entity) GROUP BY sector"))
def hits_by_sector(spark, d):
    return analyst.by_sector(analyst.hits_by_entity(_hits(spark, d).select("token").distinct()), dims.sectors(spark, d))


@query(o.with_(*_FOUND, _HT, _HE, o.SECTORS, last="SELECT entity, hits FROM he ANTI JOIN sectors USING (entity)"))
def sector_unmatched(spark, d):
    return analyst.unmatched(analyst.hits_by_entity(_hits(spark, d).select("token").distinct()), dims.sectors(spark, d))


@query(o.with_(*_FOUND, _HT, last="SELECT token FROM ht WHERE NOT (contains(token, '@') AND string_split(token, '@')[1] IN ('BACKBONE', 'UNKNOWN'))"))
def exclude_entities(spark, d):
    return analyst.excluding(_hits(spark, d).select("token").distinct(), ["BACKBONE", "UNKNOWN"])


@query(o.with_(*_FOUND, _HT, last="SELECT token FROM ht WHERE contains(token, '@') AND string_split(token, '@')[1] IN ('BACKBONE')"))
def only_entities(spark, d):
    return analyst.only(_hits(spark, d).select("token").distinct(), ["BACKBONE"])


# ---- evaluation

_GT = "gt AS (SELECT DISTINCT host AS name FROM acc WHERE host IN (SELECT name FROM black))"
_PRED = "pred AS (SELECT DISTINCT token AS name FROM found JOIN camp ON hex = sha256(camp.token) WHERE entity IS NULL)"


def _truth(spark, d):
    black = dims.blacklist(spark, d)
    gt = _lookups(spark, d).select(F.col("host").alias("name")).distinct().join(black, "name", "left_semi")
    plain = _hits(spark, d).select(F.col("token").alias("name")).distinct().join(black, "name", "left_semi")
    return gt, plain


def _score(a: str, b: str) -> str:
    return f"SELECT count(*) FILTER (name IN (SELECT name FROM {b})) AS inside, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (name IN (SELECT name FROM {b})) / count(*), 2) AS percent FROM {a}"


@query(o.with_(*_FOUND, _GT, _PRED, last=_score("gt", "pred")))
def gt_recall(spark, d):
    gt, pred = _truth(spark, d)
    return analyst.scored(gt, pred, "name")


@query(o.with_(*_FOUND, _GT, _PRED, last=_score("pred", "gt")))
def gt_precision(spark, d):
    gt, pred = _truth(spark, d)
    return analyst.scored(pred, gt, "name")


@query(o.with_(*_FOUND, _GT, _PRED, last="SELECT name FROM pred WHERE name NOT IN (SELECT name FROM gt)"))
def gt_misses(spark, d):
    """Names that the sketch has and the log has not as a host (labels and parents of looked-up hosts among them)."""
    gt, pred = _truth(spark, d)
    return analyst.missed(pred, gt, "name")


@query(o.with_(*o.BASE, o.BLACK, last="SELECT DISTINCT host, name FROM (SELECT DISTINCT host FROM acc) JOIN black ON host = name OR ends_with(host, '.' || name)"))
def suffix_match(spark, d):
    return analyst.suffix_matches(_lookups(spark, d), dims.blacklist(spark, d))


_REG = "array_to_string(string_split(host, '.')[-2:], '.')"


@query(o.with_(*o.BASE, o.BLACK, last=f"SELECT host, coalesce(a.name, b.name) AS matched FROM (SELECT DISTINCT host FROM acc) LEFT JOIN black a ON a.name = host LEFT JOIN black b ON b.name = {_REG} WHERE coalesce(a.name, b.name) IS NOT NULL"))
def registrable_match(spark, d):
    return analyst.fallback_matches(_lookups(spark, d), dims.blacklist(spark, d))


_HC = "hc AS (SELECT host, count(*) AS n FROM acc GROUP BY host)"


@query(o.with_(*o.BASE, _HC, last="SELECT host, n, running FROM (SELECT host, n, (sum(n) OVER (ORDER BY n DESC, host ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM hc) WHERE running - n < floor(0.8 * (SELECT sum(n) FROM hc))"))
def pareto80(spark, d):
    c = _lookups(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return analyst.pareto(c, "host", "n")


@query(o.with_(*o.BASE, _HC, last="SELECT host, n FROM hc ORDER BY n DESC, host LIMIT 30"))
def top30(spark, d):
    return analyst.top(_lookups(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host", "n")


_IP = "((net // 16777216) % 256) || '.' || ((net // 65536) % 256) || '.' || ((net // 256) % 256) || '.' || (net % 256)"


@query(o.with_(o.PREFIXES, last=f"SELECT entity, '[' || string_agg('{{\"' || {_IP} || '\":' || plen || '}}', ',' ORDER BY net) || ']' AS prefixes FROM prefixes GROUP BY entity"))
def subnet_json(spark, d):
    """The subnet definitions, one JSON list per organisation."""
    from dnsketch.functions.inet import ipv4_text

    p = dims.entity_prefixes(spark, d)
    return analyst.prefix_lists(p.select("entity", ipv4_text(F.col("net")).alias("ip"), "plen", "ord"))


@query(o.with_(o.PREFIXES, last="SELECT entity, net, plen, 'old' AS side FROM prefixes WHERE plen = 24 UNION ALL SELECT entity, net, 20, 'new' FROM prefixes WHERE plen = 24"))
def crm_diff(spark, d):
    """What changed between two versions of the prefixes."""
    p = dims.entity_prefixes(spark, d).select("entity", "net", "plen")
    return analyst.table_diff(p, p.withColumn("plen", F.when(F.col("plen") == 24, 20).otherwise(F.col("plen"))))


# ---- threat intelligence: events of orders, attributes of their lines

_TI = """ti AS (SELECT o_orderkey AS event_id, o_orderkey % 4 + 1 AS lvl, bool_or(l_linenumber % 4 = 2 AND l_returnflag = 'R') AS dom FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _threats(spark, d) -> DataFrame:
    """event_id, Attribute, info, threat_level_id, Tag: parsed from JSON text as a download would be."""
    from dnsketch.model import THREATS
    from dnsketch.sources.dnslog import table

    li, od = table(spark, d, "lineitem"), table(spark, d, "orders")
    kind = F.when((F.col("l_linenumber") % 4 == 2) & (F.col("l_returnflag") == "R"), "Domain").otherwise("ip-dst")
    attrs = li.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_list(F.struct(kind.alias("type"), F.col("l_orderkey").cast("string").alias("event_id"))).alias("Attribute"))
    e = od.select(F.col("o_orderkey").alias("event_id"), "o_orderstatus").join(attrs, "event_id", "left")
    tags = F.array(F.struct(F.lit("type:OSINT").alias("name")), F.struct(F.concat(F.lit("TLP:"), F.lower("o_orderstatus")).alias("name")))
    event = F.struct("Attribute", F.concat(F.lit("event "), F.col("event_id")).alias("info"), (F.col("event_id") % 4 + 1).cast("string").alias("threat_level_id"), tags.alias("Tag"))
    text = e.select("event_id", F.to_json(F.struct(F.array(F.struct(event.alias("Event"))).alias("response"))).alias("json"))
    return text.select("event_id", F.explode(F.from_json("json", THREATS)["response"]).alias("r")).select("event_id", "r.Event.*")


@query(o.with_(_TI, last="SELECT count(*) FILTER (dom) AS with_domain, count(*) AS events, round(100.0::DOUBLE * count(*) FILTER (dom) / count(*), 2) AS percent FROM ti"))
def ioc_ratio(spark, d):
    return analyst.ioc_ratio(_threats(spark, d))


@query(o.with_(_TI, last="SELECT event_id, 'event ' || event_id AS info, ['High', 'Medium', 'Low', 'Undefined'][lvl] AS threat_level, lower(o_orderstatus) AS tlp FROM ti JOIN orders ON o_orderkey = event_id WHERE dom"))
def threat_levels(spark, d):
    """Events that have a domain attribute, with level and TLP."""
    t = _threats(spark, d)
    wanted = t.filter(analyst.has_attribute(F.col("Attribute"))).select("event_id").distinct()
    return analyst.enriched(wanted, t)


@query("""WITH g AS (SELECT range AS id, sha256('7|' || range) AS h FROM range(10000)), n AS (SELECT id, h, 5 + ('0x' || substr(h, 1, 4))::INT % 11 AS size FROM g)
SELECT id, 'load.' || array_to_string(list_transform(range(size), lambda i: chr(97 + ('0x' || substr(h, (5 + 2 * i)::INT, 2))::INT % 26)), '') || '.example.test' AS qname, ['A', 'AAAA', 'NS', 'MX'][1 + ('0x' || substr(h, 63, 2))::INT % 4] AS qtype FROM n""")
def generated_queries(spark, d):
    """Random queries `prefix.randN.suffix` of the load generator, reproducible by seed."""
    from dnsketch.sources.generator import random_queries

    return random_queries(spark, 10_000)


# ---- streams


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(SINGLE), last=f"SELECT {_secs('period_end')} AS period_end, count(*) AS bits_set, any_value(n) AS number_of_requests FROM fb JOIN (SELECT period_end, count(*) AS n FROM acc GROUP BY 1) USING (period_end) GROUP BY period_end"))
def stream_period_state(spark, d):
    """The daily sketches of a stream of events: the same as those of the batch."""
    path = shared_folder(spark, "stream")
    prefixes = dims.entity_prefixes(spark, d)
    stream = dnslog.dns_log(spark, d, periods.events_stream(spark, d))
    periods.run_periods(stream, SINGLE, path, lambda b: dnslog.lookups(b, prefixes)).awaitTermination()
    s = periods.periods(spark, path, SINGLE)
    return s.header.join(s.filter, "period_end").select(secs("period_end").alias("period_end"), "bits_set", "number_of_requests")


_MINUTE = """SELECT epoch(date_trunc('minute', ts))::BIGINT AS minute, count(*) AS n_proc, count(*) FILTER (ok) AS n_acc, count(*) FILTER (ok AND qtype = 'A') AS n_qa, count(*) FILTER (ok AND qtype = 'PTR') AS n_qptr
  FROM (SELECT *, qclass = 'IN' AND qtype IN ('A','NS','MX','AAAA','PTR') AS ok FROM log) GROUP BY 1"""


@query(o.with_(o.HOSTS, o.LOG, last=_MINUTE))
def stream_minutely(spark, d):
    """Minute counters of a stream, added up from the parts of its batches."""
    path = shared_folder(spark, "stream")
    periods.run_counters(dnslog.dns_log(spark, d, periods.events_stream(spark, d)), path).awaitTermination()
    c = periods.counters(spark, path)
    return c.select(secs("window_start").alias("minute"), "n_proc", "n_acc", "n_qa", "n_qptr")


# ---- inputs in their own formats, made from the log and read back


@query(o.with_(o.HOSTS, o.LOG, last=f"SELECT {_secs('ts')} AS ts, client, qname, CASE qtype WHEN 'A' THEN 1 WHEN 'NS' THEN 2 WHEN 'PTR' THEN 12 WHEN 'MX' THEN 15 WHEN 'TXT' THEN 16 WHEN 'AAAA' THEN 28 ELSE 33 END AS qtype, CASE qclass WHEN 'IN' THEN 1 ELSE 3 END AS qclass FROM (SELECT * REPLACE (regexp_replace(qname, '\\.$', '') AS qname) FROM log)"))
def text_log_parse(spark, d):
    """`epoch client host./type/class` lines."""
    number = F.create_map(*[F.lit(x) for k, v in wire.NUMBER_OF.items() for x in (k, v)])
    name = F.concat(F.regexp_replace("qname", r"\.$", ""), F.lit("."))
    parts = [F.concat_ws(" ", secs("ts").cast("string"), "client", name), number[F.col("qtype")].cast("string"), F.when(F.col("qclass") == "IN", "1").otherwise("3")]
    got = dnslog.parse_text_log(_log(spark, d).select(F.concat_ws("/", *parts).alias("value")))
    return got.withColumn("ts", secs("ts"))


_WIRE = f"SELECT {_secs('ts')} AS ts, client, regexp_replace(qname, '\\.$', '') || '.' AS qname, qclass, qtype FROM log"


@query(o.with_(o.HOSTS, o.LOG, last=_WIRE))
def dnstap_decode(spark, d):
    """Frame streams of dnstap messages with DNS packets inside."""
    import pyarrow as pa

    def encoded(batches):
        for b in batches:
            f = [wire.encode_frame(*r) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([wire.encode_stream(f)], pa.binary())], names=["content"])

    rows = _log(spark, d).select(secs("ts").alias("ts"), "client", "qname", "qtype", "qclass")
    return wire.decode_streams(rows.mapInArrow(encoded, "content binary")).drop("msg_type")


@query(o.with_(o.HOSTS, o.LOG, last=f"SELECT {_secs('ts')} AS ts, client, lower(regexp_replace(qname, '\\.$', '')) AS qname, qclass, qtype FROM log WHERE qtype IN ('A', 'NS', 'MX', 'AAAA')"))
def capture_decode(spark, d):
    """Packet captures: DNS queries over UDP of four types."""
    import pyarrow as pa

    def encoded(batches):
        for b in batches:
            f = [(ts, c, wire.encode_question(n, t, k)) for ts, c, n, t, k in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([wire.encode_capture(f)], pa.binary())], names=["content"])

    rows = _log(spark, d).select(secs("ts").alias("ts"), "client", "qname", "qtype", "qclass")
    return wire.decode_captures(rows.mapInArrow(encoded, "content binary")).drop("msg_type")


@query(o.with_(o.HOSTS, o.LOG, o.PREFIXES, o.ENTITY, last="SELECT client, entity FROM cl LEFT JOIN lpm USING (ip)"))
def subnet_definitions_match(spark, d):
    """Definitions written as JSON, read back, and matched on bits (the way that IPv6 goes, too)."""
    from dnsketch.functions.inet import address
    from dnsketch.operators.lpm import match_bits
    from dnsketch.sources.files import subnet_definitions

    lists = QUERIES["subnet_json"](spark, d)
    one = lists.select(F.concat(F.lit('{"entity":"'), "entity", F.lit('","prefixes":'), "prefixes", F.lit("}")).alias("e"))
    text = one.agg(F.concat(F.lit('{"subnet_activity":['), F.concat_ws(",", F.array_sort(F.collect_list("e"))), F.lit(",]}")).alias("value"))
    who = _log(spark, d).select("client").distinct().withColumn("a", address(F.col("client"))).select("client", "a.af", "a.hi", "a.lo")
    return match_bits(who, subnet_definitions(text)).select("client", "entity")


# ---- bits


@query("SELECT event_id, xor(user_id, 5) | 64 AS with_bit, (xor(user_id, 5) | 8) - 8 AS without, (xor(user_id, 5) >> 1) % 2 = 1 AS has, bit_count(xor(user_id, 5))::BIGINT AS n, (xor(user_id, 5) & 6) = 6 AS every, (xor(user_id, 5) & 6) <> 0 AS some FROM events")
def mask_operations(spark, d):
    """Set, clear, test and count bits of 64-bit masks."""
    m = F.col("user_id").bitwiseXOR(F.lit(5))
    return dnslog.table(spark, d, "events").select("event_id", bits.set_bit(m, 6).alias("with_bit"), bits.clear_bit(m, 3).alias("without"), bits.test_bit(m, 1).alias("has"), F.bit_count(m).cast("long").alias("n"), bits.all_set(m, F.lit(6)).alias("every"), bits.any_set(m, F.lit(6)).alias("some"))


@query("""WITH s AS (SELECT DISTINCT event_type, user_id FROM events), n AS (SELECT count(DISTINCT event_type) AS n FROM s)
SELECT (SELECT count(DISTINCT user_id) FROM s) AS either, (SELECT count(*) FROM (SELECT user_id FROM s GROUP BY user_id HAVING count(*) = (SELECT n FROM n))) AS every""")
def bitmap_operations(spark, d):
    """Users of any and of every event type, from the union and the intersection of bitmaps."""
    e = dnslog.table(spark, d, "events").filter("user_id is not null")
    b = e.groupBy("event_type", F.floor(F.col("user_id") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.col("user_id") % 32768).alias("b"))
    kinds = e.agg(F.count_distinct("event_type")).scalar()
    u = b.groupBy("bucket").agg(F.bitmap_or_agg("b").alias("any"), F.bitmap_and_agg("b").alias("all"), F.count(F.lit(1)).alias("k"))
    return u.agg(F.sum(F.bitmap_count("any")).alias("either"), F.coalesce(F.sum(F.when(F.col("k") == kinds, F.bitmap_count("all"))), F.lit(0)).alias("every"))


@query(f"""WITH t AS (SELECT DISTINCT user_id, sha256(user_id::VARCHAR) AS h FROM events), w AS (SELECT user_id, {o.word('h', 0)}::UHUGEINT AS a, {o.word('h', 1)}::UHUGEINT AS b FROM t)
SELECT user_id, ((a * 1048573 // {o.TWO64}::UHUGEINT + b * 1048573) // {o.TWO64}::UHUGEINT)::BIGINT AS overflow, ((a * 1048573) % 65536)::BIGINT AS low FROM w""")
def bignum_product(spark, d):
    """128-bit numbers times a 32-bit factor, as a carry chain on 16-bit limbs."""
    t = dnslog.table(spark, d, "events").select("user_id").distinct()
    p = bits.times(bits.limbs(F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 32)), F.lit(1048573))
    return t.select("user_id", p.alias("p")).select("user_id", F.col("p.overflow").alias("overflow"), F.get("p.limbs", F.lit(0)).alias("low"))


@query(o.with_(*o.BASE, _DRY.replace("'hour'", "'day'"), last=f"SELECT {_secs('w')} AS window_start, count(DISTINCT token) AS n FROM d GROUP BY w"))
def dryrun_daily(spark, d):
    return metrics.distinct_tokens(_lookups(spark, d), 86_400).withColumn("window_start", secs("window_start"))


@query(o.with_(o.HOSTS, last="SELECT DISTINCT host, CASE WHEN regexp_matches(host, '(^|\\.)example\\.(com|net)$') THEN (CASE WHEN len(l) > 2 THEN array_to_string(l[-3:], '.') END) ELSE array_to_string(l[-2:], '.') END AS domain FROM (SELECT host, string_split(host, '.') AS l FROM hosts)"))
def registrable_list(spark, d):
    """Registrable domains by a list of public suffixes (here two), else the last two labels."""
    public = spark.createDataFrame([("example.com",), ("com",), ("example.net",)], "suffix string")
    return analyst.registrable_by_list(dnslog.page_hosts(spark, d), public)


@query(o.with_(o.HOSTS, o.LOG, last="SELECT 'Instrumentation: n_proc=' || count(*) || ',n_acc=' || count(*) FILTER (ok) || ',n_skip=0,n_qsec=' || count(*) // 60 || ',n_qa=' || count(*) FILTER (ok AND qtype = 'A') || ',n_qaaaa=' || count(*) FILTER (ok AND qtype = 'AAAA') || ',n_qns=' || count(*) FILTER (ok AND qtype = 'NS') || ',n_qmx=' || count(*) FILTER (ok AND qtype = 'MX') || ',n_qptr=' || count(*) FILTER (ok AND qtype = 'PTR') || ',n_qcat=0,n_qncat=' || count(*) FILTER (ok) || ',n_invfrm=0' AS line, epoch(date_trunc('minute', ts))::BIGINT AS minute FROM (SELECT *, qclass = 'IN' AND qtype IN ('A','NS','MX','AAAA','PTR') AS ok FROM log) GROUP BY minute"))
def instrument_lines(spark, d):
    """The counters as log lines."""
    c = metrics.counters(_log(spark, d), None, F.window("ts", "60 seconds")["start"])
    return metrics.counter_line(c).select(secs("window_start").alias("minute"), "line")


@query(o.with_(*_FOUND, o.REGS.replace("hashes AS", o.CLIENTS + ",\nhashes AS"), "est AS (" + o.hll_estimate("(SELECT period_end, reg, rank FROM regs WHERE kind = 'client')", "period_end") + ")", last=f"SELECT {_secs('period_end')} AS period_end, estimate AS est_clients, count(DISTINCT hex) AS names_hit FROM found JOIN est USING (period_end) GROUP BY ALL"))
def clients_of_hits(spark, d):
    """Roughly how many clients a day had, beside the number of campaign names it had."""
    s = stored(spark, d, SINGLE)
    found = search.probe(_asked(spark, d).select(F.sha2("token", 256).alias("hex")), s).groupBy("period_end").agg(F.count_distinct("hex").alias("names_hit"))
    return s.header.join(found, "period_end").select(secs("period_end").alias("period_end"), "est_clients", "names_hit")


_LINES = f"""SELECT {_secs('period_end')} AS period_end, n AS number_of_requests, printf('%2d. Number of bits set: %10d (Estimated number of host names: %10d)', 1, b, {o.estimate('b', SINGLE)}) AS line
  FROM (SELECT period_end, count(*) AS b FROM fb GROUP BY 1) JOIN (SELECT period_end, count(*) AS n FROM acc GROUP BY 1) USING (period_end)"""


@query(o.with_(*o.BASE, o.TOKENS, o.bits_cte(SINGLE), last=_LINES))
def info_sections(spark, d):
    """Two facts read back from the text of the four-section report."""
    from dnsketch.operators.report import info_text

    r = info_text(_state(spark, d, SINGLE))
    return r.select(secs("period_end").alias("period_end"), F.regexp_extract("report", r"Number of requests\s*: (\d+)", 1).cast("long").alias("number_of_requests"), F.regexp_extract("report", r"( 1\. Number of bits set.*)", 1).alias("line"))


from dnsketch.plans import inputs  # noqa: E402  (adds its queries)

inputs.late(query)
