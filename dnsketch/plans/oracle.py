"""DuckDB SQL that says what each query of the catalogue must return, from the same tables."""

from __future__ import annotations

from dnsketch.model import BIAS, BIAS_END, MURMUR_SEED, BloomConfig

M64 = "14313749767032793493"  # 0xc6a4a7935bd1e995
TWO64 = "18446744073709551616"


def with_(*ctes: str, last: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + last


HOSTS = "hosts AS (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages WHERE regexp_extract(url, '://([^/:?#]+)', 1) <> '')"
LOG = """log0 AS (
  SELECT e.event_id, e.ts, h.host, e.event_id % 12 AS r, e.event_id // 12 AS turn,
    CASE WHEN user_id % 7 = 0 THEN [172, 16, 0, user_id % 256] ELSE [10, user_id % 25, user_id % 3, user_id % 256] END AS o
  FROM events e JOIN hosts h ON h.page_id = e.event_id % (SELECT count(*) FROM pages)),
log1 AS (
  SELECT event_id, ts, o[1] || '.' || o[2] || '.' || o[3] || '.' || o[4] AS client, ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] AS ip, o,
    CASE WHEN r = 11 THEN 'CH' ELSE 'IN' END AS qclass, turn, host,
    CASE WHEN r <= 3 OR r = 11 THEN 'A' WHEN r <= 5 THEN 'AAAA' WHEN r = 6 THEN 'NS' WHEN r = 7 THEN 'MX' WHEN r = 8 THEN 'PTR' WHEN r = 9 THEN 'TXT' ELSE 'SRV' END AS qtype
  FROM log0),
log AS (
  SELECT event_id, ts, client, ip, o, qclass, qtype,
    (CASE WHEN turn % 3 = 0 THEN upper(n) ELSE n END) || (CASE WHEN turn % 2 = 0 THEN '.' ELSE '' END) AS qname
  FROM (SELECT *, CASE WHEN qtype = 'PTR' THEN o[4] || '.' || o[3] || '.' || o[2] || '.' || o[1] || '.in-addr.arpa' ELSE host END AS n FROM log1))"""
ACCEPTED = "acc0 AS (SELECT event_id, ts, client, ip, o, qtype, lower(regexp_replace(qname, '\\.$', '')) AS host FROM log WHERE qclass = 'IN' AND qtype IN ('A', 'NS', 'MX', 'AAAA', 'PTR'))"
PREFIXES = """prefixes AS (
  SELECT 'BACKBONE' AS entity, 10 * 16777216 AS net, 8 AS plen
  UNION ALL SELECT n_name, 10 * 16777216 + n_nationkey * 65536, 16 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT r_name, 10 * 16777216 + n_nationkey * 65536, 24 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0)"""
ENTITY = """cl AS (SELECT DISTINCT ip, client FROM log),
lpm AS (SELECT ip, max_by(entity, plen) AS entity FROM cl JOIN prefixes ON ip // (1 << (32 - plen)) = net // (1 << (32 - plen)) GROUP BY ip)"""
LOOKUPS = "acc AS (SELECT acc0.*, entity, coalesce(entity, 'UNKNOWN') AS ent, date_trunc('day', ts) + INTERVAL 1 DAY AS period_end FROM acc0 LEFT JOIN lpm USING (ip))"
BASE = (HOSTS, LOG, ACCEPTED, PREFIXES, ENTITY, LOOKUPS)


def token_cte(name: str, keys: str, source: str = "acc", with_entity: bool = True) -> str:
    """name(keys, token): a row per lookup and token."""
    e = "list_concat([ent || '@' || host], CASE WHEN qtype = 'PTR' THEN [] ELSE list_transform(l[1:n-1], lambda x: ent || '@' || x) END)"
    return f"""{name} AS (
  SELECT {keys}, unnest(list_concat([host], list_concat(CASE WHEN qtype = 'PTR' THEN [] ELSE list_append(l[1:n-1], CASE WHEN n > 1 THEN l[n-1] || '.' || l[n] ELSE '' END) END{", " + e if with_entity else ", []"}))) AS token
  FROM (SELECT *, string_split(host, '.') AS l, len(string_split(host, '.')) AS n FROM {source}))"""


TOKENS = token_cte("tok", "period_end, event_id, ip, client")


def word(hexed: str, i: int) -> str:
    """The i-th little-endian 64-bit word of a hash."""
    return f"CAST('0x' || {' || '.join(f'substr({hexed}, {16 * i + p}, 2)' for p in range(15, 0, -2))} AS UBIGINT)"


def offsets_cte(name: str, source: str, cfg: BloomConfig, f: str = "0") -> str:
    """name(key columns of source, hex, f, offs) for source(hex, f): sorted distinct offsets."""
    m, k = cfg.bits, cfg.hashes
    mul = lambda i: f"CAST(({word('hex', i)}::UHUGEINT * (2 * f + 1)::UHUGEINT) % {TWO64}::UHUGEINT AS HUGEINT)"
    q = f"{TWO64}::HUGEINT"
    return f"""{name}_r AS (
  SELECT hex, f, 0 AS j, {mul(0)} AS l0, {mul(1)} AS l1, {mul(2)} AS l2, {mul(3)} AS l3, []::BIGINT[] AS v FROM (SELECT DISTINCT hex, f FROM {source})
  UNION ALL
  SELECT hex, f, j + 1, n0 + (o & ((({m} - j) & -({m} - j)) - 1)), n1, n2, n3, list_sort(list_append(v, o::BIGINT + len(list_filter(v, lambda x, i: x - (i - 1) <= o))))
  FROM (SELECT hex, f, j, v, n0, n1, n2, p3 % {q} AS n3, p3 // {q} AS o
    FROM (SELECT *, p2 % {q} AS n2, l3 * ({m} - j)::HUGEINT + p2 // {q} AS p3
      FROM (SELECT *, p1 % {q} AS n1, l2 * ({m} - j)::HUGEINT + p1 // {q} AS p2
        FROM (SELECT *, p0 % {q} AS n0, l1 * ({m} - j)::HUGEINT + p0 // {q} AS p1
          FROM (SELECT *, l0 * ({m} - j)::HUGEINT AS p0 FROM {name}_r WHERE j < {k})))))),
{name} AS (SELECT hex, f, v AS offs FROM {name}_r WHERE j = {k})"""


def murmur(o: str) -> str:
    """MurmurHash64A of the four address bytes, as UBIGINT; needs a sub-select for each step."""
    mul = lambda x: f"CAST((({x})::UHUGEINT * {M64}::UHUGEINT) % {TWO64}::UHUGEINT AS UBIGINT)"
    h0 = f"xor(xor({MURMUR_SEED}::UBIGINT, {4 * int(M64) % (1 << 64)}::UBIGINT), ({o}[1] + {o}[2] * 256 + {o}[3] * 65536 + {o}[4] * 16777216)::UBIGINT)"
    h1 = mul(h0)
    h2 = mul(f"xor({h1}, {h1} >> 47)")
    return f"xor({h2}, {h2} >> 47)"


CLIENTS = f"clients AS (SELECT ip, {murmur('o')} AS h FROM (SELECT DISTINCT ip, o FROM acc))"


def combos(cfg: BloomConfig) -> str:
    return "[" + ", ".join(str(list(c)) for c in cfg.combos) + "]"


def bits_cte(cfg: BloomConfig) -> str:
    """fb(period_end, filter_idx, off): the distinct set bits."""
    if cfg.filters == 1:
        ft = "ft AS (SELECT DISTINCT period_end, 0 AS f, sha256(token) AS hex FROM tok)"
    else:
        ft = f"{CLIENTS},\nft AS (SELECT DISTINCT period_end, f, sha256(token) AS hex FROM tok JOIN (SELECT ip, unnest({combos(cfg)}[1 + (h % {len(cfg.combos)})::INT]) AS f FROM clients) USING (ip))"
    return f"{ft},\n{offsets_cte('offs', 'ft', cfg)},\nfb AS (SELECT DISTINCT period_end, f AS filter_idx, unnest(offs) AS off FROM ft JOIN offs USING (hex, f))"


def estimate(x: str, cfg: BloomConfig) -> str:
    return f"CASE WHEN {x} >= {cfg.bits} THEN 4294967295 ELSE round(-({cfg.bits}.0::DOUBLE / {cfg.hashes}) * ln(1 - least({x}, {cfg.bits} - 1)::DOUBLE / {cfg.bits}))::BIGINT END"


REGS = f"""hashes AS (
  SELECT DISTINCT period_end, 'client' AS kind, h FROM acc JOIN clients USING (ip)
  UNION ALL SELECT DISTINCT period_end, 'host', {word('sha256(token)', 0)} FROM tok),
regs AS (SELECT period_end, kind, (h % 16384)::INT AS reg, max(1 + CASE WHEN (h >> 14) = 0 THEN 49 ELSE least(49, bit_count((xor((h >> 14), (h >> 14) - 1) >> 1)::BIGINT)) END)::INT AS rank FROM hashes GROUP BY ALL)"""


def hll_estimate(source: str, keys: str) -> str:
    m = 16384.0
    bias = " + ".join("*".join([f"({c!r})::DOUBLE", *["e"] * (len(BIAS) - 1 - i)]) for i, c in enumerate(BIAS))
    return f"""SELECT {keys}, CAST(trunc(CASE WHEN e < {2.5 * m} AND z <> 0 THEN {m} * ln({m} / z) WHEN e < {BIAS_END} THEN e - e * ({bias}) / 100 ELSE e END) AS BIGINT) AS estimate
  FROM (SELECT {keys}, z, {0.7213 / (1 + 1.079 / m) * m * m!r} / (s + z) AS e FROM (SELECT {keys}, sum(pow(2.0::DOUBLE, -rank)) AS s, 16384 - count(*) AS z FROM {source} GROUP BY {keys}))"""


SECTORS = "sectors AS (SELECT DISTINCT * FROM (SELECT n_name AS entity, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey))"
BLACK = """black AS (SELECT DISTINCT trim(lower(name)) AS name FROM (
  SELECT host AS name FROM hosts WHERE page_id % 5 = 0
  UNION ALL SELECT array_to_string(string_split(host, '.')[-2:], '.') FROM hosts WHERE page_id % 7 = 0
  UNION ALL SELECT 'absent-' || range || '.invalid' FROM range(10)))"""
CAMPAIGN = "camp AS (SELECT name, entity, coalesce(entity || '@', '') || name AS token FROM black CROSS JOIN (SELECT NULL AS entity UNION ALL SELECT DISTINCT entity FROM prefixes UNION ALL SELECT 'UNKNOWN'))"


def found_cte(cfg: BloomConfig, source: str = "ask") -> str:
    """found(period_end, hex, filter_idx): filters with all bits of a hash; source(hex)."""
    return f"""askf AS (SELECT DISTINCT hex, unnest(range({cfg.filters}))::INT AS f FROM {source}),
{offsets_cte('aoffs', 'askf', cfg)},
found AS (SELECT period_end, hex, f AS filter_idx FROM (SELECT hex, f, unnest(offs) AS off FROM aoffs) JOIN fb ON fb.filter_idx = f AND fb.off = aoffs_off(off) GROUP BY ALL HAVING count(*) = {cfg.hashes})""".replace("aoffs_off(off)", "a_off").replace("unnest(offs) AS off FROM aoffs", "unnest(offs) AS a_off FROM aoffs")
