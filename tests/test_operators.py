"""Longest prefixes, sketches, searches, reports on small tables."""

from __future__ import annotations

import datetime as dt
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from dnsketch.functions.hashing import sha256
from dnsketch.functions.inet import address, prefix
from dnsketch.model import SINGLE, TINY, BloomConfig
from dnsketch.operators import analyst, search, sketch
from dnsketch.operators.lpm import client_entities, match_bits
from dnsketch.sources import files

LOOKUPS = "ts timestamp, ip long, host string, qtype string, entity string"


def lookups(spark, rows, minute=0):
    """(client number, host, type, organisation) rows, two seconds apart."""
    return spark.createDataFrame([(dt.datetime(2024, 3, 9, 6, minute, 2 * i), (172 << 24) + ip, *r) for i, (ip, *r) in enumerate(rows)], LOOKUPS)


# a bakery and a law office behind one resolver, in the morning and at noon
MORNING = [(7, "oven-3.plant.bakery.test", "A", "Bakery"), (7, "oven-3.plant.bakery.test", "AAAA", "Bakery"), (9, "maps.example", "A", None), (7, "bakery.test", "NS", "Bakery"), (12, "localhost", "A", None)]
NOON = [(30, "cases.archive.law.test", "MX", "Office & Co"), (9, "maps.example", "AAAA", None), (31, "5.0.19.172.in-addr.arpa", "PTR", "Office & Co")]


def expected(rows):
    """What the rows add to a sketch, by the rules in words."""
    out = set()
    for _, host, kind, entity in rows:
        labels, tag = host.split("."), (entity or "UNKNOWN") + "@"
        out |= {host, tag + host}
        if kind != "PTR":
            out |= set(labels[:-1]) | {tag + x for x in labels[:-1]} | {".".join(labels[-2:]) if len(labels) > 1 else ""}
    return out


def found(spark, state, words):
    h = spark.createDataFrame([(sha256(w),) for w in words], "hex string")
    hit = {r["hex"] for r in search.probe(h, state).select("hex").collect()}
    return {w for w in words if sha256(w) in hit}


def test_a_state_has_its_tokens_and_a_union_those_of_both(spark):
    one, two = (sketch.build_state(lookups(spark, r, m), SINGLE) for m, r in enumerate((MORNING, NOON)))
    of_one, of_two = expected(MORNING), expected(NOON)
    never = {"Bakery@maps.example", "archive.law", "test", "arpa", "in-addr", "Bakery@bakery.test.", "UNKNOWN@oven-3", "Office & Co@law.test"}
    words = sorted(of_one | of_two | never)
    assert not never & (of_one | of_two) and {"plant", "bakery.test", "", "Bakery@oven-3", "UNKNOWN@localhost"} <= of_one
    assert found(spark, one, words) == of_one
    assert found(spark, two, words) == of_two
    both = sketch.State(*(getattr(one, t).unionByName(getattr(two, t)) for t in sketch.TABLES), SINGLE)
    union = sketch.combined(both)
    assert found(spark, union, words) == of_one | of_two
    h = union.header.collect()
    assert [(r["number_of_requests"], r["est_clients"]) for r in h] == [(8, 5)] and abs(h[0]["est_host_names"] - len(of_one | of_two)) <= 1
    assert h[0]["first_request"] == dt.datetime(2024, 3, 9, 6, 0, 0) and h[0]["last_request"] == dt.datetime(2024, 3, 9, 6, 1, 4)


def test_union_is_idempotent(spark):
    s = sketch.build_state(lookups(spark, MORNING), TINY)
    twice = sketch.combined(sketch.State(s.header, s.bloom.union(s.bloom), s.filter, s.hll.union(s.hll), TINY))
    # a state that ends at midnight belongs to the day it opens
    assert sorted(r[1:] for r in map(tuple, twice.filter.collect())) == sorted(r[1:] for r in map(tuple, s.filter.collect()))


def test_addresses_as_bytes_are_the_same_clients(spark):
    rows = lookups(spark, MORNING + NOON)
    s, t = (sketch.build_state(r, TINY) for r in (rows, rows.withColumn("addr", F.unhex(F.lpad(F.hex("ip"), 8, "0"))).drop("ip")))
    assert sorted(map(tuple, s.filter.collect())) == sorted(map(tuple, t.filter.collect()))
    assert s.hll.exceptAll(t.hll).count() == 0


def test_states_of_other_geometry_do_not_combine(spark):
    a, b = sketch.build_state(lookups(spark, MORNING), SINGLE), sketch.build_state(lookups(spark, NOON), TINY)
    with pytest.raises(Exception, match="geometry"):
        sketch.combined(sketch.State(a.header.unionByName(b.header), a.bloom, a.filter, a.hll, SINGLE)).header.collect()


def test_persist_and_load(spark, tmp_path):
    s = sketch.build_state(lookups(spark, MORNING), TINY)
    sketch.persist(s, str(tmp_path / "s"))
    back = sketch.load(spark, str(tmp_path / "s"), TINY)
    assert back.filter.count() == s.filter.count()
    with pytest.raises(ValueError):
        sketch.load(spark, str(tmp_path / "s"), SINGLE)


def test_longest_prefix(spark):
    """Every address against every prefix with the standard library, for lengths on and off the byte, both families."""
    r = random.Random(21)
    nets = [("any4", "0.0.0.0/0"), ("loop", "::1/128"), ("half", "8000::/1"), ("host", "203.0.113.77/32")]
    for i in range(40):
        base = ipaddress.ip_address(r.getrandbits(8) << 24 | 0x330000) if i % 2 else ipaddress.ip_address(0x20010DB8 << 96 | r.getrandbits(3) << 90 | r.getrandbits(2) << 62)
        plen = r.choice((3, 7, 8, 11, 17, 24, 31)) if i % 2 else r.choice((3, 29, 38, 39, 63, 64, 65, 66, 91, 127))
        nets.append((f"org{i}", str(ipaddress.ip_network((base, plen), strict=False))))
    nets.append(("second", nets[5][1]))  # of equal prefixes the first counts
    groups = ",".join('{"entity":"%s","prefixes":[{"%s":%s},]}' % (e, *n.split("/")) for e, n in nets)
    known = files.subnet_definitions(spark.createDataFrame([('{"subnet_activity":[' + groups + ",]}",)], "value string"))
    who = ["203.0.113.77", "203.0.113.78", "::1", "::2", "9000::", "7fff::9"]
    for _, n in nets:
        net = ipaddress.ip_network(n)
        who += [str(x) for x in (net[0], net[-1], net[min(net.num_addresses - 1, 5)])]
        who += [str(net[-1] + 1)] if int(net[-1]) + 1 < 1 << net.max_prefixlen else []
    rows = spark.createDataFrame([(w,) for w in who], "w string").withColumn("a", address(F.col("w"))).select("w", "a.af", "a.hi", "a.lo")
    got = {x["w"]: x["entity"] for x in match_bits(rows, known).collect()}

    def plain(w):
        hits = [(ipaddress.ip_network(n).prefixlen, -i, e) for i, (e, n) in enumerate(nets) if ipaddress.ip_address(w) in ipaddress.ip_network(n)]
        return max(hits)[2] if hits else None

    assert all(got[w] == plain(w) for w in who) and None in got.values() and "loop" in got.values()


def test_longest_prefix_of_numbers(spark):
    p = spark.createDataFrame([("a", 0, 0, 0), ("b", (10 << 24) + 5, 8, 1), ("late", 10 << 24, 8, 2), ("c", (10 << 24) + 256, 24, 3)], "entity string, net long, plen int, ord long")
    rows = spark.createDataFrame([(1,), ((10 << 24) + 1,), ((10 << 24) + 257,)], "ip long")
    assert {r["ip"]: r["entity"] for r in client_entities(rows, p).collect()} == {1: "a", (10 << 24) + 1: "b", (10 << 24) + 257: "c"}


def test_bad_prefix_fails(spark):
    bad = spark.createDataFrame([('{"subnet_activity":[{"entity":"x","prefixes":[{"1.2.3.4":33}]}]}',)], "value string")
    with pytest.raises(Exception, match="no prefix"):
        files.subnet_definitions(bad).collect()
    assert spark.range(1).select(prefix(F.lit("1.2.3.4/33")).alias("x")).first()["x"]["plen"] is None


def result(spark, rows, job, cfg=TINY, threshold=0):
    jobs = spark.createDataFrame([(1, json.dumps(job))], "job_id int, job string")
    return json.loads(search.results(jobs, sketch.build_state(lookups(spark, rows), cfg), threshold).first()["result"])


def test_search_rules(spark):
    assert "groups" not in result(spark, MORNING, {}) and "flattened_results" not in result(spark, MORNING, {"x": 1})
    assert result(spark, MORNING, {"groups": []})["groups"] == []
    hosts = {"g": sha256("maps.example").upper(), "s": sha256("Bakery@plant")}
    got = result(spark, MORNING, {"groups": [{"id": 7, "hostnames": hosts}, {"hostnames": {"no": sha256("never.seen.example")}}]}, SINGLE)
    assert got["groups"] == [{"hostnames": {"g": 1, "s": 1}, "id": 7, "hits_by_all_hostnames": 1}] and got["flattened_results"] is False
    missed = result(spark, MORNING, {"groups": [{"hostnames": {"no": sha256("never.seen.example"), **hosts}}]}, SINGLE)
    assert missed["groups"] == [{"hostnames": {"g": 1, "s": 1}, "id": 0, "hits_by_all_hostnames": 0}]
    bad = result(spark, MORNING, {"groups": [{"hostnames": {"bad": "zz", **hosts}}]}, SINGLE)
    assert bad["groups"][0]["hits_by_all_hostnames"] == 1


def test_flattening(spark):
    job = {"groups": [{"id": 1, "hostnames": {"g": sha256("maps.example")}}]}
    cfg = BloomConfig(4, 65_536, 3, 2)
    assert result(spark, MORNING, job, cfg)["groups"][0]["hostnames"] == {"g": 2}
    flat = result(spark, MORNING, job, cfg, 1000)
    assert flat["flattened_results"] is True and flat["groups"] == [{"hostnames": {"g": 1}, "id": 1, "hits_by_all_hostnames": 1}]


def test_broken_job_fails(spark):
    with pytest.raises(Exception):
        search.parse_jobs(spark.createDataFrame([(1, "{nonsense")], "job_id int, job string")).collect()


def test_pareto_includes_the_row_that_reaches_the_share(spark):
    c = spark.createDataFrame([("a", 50), ("b", 20), ("c", 20), ("d", 10)], "name string, n long")
    got = sorted(analyst.pareto(c, "name", "n").collect(), key=lambda r: r["running"])
    assert [(r["name"], r["running"]) for r in got] == [("a", 50), ("b", 70), ("c", 90)]


def test_pareto_of_a_long_tail_of_equal_counts(spark):
    rows = [(f"n{i:05}", 1) for i in range(3000)] + [("big", 900), ("mid", 40), ("mie", 40)]
    c = spark.createDataFrame(rows, "name string, n long").repartition(5)
    want, total, running = [], sum(n for _, n in rows), 0
    for name, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        if running >= int(0.8 * total):
            break
        running += n
        want.append((name, n, running))
    assert sorted(map(tuple, analyst.pareto(c, "name", "n").collect()), key=lambda r: r[2]) == want


def test_tlp_takes_the_last_tag(spark):
    t = spark.range(1).select(F.array(*[F.struct(F.lit(x).alias("name")) for x in ("TLP:red", "x", "tlp:green")]).alias("t")).select(analyst.tlp(F.col("t")), analyst.threat_level(F.lit("2")), analyst.tlp(F.filter("t", lambda x: x["name"] == "x"))).first()
    assert tuple(t) == ("green", "Medium", None)


def test_latest_two_and_diff(spark):
    f = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "name string, modified int")
    assert [r["name"] for r in analyst.latest(f).collect()] == ["b", "c"]
    d = analyst.table_diff(f, f.filter("name <> 'a'").union(spark.createDataFrame([("z", 9)], f.schema)))
    assert sorted((r["name"], r["side"]) for r in d.collect()) == [("a", "old"), ("z", "new")]
