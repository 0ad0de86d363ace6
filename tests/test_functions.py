"""Vectors for hashes, offsets, combinations, formulas, bits and names."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dnsketch.functions import formulas, hashing, inet, names
from dnsketch.model import BloomConfig, combination_count, lookup_combination
from dnsketch.operators import hll

# Offsets that a hash must give, and estimates below, which equal those of the older system
OFFSETS = [
    (0xDEADBEEF, 2, 1, [6, 7]),
    (0xDEADBEEF, 2, 1024, [5883, 7125]),
    (0xDEADBEEF, 3, 1024, [243, 5883, 7125]),
    (0xDEADBEEF, 2, 8192, [48879, 57005]),
    (0x99C0FFEE, 2, 1, [4, 6]),
    (0x99C0FFEE, 2, 1024, [1023, 4920]),
    (0x99C0FFEE, 6, 1024, [79, 1023, 1910, 4920, 4941, 7705]),
    (0x99C0FFEE, 2, 8192, [39360, 65518]),
    (10, 3, 1024, [0, 1, 1281]),
    (42, 3, 1024, [0, 1, 5376]),
    (0, 3, 1024, [0, 1, 2]),
    (0xFFFFFFFF, 3, 1024, [8189, 8190, 8191]),
]


@pytest.mark.parametrize("h,k,size,want", OFFSETS)
def test_offsets(h, k, size, want):
    assert hashing.offsets(np.array([[h]], np.uint64), 8 * size, k)[0].tolist() == want


def test_more_hashes_than_bits():
    assert hashing.offsets(np.array([[5]], np.uint64), 2, 4).tolist() == [[0, 0, 0, 1]]


@given(st.binary(min_size=32, max_size=32), st.integers(8, 1 << 31), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_offsets_are_distinct_and_sorted(b, m, k):
    k = min(k, m)
    got = hashing.offsets(hashing.limbs_of([b]), m, k)[0].tolist()
    assert got == sorted(set(got)) and 0 <= got[0] and got[-1] < m and len(got) == k


def test_few_hashes_fill_few_bits():
    hs = [0, 10, 42, 1337, 65535, 65536, 1213141516, 0xDEADBEEF, 0x99C0FFEE, 0xFFFFFFFF]
    assert len(set(hashing.offsets(np.array([[h] for h in hs], np.uint64), 8192, 3).ravel().tolist())) == 22


@pytest.mark.parametrize("n,m,k,want", [(0, 8, 1, 0), (3, 8, 1, 4), (7, 8, 1, 17), (8, 8, 1, 4294967295), (8, 8192, 3, 3), (64, 8192, 3, 21), (1024, 8192, 3, 365), (4096, 8192, 3, 1893), (8191, 8192, 3, 24606), (8192, 8192, 3, 4294967295), (22, 8192, 3, 7), (60, 8192, 3, 20), (151814229, 491040000, 10, 18161591), (118252441, 491040000, 10, 13528981)])
def test_approx_count(spark, n, m, k, want):
    assert spark.range(1).select(formulas.approx_count(F.lit(n), m, k)).first()[0] == want


def test_filter_hash_is_the_identity_for_the_first_filter():
    x = hashing.limbs_of([bytes(range(32))])
    assert (hashing.filter_hash(x, 0) == x).all()
    words = np.frombuffer(bytes(range(32)), "<u8").tolist()
    y = hashing.filter_hash(x, 2)[0].tolist()
    assert [y[2 * i] | y[2 * i + 1] << 32 for i in range(4)] == [w * 5 % (1 << 64) for w in words]


def test_combinations():
    assert combination_count(4, 2) == 6 and combination_count(5, 3) == 10
    assert [lookup_combination(4, 2, i) for i in range(6)] == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert BloomConfig(5, 1024, 3, 3).combos == [lookup_combination(5, 3, i) for i in range(10)]


@pytest.mark.parametrize("bad", [{"bits": 12}, {"hashes": 0}, {"filters": 2, "per_user": 3}, {"flatten": -1}])
def test_bad_geometry(bad):
    with pytest.raises(ValueError):
        BloomConfig(**bad)


def test_hll_of_5000_numbers(spark):
    def of(values):
        rows = spark.createDataFrame([(1, hashing.signed(hashing.murmur64a(v.to_bytes(4, "little")))) for v in values], "k int, h long")
        return hll.registers(rows, ["k"], "h")

    def n(t):
        return hll.estimated(t, ["k"]).first()["estimate"]

    a, b = of(range(5000)), of([5001])
    assert (n(a), n(b), n(hll.merged(a.union(b), ["k"])), n(hll.merged(a.union(b), ["k"], parity=True))) == (5020, 1, 5021, 5021)


def test_hll_is_within_a_tenth(spark):
    rows = spark.range(249_000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("h"))
    got = hll.estimated(hll.registers(rows, ["k"], "h"), ["k"]).first()["estimate"]
    assert abs(got / 249_000 - 1) < 0.1


def test_rank_and_register_match_plain_arithmetic(spark):
    values = [0, 1, -1, 1 << 14, 1 << 20, -(1 << 63), (1 << 62) + 5, 123456789012345]
    got = spark.createDataFrame([(v,) for v in values], "h long").select("h", hashing.register(F.col("h")).alias("r"), hashing.rank(F.col("h")).alias("k")).collect()
    for r in got:
        u = (r["h"] & (1 << 64) - 1 | 1 << 63) >> 14
        assert (r["r"], r["k"]) == (r["h"] & 16383, (u & -u).bit_length())


@pytest.mark.parametrize("n,want", [(2_578_756, [(40_810_000, 10), (54_450_000, 14), (67_980_000, 16)]), (19_300_734, [(305_250_000, 10), (407_000_000, 14), (508_750_000, 16)])])
def test_advice(spark, n, want):
    from dnsketch.operators.metrics import advice

    assert [formulas.advised(n, p) for p in (1e-3, 1e-4, 1e-5)] == want
    got = advice(spark.createDataFrame([(n,)], "n long"), "n").orderBy("one_in").collect()
    assert [(r["m"], r["k"]) for r in got] == want


def test_required_entropy():
    assert formulas.required_entropy(1 << 20, 10) == 200 and formulas.required_entropy(491_040_000, 18) == 522


def test_round_up_and_theoretical_rate(spark):
    r = spark.range(1).select(formulas.round_up(F.lit(101), 100), formulas.round_up(F.lit(101), 0), formulas.theoretical_fpr(F.lit(2), F.lit(100), F.lit(100))).first()
    assert (r[0], r[1]) == (200, 101) and math.isclose(r[2], (1 - math.exp(-2)) ** 2)


def test_tokens(spark):
    rows = [("www.example.com", "A", "X"), ("com", "A", "X"), ("4.3.2.1.in-addr.arpa", "PTR", "X"), ("a.b", "MX", None)]
    df = spark.createDataFrame(rows, "h string, t string, e string")
    got = [sorted(r[0]) for r in df.select(names.tokens(F.col("h"), F.col("t"), names.entity_or_unknown(F.col("e")))).collect()]
    assert got[0] == sorted(["www.example.com", "www", "example", "example.com", "X@www.example.com", "X@www", "X@example"])
    assert got[1] == sorted(["com", "", "X@com"])
    assert got[2] == sorted(["4.3.2.1.in-addr.arpa", "X@4.3.2.1.in-addr.arpa"])
    assert got[3] == sorted(["a.b", "a", "a.b", "UNKNOWN@a.b", "UNKNOWN@a"])
    plus = df.limit(1).select(names.tokens(F.col("h"), F.col("t"), F.col("e"), entity_sld=True)).first()[0]
    assert "X@example.com" in plus


def test_names(spark):
    r = spark.createDataFrame([("WWW.Ex.org..", "ent@a@b", "plain")], "q string, t string, p string").select(
        names.normalised("q"), names.evaluated("q"), names.entity_part(F.col("t")), names.host_part(F.col("t")), names.entity_part(F.col("p")), names.host_part(F.col("p")), names.reverse_pointer6(F.lit("20010db8000000000000000000000001"))
    ).first()
    assert list(r)[:6] == ["www.ex.org.", "WWW.Ex.org", "ent", "a@b", None, "plain"]
    assert r[6] == "1.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.0.8.b.d.0.1.0.0.2.ip6.arpa"


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("2001:db8::1",), ("1.2.3.400",), (None,)], "t string")
    got = df.select(inet.address(F.col("t")).alias("a"), inet.ipv4_number(F.col("t")).alias("n")).collect()
    assert [(r["a"]["af"], r["a"]["text"], r["n"]) for r in got] == [(4, "1.2.3.4", 16909060), (6, "2001:db8::1", None), (None, None, None), (None, None, None)]
    assert inet.endpoint("[::1]:53") == ("::1", 53) and inet.endpoint("*") == ("*", None) and inet.endpoint("10.0.0.1:8") == ("10.0.0.1", 8)
    for bad in ("1.2.3.4:0", "1.2.3.4:70000", "nonsense"):
        with pytest.raises(ValueError):
            inet.endpoint(bad)


def test_bits(spark):
    from dnsketch.functions import bits

    r = spark.range(1).select(bits.set_bit(F.lit(0).cast("long"), 40), bits.clear_bit(F.lit(7).cast("long"), 1), bits.test_bit(F.lit(4).cast("long"), 2), bits.bits_of(F.lit(37).cast("long"))).first()
    assert list(r) == [1 << 40, 5, True, [0, 2, 5]]


def test_bignum_times_three(spark):
    from dnsketch.functions import bits

    h = "01020304020304050304050606070809"
    want, n = int.from_bytes(bytes.fromhex(h), "little"), bits.limbs(F.lit(h))
    over = []
    for _ in range(4):
        p = spark.range(1).select(bits.times(n, F.lit(3)).alias("p")).first()["p"]
        over.append(p["overflow"])
        want = want * 3 % (1 << 128)
        assert sum(x << 16 * i for i, x in enumerate(p["limbs"])) == want
        n = F.array(*[F.lit(x).cast("long") for x in p["limbs"]])
    assert over == [0, 0, 0, 2]


def test_bits_of_a_bitmap(spark):
    from dnsketch.functions import bits

    b = spark.createDataFrame([(0,), (9,), (32767,)], "p int").agg(F.bitmap_construct_agg("p").alias("b"))
    got = b.select(*[bits.has_bit(F.col("b"), F.lit(p)) for p in (0, 1, 9, 8, 32767, 32766)]).first()
    assert list(got) == [True, False, True, False, True, False]


@pytest.mark.parametrize("most", [4_000_000, 5])
def test_bucketed_offsets(spark, most):
    """The bits of each (key, filter, bucket), whether gathered in one go or in several."""
    digests = [bytes([i] * 32) for i in range(7)]
    rows = [(i % 2, i % 3, d) for i, d in enumerate(digests)] + [(0, 0, b"x"), (1, 1, None)]
    df = spark.createDataFrame(rows, "key long, filter_idx int, digest binary").select(F.timestamp_seconds("key").alias("key"), "filter_idx", "digest").repartition(2)
    got = hashing.bucketed_offsets(df, 4096, 3, 1024, key="key", most=most)
    bits = {(r["k"], r["filter_idx"], r["bucket"] * 1024 + r["o"]) for r in got.select(F.col("key").cast("long").alias("k"), "filter_idx", "bucket", F.explode("bits").alias("o")).collect()}
    assert bits == {(i % 2, i % 3, o) for i, d in enumerate(digests) for o in hashing.offsets(hashing.filter_hash(hashing.limbs_of([d]), i % 3), 4096, 3)[0].tolist()}
    assert hashing.bucketed_offsets(df.limit(0), 4096, 3, 1024, key="key").count() == 0


@given(st.lists(st.binary(max_size=33), min_size=1, max_size=8))
@settings(max_examples=40, deadline=None)
def test_murmur_of_rows(values):
    n = len(values[0])
    same = [v for v in values if len(v) == n]
    rows = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), n)
    assert hashing.murmur_rows(rows).tolist() == [hashing.murmur64a(v) for v in same]


def test_murmur_of_a_column(spark):
    values = [b"\x01\x02\x03\x04", None, b"", bytes(range(16)), b"\xff" * 4]
    got = [r["h"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b binary").coalesce(1).orderBy("i").select(hashing.murmur_of("b").alias("h")).collect()]
    assert got == [None if v is None else hashing.signed(hashing.murmur64a(v)) for v in values]
