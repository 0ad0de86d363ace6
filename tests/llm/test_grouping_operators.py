"""Operators 4, 5, 6 and 7, components and ranks on small tables, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsketch.llm import hnsw, kdshard, minhash, mtree
from dnsketch.llm.common import Scratch, bounded, components, ranked


def roots(n, links):
    up = {x: x for x in n}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


@pytest.mark.parametrize("one_task", [10**6, 3])
def test_components(spark, one_task):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {x["node"]: x["component"] for x in components(df, Scratch(spark), one_task).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in roots(nodes, [(a, b) for a, b in links if a != b]).items()}
    assert components(df.limit(0), Scratch(spark)).count() == 0


def test_ranks_are_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    got = defaultdict(list)
    for x in ranked(df, ["g"], [F.col("id")], "rank", 7).collect():
        got[x["g"]].append(x["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def check_minhash(spark, texts):
    bounded(spark)
    s = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    want = roots(s, links)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, Scratch(spark)).collect()}
    assert len(got) == len(texts)
    for i in s:
        assert (i, got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (i, len(s[i]), want[i], want[i] == i)
    return df


def noisy(base, words, r, n):
    t = list(base)
    for k in r.sample(range(len(t)), n):
        t[k] = r.choice(words)
    return " ".join(t)


def test_minhash_and_its_pipeline_stage(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(90)]
    texts = [None, "", " \n", "one two", "One  two", "one two three", "É a b c d e", " ".join(base), "  ".join(base).upper().replace("W", "w"), *(noisy(base, words, r, n) for n in (1, 2, 2, 3, 4, 5, 8, 20)), "x " * 3000, "x " * 3001]
    df = check_minhash(spark, texts)
    kept = minhash.drop_copies(df, Scratch(spark))
    want = {r["doc_id"] for r in minhash.near_duplicates(df, Scratch(spark)).filter("kept").collect()}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == want
    assert minhash.near_duplicates(df.limit(0), Scratch(spark)).count() == 0


def test_minhash_of_a_large_group_goes_by_blocks(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(800)]
    base = [r.choice(words) for _ in range(100)]
    check_minhash(spark, [noisy(base, words, r, r.choice((0, 1, 3, 4, 5, 6, 7, 8))) for _ in range(260)])


def test_minhash_odd_ids(spark):
    bounded(spark)
    t = " ".join(f"a{i}" for i in range(40))
    u = " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (3, t), (3, u), (9, u), (3, t), (12, "z")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(df, Scratch(spark)).collect())
    assert got == [(-1, -1, True), (3, 3, True), (3, 3, True), (3, 3, True), (9, 3, False), (12, 12, True)]
    assert sorted(r["doc_id"] or -1 for r in minhash.drop_copies(df, Scratch(spark)).collect()) == [-1, 3, 3, 3, 12]


def test_minhash_of_an_id_with_several_near_texts(spark):
    """Links of any of an id's texts count, and its rows without words share its component."""
    bounded(spark)
    r = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    base = [[r.choice(words) for _ in range(61)] for _ in range(5)]
    a, b, c, d, e = (" ".join(x) for x in base)
    near = [noisy(x, ["other"], r, 1) for x in base]
    rows = [(3, a), (3, b), (9, near[1]), (12, near[0]), (5, None), (5, c), (2, near[2]), (7, d), (7, ""), (8, e), (1, near[4]), (1, near[3]), (20, "")]
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(i, j) for i, s in sets for j, t in sets if i != j and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    want = roots({i for i, _ in rows}, links)
    assert want == {3: 3, 9: 3, 12: 3, 5: 2, 2: 2, 7: 1, 8: 1, 1: 1, 20: 20}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(df, Scratch(spark)).collect())
    assert got == sorted((i, len(s), want[i], want[i] == i) for i, s in sets)
    assert {x["doc_id"] for x in minhash.drop_copies(df, Scratch(spark)).collect()} == {1, 2, 3, 20}


def test_signatures_estimate_jaccard():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = np.concatenate([a[:200], np.unique(r.integers(0, 1 << 63, 100, dtype=np.uint64))])
    s = minhash.signatures([a, b, a[:1], a[:0]])
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
    assert (s[3] == np.iinfo(np.int64).max).all() and len(set(s[2].tolist())) == minhash.SLOTS
    old, minhash.AT_ONCE = minhash.AT_ONCE, 50
    try:
        assert (minhash.signatures([a, b]) == s[:2]).all()  # a large set in parts
    finally:
        minhash.AT_ONCE = old


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1) for i, e in rows], "vec_id long, embedding array<float>, label int")


def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    e = [*base, *(base[i % 20] + 0.1 * r.normal(size=16) for i in range(120)), *base[:5]]
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(e)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (None, base[0].astype(np.float32))]
    got = {x["vec_id"]: x for x in hnsw.near_duplicates(vectors(spark, rows + odd), Scratch(spark)).collect()}
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    want = roots(range(len(e)), np.argwhere(s).tolist())
    for i in range(len(e)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (s[i].sum(), want[i], want[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(900, 905))
    assert (got[905]["n_links"], got[906]["component_id"]) == (1, 905)
    assert hnsw.near_duplicates(vectors(spark, []), Scratch(spark)).count() == 0


def test_graph_search_has_high_recall(monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + 0.04 * r.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1)[:, None]
    levels = (-np.log(1 - r.random(3000)) / np.log(16)).astype(int)
    g = hnsw.Graph.load(x, hnsw.Graph(x, levels).dump())
    ids, _ = g.search(y, 32)
    assert (ids[:, :3] == np.arange(3000)[:, None]).any(1).mean() > 0.98
    truth = (y[:400] @ x.T >= 0.95).sum()
    audit = {}
    assert sum(len(i) for i, _ in hnsw.links_of(x, g, y[:400], 0.95, audit=audit)) >= 0.99 * truth
    assert audit["true"] == audit["found"] > 0


def test_forest_joins_many_links_at_once():
    r = np.random.default_rng(5)
    f, links = hnsw.Forest(300), []
    for _ in range(4):
        a, b = r.integers(0, 300, 50), r.integers(0, 300, 50)
        f.join(a, b)
        links += list(zip(a.tolist(), b.tolist(), strict=True))
        want = roots(range(300), links)
        assert f.up.tolist() == [want[i] for i in range(300)]


def test_a_dense_cluster_takes_bounded_memory():
    """40,000 points within 0.95 of each other: 2,000 queries have 80 million links, none of which is kept."""
    import tracemalloc

    r = np.random.default_rng(2)
    x = r.normal(size=16) + 0.02 * r.normal(size=(40_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph(x)
    g.links, g.upper = np.tile(np.arange(1, 9, dtype=np.int32), (40_000, 1)), []  # any graph: beams of links are full
    tracemalloc.start()
    forest, n = hnsw.Forest(40_000), 0
    for qi, xi in hnsw.links_of(x, g, x[:2_000], 0.95):
        forest.join(qi, xi)
        n += len(qi)
    assert n == 2_000 * 40_000 and not forest.up.any() and tracemalloc.get_traced_memory()[1] < 900 << 20
    tracemalloc.stop()


def test_vectors_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 150)
    r = np.random.default_rng(8)
    base = r.normal(size=(300, 12))
    e = np.vstack([base, base[:200] + 0.06 * r.normal(size=(200, 12)), base[:3].repeat(60, 0) + 0.01 * r.normal(size=(180, 12))]).astype(np.float32)
    scratch = Scratch(spark)
    got = {x["vec_id"]: x for x in hnsw.near_duplicates(vectors(spark, list(enumerate(e))), scratch).collect()}
    u = e.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    want = roots(range(len(e)), np.argwhere(s).tolist())
    assert all((got[i]["n_links"], got[i]["component_id"]) == (s[i].sum(), want[i]) for i in range(len(e)))
    found, true = hnsw.audited(scratch)
    assert found == true > 100


@pytest.mark.parametrize("small", [False, True])
def test_top_inner_products(spark, monkeypatch, small):
    if small:  # several cells, trees and query blocks
        for name, v in (("TREE_BYTES", 40 * 48), ("QUERY_BYTES", 96), ("PAGE", 8), ("CELLS", 3)):
            monkeypatch.setattr(mtree, name, v)
    r = np.random.default_rng(7)
    e = [r.normal(size=6) * r.choice([0.2, 1, 3]) for _ in range(160)] + [np.zeros(6)] * 12 + [np.ones(6)] * 3
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(e)]
    odd = [(900, None), (950, [None] * 6), (1000, [float("inf")] * 6), (1050, [1.0, 1.0]), (1051, [1.0, 2.0]), (None, e[0].astype(np.float32))]
    got = defaultdict(list)
    for x in mtree.top(vectors(spark, rows + odd), Scratch(spark)).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    q = np.floor(256 * np.array([v for _, v in rows], float)).astype(int)
    for i in range(0, len(e), 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(len(e)), -s)) if j != i][:5]
        assert got.pop(i) == [(k + 1, j, s[j]) for k, j in enumerate(best)]
    assert got == {1050: [(1, 1051, 256 * 256 * 3)]}
    assert mtree.top(vectors(spark, []), Scratch(spark)).count() == 0


def test_top_of_clusters_avoids_most_computations(spark, monkeypatch):
    """With the default page of 256, in several trees: exact, and less than a third of all scores computed."""
    monkeypatch.setattr(mtree, "TREE_BYTES", 1000 * 8 * 16)
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    e = np.repeat(centres, 150, axis=0) + 0.03 * r.normal(size=(6000, 16))
    e /= np.linalg.norm(e, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(e)], "vec_id long, embedding array<double>")
    work = {}
    got = defaultdict(list)
    for x in mtree.top(df, Scratch(spark), work=work).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    q = np.floor(256 * e).astype(int)
    for i in range(0, 6000, 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(6000), -s)) if j != i][:5]
        assert sorted(got[i]) == [(k + 1, j, s[j]) for k, j in enumerate(best)]
    assert work["all"] == 120 * 6000 and work["computed"] < work["all"] / 3


def test_top_of_enormous_components(spark):
    big = 1e200
    e = {0: [big, 1.0], 1: [big, 0.0], 2: [-big, 1.0], 3: [1.0, 1.0], 4: [1e308, 1.0], 50: [2.0**61, 0.0], 51: [0.0, 1.0]}
    df = spark.createDataFrame([(i, v) for i, v in e.items()], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in mtree.top(df, Scratch(spark)).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    top = mtree.LARGEST
    assert got == {0: [(1, top), (3, top), (50, top), (51, 65536), (2, -top - 1)], 50: [(0, top), (1, top), (3, top), (51, 0), (2, -top - 1)]}


def test_shards(spark):
    r = random.Random(3)
    texts = [None, "", *("x" * r.randint(0, 300) + "\n" * r.randint(0, 3) for _ in range(700)), *["copy of one text"] * 3, *["heavy " * 40] * 300, *["half a shard " * 6] * 100]
    df = spark.createDataFrame([(i, t, "abc"[i % 3], f"s{i % 7}" if i % 5 else None, None if i % 11 == 0 else i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, size int")
    rows = kdshard.shard(df, Scratch(spark), 10).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(len(texts)))
    by, where = defaultdict(list), defaultdict(set)
    for x in rows:
        t = texts[x["doc_id"]]
        b = (t or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(b) + 16, zlib.crc32(b), "bytes", None)
        by[x["shard"]].append(x)
        where[t or ""].add(x["shard"])
    assert set(by) <= set(range(10)) and all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    total = [sum(x["size"] for x in v) for v in by.values()]
    part = sum(total) / 10
    assert len(total) == 10 and max(total) < 1.03 * part and min(total) > 0.97 * part
    # equal texts are together, but for those that outweigh a shard
    weight = Counter()
    for x in rows:
        weight[texts[x["doc_id"]] or ""] += x["size"]
    assert all(len(w) == 1 for t, w in where.items() if weight[t] <= part) and len(where["heavy " * 40]) > 1
    assert 0.3 * part < weight["half a shard " * 6] < part
    assert kdshard.shard(df.limit(0), Scratch(spark)).count() == 0
    assert Counter(x["shard"] for x in kdshard.shard(df.limit(1), Scratch(spark)).collect()).total() == 1
    few = kdshard.shard(df, Scratch(spark), target=int(4 * part)).groupBy("shard").count().collect()
    assert len(few) == 3


def test_shards_are_those_of_a_plain_tree(spark):
    """Without heavy points: every cut is at the weighted median along the widest dimension."""
    r = random.Random(6)
    texts = ["y" * r.randint(1, 40) + str(i) for i in range(3000)]
    df = spark.createDataFrame([(i, t, r.random(), r.random() * 3) for i, t in enumerate(texts)], "doc_id long, text string, a double, b double")
    where = {x["doc_id"]: x["shard"] for x in kdshard.shard(df, Scratch(spark), 8, dimensions=[F.col("a"), F.col("b")]).collect()}
    at = {x["doc_id"]: (x["a"], x["b"] / 3) for x in df.collect()}
    size = [len(t) + 16 for t in texts]
    plain = {}

    def grow(ids, first, n):
        if n == 1:
            plain.update(dict.fromkeys(ids, first))
            return
        d = max((0, 1), key=lambda k: max(at[i][k] for i in ids) - min(at[i][k] for i in ids))
        ids, total, left = sorted(ids, key=lambda i: at[i][d]), sum(size[i] for i in ids), 0
        k = 0
        while left + size[ids[k]] / 2 < total / 2:
            left += size[ids[k]]
            k += 1
        grow(ids[:k], first, n // 2)
        grow(ids[k:], first + n // 2, n - n // 2)

    grow(range(3000), 0, 8)
    assert sum(plain[i] == where[i] for i in plain) >= 2970  # but for points at a cut
