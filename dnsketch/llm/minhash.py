"""Operator 4: near duplicates by SuperMinHash, banding, verification on full sets and union-find.

A document's set holds its distinct shingles of five words. SuperMinHash gives each element a random permutation of
the slots with increasing ranks; a slot keeps the smallest rank value that fell on it, and a document is finished once
every slot is below the next rank. Documents with equal sets are one representative from the start. Representatives
that share a band are compared with a pivot of that band, never all with all: first with its smallest id, then with the
member most like that pivot (in a group of noisy copies: their original). What is still in several components is
compared across components only: pair by pair in small bands, block by block and without a row per pair in large ones.
Each compared pair is confirmed on the full sets of the whole texts.

Chance that a pair at exactly 0.75 shares no band: (1 - 0.75^5)^36, about 6 in 100,000.

Defined results: no words or null text: an empty set, linked with nothing. Fewer than five words: the whole sequence is
the one element. A null doc_id takes no part: component_id null, kept true. Rows with the same doc_id are one document
with the texts of each; all its rows get the same component, and links of any of them count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsketch.llm.common import Scratch, UnionFind, batches_of, components, listed, release, words_of

WORDS, ROWS, BANDS = 5, 5, 36
SLOTS = ROWS * BANDS
FEW = 48  # members of a band up to which it is compared pair by pair in the last step
BLOCK, BLOCK_ELEMENTS = 400, 200_000  # members, or elements of their sets, of a block
AT_ONCE = 60_000  # elements whose permutations are in memory
LIKE = (75, 100)  # linked: LIKE[1] * intersection >= LIKE[0] * union
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and the number of words of each text."""
    import xxhash

    flat, counts = words_of(texts, lower=True)
    d = flat.dictionary_encode()
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in listed(d.dictionary)), np.uint64, len(d.dictionary))
    return of[np.asarray(d.indices)] if len(of) else np.zeros(0, np.uint64), counts


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    h, counts = word_hashes(texts)
    n = len(h) - WORDS + 1
    s = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS):
        if n > 0:
            s += MULT[k] * h[k : k + n]
    s = mixed(s)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WORDS:
            out.append(np.unique(s[at : at + c - WORDS + 1]))
        elif c:
            few = (MULT[:c] * h[at : at + c]).sum(dtype=np.uint64) + np.uint64(c)
            out.append(mixed(mixed(np.array([few], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: (rank, random) packed in 64 bits per slot; all ones where the set is empty."""
    sig = np.full((len(sets), slots), np.iinfo(np.int64).max, np.int64)
    lo = 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= AT_ONCE):
            total += len(sets[hi])
            hi += 1
        if total > AT_ONCE:  # one large set: in parts, all ranks that may still count
            for k in range(0, total, AT_ONCE):
                _ranks([sets[lo][k : k + AT_ONCE]], sig[lo:hi], slots)
        elif total:
            _ranks(sets[lo:hi], sig[lo:hi], slots)
        lo = hi
    return sig


def _ranks(sets: list[np.ndarray], sig: np.ndarray, slots: int) -> None:
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = sig.reshape(-1)
    perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
    row = np.arange(len(x))
    for j in range(slots):
        z = mixed(x + np.uint64((j + 1) * int(GOLD) & (1 << 64) - 1))
        k = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        r = row[: len(x)]
        slot = perm[r, k]
        perm[r, k] = perm[:, j]
        np.minimum.at(flat, doc * slots + slot, (np.int64(j) << np.int64(32)) | (z >> np.uint64(32)).astype(np.int64))
        open_ = sig.max(1) >> 32 > j  # a slot that a later rank could still lower
        if not open_.any():
            return
        go = open_[doc]
        if (n := int(go.sum())) < 0.7 * len(x):
            x, doc, perm = x[go], doc[go], perm[go]
        if not n:
            return


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.zeros(s.shape[:2], np.uint64)
    for k in range(ROWS):
        key = mixed(key * MULT[0] + s[:, :, k] + GOLD)
    return mixed(key + np.arange(BANDS, dtype=np.uint64)[None] * MULT[1]).astype(np.int64)


def _sketched(batches):
    import xxhash

    for whole in batches:
        for batch in batches_of(whole, 1, 4 << 20):
            sets = shingle_sets(batch.column(1))
            keys = band_keys(signatures(sets))
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            n = np.array([len(s) for s in sets], np.int64)
            two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(two[:, 0]), pa.array(two[:, 1]), bands], names=["doc_id", "t", "n", "h1", "h2", "bands"])
    release()


def _confirmed(batches):
    """(a, ta, b, tb, text of a, text of b) -> (a, ta, b, tb, like): intersection over union, negative below the bound."""
    for whole in batches:
        for batch in batches_of(whole, 4, 4 << 20):
            a, b = (list(zip(*(batch.column(k).to_pylist() for k in (i, i + 1)), strict=True)) for i in (0, 2))
            place: dict[tuple[int, int], int] = {}
            first: list[tuple[int, int]] = []
            for col, ids in ((4, a), (5, b)):
                for i, x in enumerate(ids):
                    if x not in place:
                        place[x] = len(first)
                        first.append((col, i))
            texts = pa.array([batch.column(c)[i].as_py() for c, i in first], pa.large_string())
            sets = shingle_sets(texts)
            like = np.full(len(a), -1.0)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = sets[place[x]], sets[place[y]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                union = len(s) + len(t) - both
                if both and LIKE[1] * both >= LIKE[0] * union:
                    like[i] = both / union
                elif union:
                    like[i] = both / union - 1  # negative, but in order
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(like)], names=["xm", "xt", "ym", "yt", "like"])
    release()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (x, y) of representatives with their likeness on full sets.

    Both texts come by plain equi-joins between written tables, so a hot pivot's partition can be split at run time.
    """
    one = pairs.join(texts.select(F.col("rep").alias("x"), F.col("text").alias("tx")), "x")
    two = one.join(texts.select(F.col("rep").alias("y"), F.col("text").alias("ty")), "y")
    got = two.select(*[F.col(c).alias(c.replace(".", "")) for c in ("x.m", "x.t", "y.m", "y.t")], "tx", "ty").mapInArrow(_confirmed, "xm long, xt long, ym long, yt long, like double")
    return got.select(vertex("xm", "xt").alias("x"), vertex("ym", "yt").alias("y"), "like")


def vertex(m: str, t: str) -> Column:
    """A row by its id and the hash of its text: rows of one id may have several texts."""
    return F.struct(F.col(m).alias("m"), F.col(t).alias("t"))


def near_duplicates(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    sketch = scratch.save(rows.mapInArrow(_sketched, "doc_id long, t long, n long, h1 long, h2 long, bands array<long>"), "sketch")
    real = sketch.filter("n > 0 and doc_id is not null")
    # a set's representative is the row with the smallest id; links are between ids, bands and texts belong to rows
    same = scratch.save(real.groupBy("h1", "h2").agg(F.min(vertex("doc_id", "t")).alias("v"), F.min("n").alias("n")), "same")
    first = real.withColumn("v", vertex("doc_id", "t")).join(same.select("h1", "h2", "v"), ["v", "h1", "h2"])
    keyed = scratch.save(first.select(F.explode("bands").alias("key"), "v", "n").distinct(), "keyed")
    pivots = scratch.save(keyed.groupBy("key").agg(F.min("v").alias("p"), F.max("v").alias("last")).filter("p <> last").select("key", "p"), "pivots")
    live = scratch.save(keyed.join(pivots, "key").select("key", "v", "n", "p"), "live")
    scratch.drop("keyed", "pivots")

    linked = live.select("v").distinct()
    texts = rows.filter("doc_id is not null and text is not null").select(vertex("doc_id", "t").alias("v"), "text").join(linked, "v", "left_semi").select(F.col("v").alias("rep"), "text").distinct()
    texts = scratch.save(texts, "texts")
    ends = (F.least("v", "p").alias("x"), F.greatest("v", "p").alias("y"))

    # 1: all members of a band with its smallest one
    like = scratch.save(_verified(live.filter("v <> p").select(*ends).distinct(), texts), "like1")
    links = _ids(like.filter("like > 0"))
    live = _unsettled(live, links, scratch)
    # 2: with the member most like that one
    near = like.groupBy("x", "y").agg(F.max("like").alias("like"))
    seen = live.filter("v <> p").withColumns({"x": F.least("v", "p"), "y": F.greatest("v", "p")}).join(near, ["x", "y"])
    best = scratch.save(seen.groupBy("key").agg(F.max_by("v", F.struct("like", -F.col("v.m"), "v.t")).alias("q")), "best")
    pairs = live.drop("p").join(best, "key").filter("v <> q").select(F.least("v", "q").alias("x"), F.greatest("v", "q").alias("y")).distinct()
    pairs = scratch.save(pairs.join(near, ["x", "y"], "left_anti"), "pairs")
    like = scratch.save(_verified(pairs, texts), "like2")
    links = links.union(_ids(like.filter("like > 0")))
    live = _unsettled(live, links, scratch)
    # 3: what is still in several components, across these: in small bands pair by pair, in large ones block by block
    size = scratch.save(live.groupBy("key").agg(F.count(F.lit(1)).alias("of")), "size")
    live = scratch.save(live.join(size, "key"), "live")
    few = live.filter(F.col("of") <= FEW)
    a, b = (few.select("key", F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}")) for x in "xy")
    across = a.join(b, "key").filter(f"x < y and cx <> cy and least(nx, ny) * {LIKE[1]} >= greatest(nx, ny) * {LIKE[0]}")
    pairs = scratch.save(across.select("x", "y").distinct(), "pairs")
    like = scratch.save(_verified(pairs, texts), "like3")
    links = links.union(_ids(like.filter("like > 0"))).union(_in_blocks(live.filter(F.col("of") > FEW), texts, scratch))

    # repeated ids with different texts tie their sets together
    named = real.select("doc_id", "h1", "h2").join(same.select("h1", "h2", F.col("v.m").alias("rep")), ["h1", "h2"])
    several = named.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    links = links.union(named.join(several, "doc_id").select("lo", "rep")).toDF("a", "b")
    label = components(links, scratch)
    of_set = same.join(label, F.col("v.m") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "v.m").alias("component_id"))
    out = sketch.filter("n > 0").select("doc_id", "n", "h1", "h2").join(of_set, ["h1", "h2"], "left").select("doc_id", "n", "component_id")
    # rows without words have the component of their id's other rows
    blank = sketch.filter("n = 0").select("doc_id", "n")
    others = real.select("doc_id", "h1", "h2").join(blank.select("doc_id").distinct(), "doc_id", "left_semi").join(of_set, ["h1", "h2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = out.unionByName(blank.join(others, "doc_id", "left"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept"))
    result = scratch.save(out, "result")
    scratch.drop(*[x for x in scratch.at if x != "result"])  # whole texts among them
    return result


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x.m").alias("x"), F.col("y.m").alias("y"))


def _in_blocks(live: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components of large bands, without a row per pair.

    Large bands that share members are one cluster. Its stated queries are the members outside its largest component:
    of any pair in two components, at least one is among them. Members are told apart by the size of their sets, in
    classes that grow by 4 / 3: linked sets are in the same class or in neighbours. Blocks of queries meet blocks of
    members of those classes in a task that counts common elements through an inverted list and returns a union-find
    forest of the links. Sets are made once and travel as 64-bit numbers.
    """
    lowest = live.groupBy("key").agg(F.min("v.m").alias("p"))
    ties = live.select("key", "v.m").join(lowest, "key").select(F.col("m").alias("a"), F.col("p").alias("b"))
    cluster = scratch.save(components(ties, scratch).toDF("m", "cl"), "cluster")
    # one component and size for each member; a bare band of one member has no tie and no pair either
    of = live.groupBy("v").agg(F.min("c").alias("c"), F.max("n").alias("n")).withColumn("m", F.col("v.m")).join(cluster, "m")
    of = scratch.save(of, "of")
    big = of.groupBy("cl", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("cl").agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("big"))
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(LIKE[1] / LIKE[0])) + 1e-9)
    mark = of.join(big, "cl").select("cl", "v", "m", "c", "n", (F.col("c") != F.col("big")).alias("asks"), size.alias("s"))
    cost = F.ceil(F.sum(F.lit(1.0 / BLOCK) + F.col("n") / BLOCK_ELEMENTS)).cast("int")
    asks = mark.filter("asks").withColumn("s", F.explode(F.array(*[F.col("s") + i for i in (-1, 0, 1)])))
    plan = mark.groupBy("cl", "s").agg(cost.alias("mb")).join(asks.groupBy("cl", "s").agg(cost.alias("qb")), ["cl", "s"])
    plan = scratch.save(plan, "plan")
    sets = scratch.save(mark.join(texts.withColumnRenamed("rep", "v"), "v").select("cl", "s", "m", "c", "asks", "text").mapInArrow(_numbers, "cl long, s long, m long, c long, asks boolean, elements binary"), "sets")
    deal = lambda n, salt: F.pmod(F.xxhash64("m", F.lit(salt)), F.col(n)).cast("int")
    left = sets.filter("asks").withColumn("s", F.explode(F.array(*[F.col("s") + i for i in (-1, 0, 1)]))).join(plan, ["cl", "s"])
    left = left.select(F.col("cl").alias("qcl"), F.col("s").alias("qs"), F.col("m").alias("qm"), F.col("c").alias("qc"), F.col("elements").alias("qe"), deal("qb", 1).alias("q"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("b"))
    right = sets.join(plan, ["cl", "s"]).select("cl", "s", "m", "c", "elements", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), deal("mb", 2).alias("b"))
    found = left.groupBy("qcl", "qs", "q", "b").cogroup(right.groupBy("cl", "s", "q", "b")).applyInArrow(_block, "x long, y long")
    return scratch.save(found, "blocks")


def _numbers(batches):
    """The text in the last column -> its set as bytes."""
    for whole in batches:
        for batch in batches_of(whole, 5, 4 << 20):
            sets = [s.tobytes() for s in shingle_sets(batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.binary())], names=["cl", "s", "m", "c", "asks", "elements"])
    release()


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    uf = UnionFind()
    if left.num_rows and right.num_rows:
        qs, ms = ([np.frombuffer(e, np.uint64) for e in t[c].to_pylist()] for t, c in ((left, "qe"), (right, "elements")))
        qn, mn = (np.array([len(s) for s in x], np.int64) for x in (qs, ms))
        qid, mid, qc, mc = (np.asarray(t[c]) for t, c in ((left, "qm"), (right, "m"), (left, "qc"), (right, "c")))
        elements = np.concatenate(qs)
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], np.repeat(np.arange(len(qs)), qn)[order]
        for k, s in enumerate(ms):
            lo, hi = np.searchsorted(elements, s, "left"), np.searchsorted(elements, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            both = np.bincount(owner[at], minlength=len(qs))
            hit = (LIKE[1] * both >= LIKE[0] * (qn + mn[k] - both)) & (both > 0) & (qc != mc[k])
            for j in np.flatnonzero(hit).tolist():
                uf.union(int(qid[j]), int(mid[k]))
    ends = [(x, uf.find(x)) for x in uf.up if uf.find(x) != x]
    return pa.table({"x": pa.array([e[0] for e in ends], pa.int64()), "y": pa.array([e[1] for e in ends], pa.int64())})


def _unsettled(live: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of live whose band still has members of several components, with their component c."""
    label = components(links.toDF("a", "b"), scratch)
    now = live.select("key", "v", "n", "p").join(label, F.col("v.m") == F.col("node"), "left").select("key", "v", "n", "p", F.coalesce("component", "v.m").alias("c"))
    now = scratch.save(now, "named")
    open_ = scratch.save(now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key"), "open")
    return scratch.save(now.join(open_, "key"), "live")


def drop_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each group, with docs' columns: rows whose id is the smallest of its component."""
    found = near_duplicates(docs, scratch).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_id"]), "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
