"""Operator 6: sharding by a k-d tree over metadata, cut at distributed weighted medians.

The shards are as many as the target bytes ask for (or a given number). Rows with equal texts are one point, with the
bytes of all of them as its weight and the smallest of each of their metadata dimensions as its place. A node that
stands for several shards is cut along the dimension in which its points spread widest (each dimension is scaled to the
whole table first), at the point where the bytes on either side are in proportion to the room there. A cut is found in
passes over histograms, each pass inside the bin that holds the cut, until that bin is lighter than a small part of a
shard; ties within a dimension are told apart by a hash of the text. Only histograms and bounds reach the driver.

A point too heavy for a fine cut (over HEAVY of a shard, so there are few) is put whole into the shard that is emptiest so
far, heaviest first, before the tree deals out what room is left. Only where the copies of one text outweigh a whole
shard are their rows told apart by doc_id as well: no shard could hold them.

Defined results: a null text has 0 bytes and crc32 of the empty text, and counts as equal to an empty one; null
dimensions count as 0; rows that are equal in text and doc_id and outweigh a shard are told apart by their place in the
file; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsketch.llm.common import Scratch, ranked

ROW = 16  # bytes that a row takes besides its text
BINS = 4096  # of a node's histogram, more where few nodes are open
FINE = 0.002  # of a shard's bytes: a bin lighter than this is not searched further
HEAVY = 0.02  # of a shard's bytes: at most shards / HEAVY points weigh more


@dataclass
class Node:
    first: int  # shard
    shards: int
    room: list[float]  # bytes for each of them
    dim: int = -1
    cut: int = 0  # keys below it go left
    left: "Node | None" = None
    right: "Node | None" = None


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW


def dimensions_of(docs: DataFrame, text: str = "text") -> list[Column]:
    """Bytes of the text (logarithm), and of the table's metadata columns: numbers as they are, n_chars by its logarithm, strings
    by their first bytes, so that names that sort together are near each other."""
    out = [F.log1p(F.octet_length(text).cast("double"))]
    for f in docs.schema:
        if f.name in ("n_chars", "length", "size"):
            out.append(F.log1p(F.greatest(F.col(f.name).cast("double"), F.lit(0.0))))
        elif isinstance(f.dataType, T.StringType) and f.name != text:
            out.append(F.conv(F.hex(F.rpad(F.substring(F.encode(F.col(f.name), "utf-8"), 1, 6), 6, b"\0")), 16, 10).cast("double"))
    return out


def _leaf(root: Node, key) -> Column:
    """The path through the tree as an expression: the number of the leaf, in `open leaves` order."""

    def walk(n: Node) -> Column:
        if n.left is None:
            return F.lit(n.first)
        return F.when(key[n.dim] < n.cut, walk(n.left)).otherwise(walk(n.right))

    return walk(root)


def _leaves(n: Node) -> list[Node]:
    return [n] if n.left is None else _leaves(n.left) + _leaves(n.right)


def grow(points: DataFrame, dims: int, weight: str, room: list[float]) -> Node:
    """The tree over points(x0, x1, ... scaled to 31 bits, tie of 31 bits, weight); room: bytes for each shard."""
    shards, part = len(room), sum(room) / len(room)
    root = Node(0, shards, room)
    keys = [F.col(f"x{d}") * F.lit(1 << 31) + F.col("tie") for d in range(dims)]
    while open_ := [n for n in _leaves(root) if n.shards > 1 and n.dim != -2]:
        at = points.withColumn("leaf", _leaf(root, keys))
        spread = at.groupBy("leaf").agg(F.sum(weight).alias("w"), *[f(f"x{d}").alias(f"{k}{d}") for d in range(dims) for k, f in (("lo", F.min), ("hi", F.max))])
        stats = {r["leaf"]: r for r in spread.collect()}  # one row per node
        search: dict[int, list] = {}  # leaf -> [node, bytes wanted left of the cut, bytes left of lo, lo, hi]
        for n in open_:
            r = stats.get(n.first)
            if r is None:
                n.dim = -2  # no rows
                continue
            n.dim = max(range(dims), key=lambda d: r[f"hi{d}"] - r[f"lo{d}"])
            lo, hi = r[f"lo{n.dim}"] << 31, (r[f"hi{n.dim}"] + 1) << 31
            all_room = sum(n.room)
            share = sum(n.room[: n.shards // 2]) / all_room if all_room else 0.5
            search[n.first] = [n, r["w"] * share, 0, lo, hi]
        while search:
            bins_each = max(BINS, 16 * BINS // len(search))
            step = {k: max(0, (s[4] - s[3] - 1).bit_length() - bins_each.bit_length() + 1) for k, s in search.items()}  # bins of 2^step keys

            def of_leaf(value, kind: str = "long") -> Column:
                return F.array(*[F.lit(value(k)).cast(kind) if k in search else F.lit(None).cast(kind) for k in range(shards)])[F.col("leaf")]

            key = F.array(*keys)[of_leaf(lambda k: search[k][0].dim, "int")]
            look = at.select("leaf", weight, key.alias("key"), of_leaf(lambda k: search[k][3]).alias("lo"), of_leaf(lambda k: search[k][4]).alias("hi"), of_leaf(lambda k: step[k], "int").alias("step")).filter("key >= lo and key < hi")
            bins = look.groupBy("leaf", F.expr("shiftright(key - lo, step)").alias("bin")).agg(F.sum(weight).alias("w"))
            found: dict[int, list] = {k: [] for k in search}
            for r in bins.collect():  # at most max(nodes, 16) x BINS
                found[r["leaf"]].append((r["bin"], r["w"]))
            for k, (n, want, before, lo, hi) in list(search.items()):
                done = None
                for i, w in sorted(found[k]):
                    a, z = lo + (i << step[k]), min(hi, lo + (i + 1 << step[k]))
                    if before + w >= want:
                        if w <= FINE * part or not step[k]:
                            done = z if before + w - want <= want - before else a
                        else:
                            search[k][2:5] = [before, a, z]
                        break
                    before += w
                else:
                    done = hi
                if done is not None:
                    half = n.shards // 2
                    n.cut = done
                    n.left, n.right = Node(n.first, half, n.room[:half]), Node(n.first + half, n.shards - half, n.room[half:])
                    del search[k]
    return root


def _placed(heavy: list[int], shards: int) -> tuple[list[int], list[float]]:
    """The shard of each heavy weight (heaviest first in the list), the emptiest at its turn, and the load of each shard."""
    free = [(0, k) for k in range(shards)]
    load, out = [0.0] * shards, []
    for w in heavy:
        at, k = heapq.heappop(free)
        load[k] = at + w
        out.append(k)
        heapq.heappush(free, (at + w, k))
    return out, load


def _room(load: list[float], rest: float) -> list[float]:
    """What each shard takes of the rest so that all are equally full, or as nearly as the loads allow."""
    level, have = 0.0, 0.0
    order = sorted(load)
    for k, x in enumerate(order):
        have += x
        level = (rest + have) / (k + 1)
        if k + 1 == len(order) or level <= order[k + 1]:
            break
    return [max(0.0, level - x) for x in load]


def shard(docs: DataFrame, scratch: Scratch, shards: int | None = 40, doc_id: str = "doc_id", text: str = "text", dimensions: list[Column] | None = None, target: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    target: bytes of a shard; the number of shards follows from it instead of being given.
    """
    dims = dimensions or dimensions_of(docs.drop(doc_id), text)
    value = F.coalesce(F.col(text), F.lit(""))
    numbers = [F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"v{i}") for i, x in enumerate(dims)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), size_of(text).alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"), F.xxhash64(value).alias("h"), F.monotonically_increasing_id().alias("place"), *numbers)
    rows = scratch.save(rows, "rows")
    same = ["h", "size", "text_crc32"]
    least = [F.min(f"v{i}").alias(f"v{i}") for i in range(len(dims))]
    groups = scratch.save(rows.groupBy(*same).agg(F.sum("size").alias("w"), *least), "groups")
    ends = groups.agg(F.sum("w").alias("total"), *[f(f"v{i}").alias(f"{k}{i}") for i in range(len(dims)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    total = ends["total"] or 0
    shards = max(1, -(-total // target)) if target else shards
    part = total / shards
    bits = F.lit((1 << 31) - 1)

    def scaled(i: int) -> Column:
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        return F.least(bits.cast("long"), F.floor((F.col(f"v{i}") - lo) / (hi - lo) * bits)) if hi > lo else F.lit(0).cast("long")

    at = [scaled(i).alias(f"x{i}") for i in range(len(dims))]
    xs = [f"x{i}" for i in range(len(dims))]
    heavy = groups.filter(F.col("w") > HEAVY * part).select(*same, "w", *at).orderBy(F.desc("w"), *same).collect()  # at most shards / HEAVY rows
    whole = [r for r in heavy if r["w"] <= part]
    where, load = _placed([r["w"] for r in whole], shards)
    schema = ", ".join(f"{c} long" for c in (*same, *xs)) + ", own int"
    known = [(*(r[c] for c in (*same, *xs)), where[i]) for i, r in enumerate(whole)] + [(*(r[c] for c in (*same, *xs)), None) for r in heavy if r["w"] > part]
    known = F.broadcast(scratch.spark.createDataFrame(known, schema).withColumnsRenamed({"size": "_size"}).withColumn("heavy", F.lit(True)))
    hit = lambda df: (df["h"] == known["h"]) & (df["size"] == known["_size"]) & (df["text_crc32"] == known["text_crc32"])

    light = groups.select(*same, "w", *at).join(known, ["h", "text_crc32"], "left_anti") if heavy else groups.select(*same, "w", *at)
    light = light.withColumn("tie", F.xxhash64("h").bitwiseAND(bits))
    split = rows.join(known, hit(rows)).filter("own is null").select(rows["doc_id"], rows["size"], rows["text_crc32"], *xs, F.xxhash64(rows["h"], "doc_id", "place").bitwiseAND(bits).alias("tie"), "place")
    split = scratch.save(split, "split")
    light = scratch.save(light, "light")
    points = scratch.save(light.select("w", *xs, "tie").union(split.select(F.col("size").alias("w"), *xs, "tie")), "points")
    tree = grow(points, len(dims), "w", _room(load, total - sum(load)))
    key = [F.col(x) * F.lit(1 << 31) + F.col("tie") for x in xs]
    shard_of = _leaf(tree, key).cast("int").alias("shard")
    columns = ["doc_id", "size", "text_crc32", "shard", "place"]
    placed = rows.join(light.select(*same, shard_of), same).select(*columns)
    placed = placed.union(rows.join(known, hit(rows)).filter("own is not null").select(rows["doc_id"], rows["size"], rows["text_crc32"], F.col("own").alias("shard"), "place"))
    placed = scratch.save(placed.union(split.select("doc_id", "size", "text_crc32", shard_of, "place")), "placed")
    scratch.drop("groups", "points", "light", "split", "rows")
    rows_of = max((r[0] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("n").collect()), default=0)
    out = ranked(placed, ["shard"], [F.col("place")], "slot", max(16, rows_of // 200_000))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
