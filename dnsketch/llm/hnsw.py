"""Operator 5: near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one point with a weight. Points are dealt to shards of at most SHARD points and SHARD_BYTES by a hash; a
task builds each shard's graph (a hierarchy of ever fewer points with long links above, a ground layer with diverse
links). Every point queries every shard, in blocks of up to a shard's size, so that a graph travels as often as it
must. In each block a sample of queries is audited against brute force over the shard; the beam is doubled until no audited
link is missing and NEAREST of the audited queries have found the point next to them (which every query has, also where
there are no links), and queries whose beam is full of links get a wider one in any case. Beyond the widest beam, which
costs as much as looking at the whole shard, queries are compared by brute force. Found pairs are confirmed by cosine in
double precision, counted and joined to a union-find forest a few hundred queries at a time, so a dense group takes no
more memory than a sparse one; the forests are joined. audited() tells what the audits found.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links 0,
their own component); a null id gives a null component and no links; only vectors of equal length are compared; equal
ids are one node with all their vectors. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsketch.llm.common import Scratch, components

SHARD, SHARD_BYTES = 40_000, 48 << 20  # points of one graph, and bytes of their vectors; also of the queries of one task
TASKS = 12  # blocks are smaller while there are fewer tasks than this
LINKS = 16  # of a point in the upper layers; twice as many on the ground
BEAM, WIDEST, BUILD_BEAM = 32, 128, 40
AUDIT = 64  # queries of a block that are audited
EXPAND = 4  # points expanded at once
NEAREST = 0.5  # of the audited queries that must find the point next to them, which is farther than any link and so harder to find
AT_ONCE = 512  # queries searched together
DENSE = 128  # queries compared by brute force together


def diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (indexes, -1 for none), best first, those nearer to the point than to any kept one; then the best of the rest."""
    n, c = cand.shape
    out = np.full((n, keep), -1, np.int32)
    for lo in range(0, n, 1024):
        ids, me = cand[lo : lo + 1024], x[own[lo : lo + 1024]]
        v = x[np.maximum(ids, 0)]
        sim = np.where(ids >= 0, np.matmul(v, me[:, :, None])[:, :, 0], -9.0)
        order = np.argsort(-sim, axis=1, kind="stable")
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        worst = np.full(ids.shape, -9.0)  # likeness to the nearest kept one
        count = np.zeros(len(ids), int)
        for k in range(c):
            ok = (sim[:, k] > -5) & (count < keep) & (sim[:, k] > worst[:, k])
            chosen[:, k] = ok
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, k]), worst)
        rank = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]  # chosen first, then the best others
        out[lo : lo + 1024, : rank.shape[1]] = np.where(np.take_along_axis(sim, rank, 1) > -5, np.take_along_axis(ids, rank, 1), -1)
    return out


class Graph:
    """x: unit vectors (float32 for the search); layers: from the top, (points, links by local index of the point)."""

    def __init__(self, x: np.ndarray, levels: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        self.lone = np.zeros(0, np.int32)
        if levels is not None:
            self._build(levels)

    def _build(self, levels: np.ndarray) -> None:
        n = len(self.x)
        self.upper: list[tuple[np.ndarray, np.ndarray]] = []
        for lvl in range(int(levels.max(initial=0)), 0, -1):
            at = np.flatnonzero(levels >= lvl)
            if len(at) > 4:
                self.upper.append((at, self._nearest(at, LINKS)))
        ground = 2 * LINKS
        self.links = np.full((n, ground), -1, np.int32)
        order = np.argsort(-levels, kind="stable").astype(np.int32)
        first = min(n, max(256, len(self.upper[-1][0]) if self.upper else 0))
        at = np.sort(order[:first])
        self.links[at] = self._nearest(at, ground)
        while first < n:
            new = order[first : first + min(first, 2048)]
            cand, _ = self.search(self.x[new], BUILD_BEAM)
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -9)
            k = min(12, len(new) - 1)
            if k > 0:
                mates = new[np.argpartition(-own, k - 1, axis=1)[:, :k]]
                cand = np.hstack([cand, mates.astype(np.int32)])
            cand = _unique_rows(cand)
            mine = diverse(self.x, new, cand, LINKS)
            self.links[new, :LINKS] = mine
            self._back(np.repeat(new, LINKS), mine.reshape(-1))
            first += len(new)
        self.lone = self._unreached()

    def _unreached(self) -> np.ndarray:
        """Points that no way of links leads to from any point where a search may begin: every query is compared with them."""
        seen = np.zeros(len(self.x), bool)
        at = self.upper[-1][0] if self.upper else self._starts()
        while len(at):
            seen[at] = True
            near = np.unique(self.links[at])
            at = near[(near >= 0) & ~seen[near]]
        return np.flatnonzero(~seen).astype(np.int32)

    def _starts(self) -> np.ndarray:
        start = np.flatnonzero((self.links >= 0).any(1))[:4] if len(self.x) > 1 else np.array([0])
        return start if len(start) else np.array([0])

    def _nearest(self, at: np.ndarray, keep: int) -> np.ndarray:
        """Links among the points at, by all their distances (few points)."""
        v, out = self.x[at], np.full((len(at), keep), -1, np.int32)
        k = min(len(at) - 1, 2 * keep)
        if k <= 0:
            return out
        for lo in range(0, len(at), 512):
            sim = v[lo : lo + 512] @ v.T
            sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = -9
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            out[lo : lo + 512] = diverse(self.x, at[lo : lo + 512], at[near].astype(np.int32), keep)
        return out

    def _back(self, new: np.ndarray, to: np.ndarray) -> None:
        """Links in the other direction; a point with too many keeps diverse ones."""
        ok = to >= 0
        new, to = new[ok], to[ok]
        order = np.argsort(to, kind="stable")
        new, to = new[order], to[order]
        at, start, count = np.unique(to, return_index=True, return_counts=True)
        have = (self.links[at] >= 0).sum(1)
        width, room = int(min(count.max(initial=0), 64)), self.links.shape[1]
        cand = np.full((len(at), room + width), -1, np.int32)
        cand[:, :room] = self.links[at]
        rank = np.arange(len(to)) - np.repeat(start, count)
        fit = rank < width
        cand[np.repeat(np.arange(len(at)), count)[fit], room + rank[fit]] = new[fit]
        few = have + np.minimum(count, width) <= room
        packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)[:, :room]
        self.links[at[few]] = packed[few]
        if (~few).any():
            self.links[at[~few]] = diverse(self.x, at[~few], cand[~few], room)

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam's points and likenesses for each query, in no order; -1 where there are fewer.

        own: the point that each query is itself, or -1; the search begins there too.
        """
        own = np.full(len(q), -1) if own is None else own
        parts = [self._search(q[lo : lo + AT_ONCE].astype(np.float32), beam, own[lo : lo + AT_ONCE]) for lo in range(0, len(q), AT_ONCE)]
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int, own: np.ndarray):
        n, b = len(self.x), len(q)
        entry = None
        for at, links in self.upper:
            place = np.full(n, -1, np.int32)
            place[at] = np.arange(len(at))
            if entry is None and len(at) > 64:
                entry = np.full((b, 1), at[0], np.int32)
            if entry is None:
                sim = q @ self.x[at].T
                entry = at[np.argpartition(-sim, min(2, len(at) - 1), axis=1)[:, :2]].astype(np.int32)
            else:
                entry = self._walk(q, entry, 4, links, place)[0][:, :2]
                entry = np.where(entry >= 0, entry, entry[:, :1])
        if entry is None:
            entry = np.tile(self._starts().astype(np.int32), (b, 1))
        entry = np.column_stack([np.where(own >= 0, own, entry[:, 0]), entry]).astype(np.int32)
        ids, sim = self._walk(q, entry, beam, self.links, None)
        if len(self.lone):
            ids = np.hstack([ids, np.tile(self.lone, (b, 1))])
            sim = np.hstack([sim, q @ self.x[self.lone].T])
            top = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
            ids, sim = np.take_along_axis(ids, top, 1), np.take_along_axis(sim, top, 1)
        return ids, sim

    def _walk(self, q, entry, beam, links, place):
        b, n = len(q), len(self.x)
        rows = np.arange(b)
        seen = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1, np.int32)
        sim = np.full((b, beam), -9.0, np.float32)
        done = np.ones((b, beam), bool)
        k = min(entry.shape[1], beam)
        for j in range(k):
            e = entry[:, j]
            fresh = ~seen[rows, e]
            seen[rows, e] = True
            ids[:, j] = np.where(fresh, e, -1)
            sim[:, j] = np.where(fresh, np.einsum("ij,ij->i", self.x[e], q), -9)
            done[:, j] = ~fresh
        live = rows
        while len(live):
            s = np.where(done[live], -99.0, sim[live])
            m = min(EXPAND, beam)
            pick = np.argpartition(-s, m - 1, axis=1)[:, :m]
            use = np.take_along_axis(s, pick, 1) > -9
            going = use.any(1)
            live, pick, use = live[going], pick[going], use[going]
            if not len(live):
                break
            cur = ids[live[:, None], pick]
            done[live[:, None], pick] = True
            at = cur if place is None else place[cur]
            near = np.where(use[:, :, None], links[at], -1).reshape(len(live), -1)
            r = live[:, None]
            ok = (near >= 0) & ~seen[r, np.maximum(near, 0)]
            # the same neighbour of two expanded points counts once
            near = np.where(ok, near, -1)
            order = np.argsort(near, axis=1)
            near = np.take_along_axis(near, order, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            ok = near >= 0
            i, j = np.nonzero(ok)
            seen[live[i], near[i, j]] = True
            new = np.full(near.shape, -9.0, np.float32)
            new[i, j] = np.einsum("ij,ij->i", self.x[near[i, j]], q[live[i]])
            both_ids, both_sim = np.hstack([ids[live], near]), np.hstack([sim[live], new])
            both_done = np.hstack([done[live], ~ok])
            top = np.argpartition(-both_sim, beam - 1, axis=1)[:, :beam]
            ids[live], sim[live], done[live] = np.take_along_axis(both_ids, top, 1), np.take_along_axis(both_sim, top, 1), np.take_along_axis(both_done, top, 1)
        ids[sim <= -9] = -1
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def dump(self) -> bytes:
        f = io.BytesIO()
        parts = {f"u{i}{k}": a for i, pair in enumerate(self.upper) for k, a in zip("al", pair, strict=True)}
        np.savez(f, links=self.links, lone=self.lone, **parts)
        return f.getvalue()

    @classmethod
    def load(cls, x: np.ndarray, dumped: bytes) -> "Graph":
        g = cls(x)
        z = np.load(io.BytesIO(dumped))
        g.links, g.lone = z["links"], z["lone"]
        g.upper = [(z[f"u{i}a"], z[f"u{i}l"]) for i in range((len(z.files) - 2) // 2)]
        return g


def _unique_rows(cand: np.ndarray) -> np.ndarray:
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    return cand


def _unit(batches):
    """(vec_id, embedding) -> (vec_id, dim, key of the raw values, unit vector); dim 0 for what takes no part."""
    import xxhash

    for batch in batches:
        dims, keys, units = [], [], []
        for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.array([math.nan if c is None else c for c in e], np.float64) if e else np.zeros(0)
            # scaled first: squares of very large or small components would leave the range of a double
            most = np.abs(v).max(initial=0) if np.isfinite(v).all() else 0.0
            norm = np.linalg.norm(v / most) if most else 0.0
            if i is None or not norm:
                dims.append(0)
                keys.append(b"")
                units.append(b"")
            else:
                dims.append(len(v))
                keys.append(xxhash.xxh3_128_digest((v + 0.0).tobytes()))
                units.append((v / most / norm).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "dim", "key", "v"])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _built(t: pa.Table) -> pa.Table:
    """One shard's points -> its graph, in one row."""
    t = t.sort_by("rep")
    dim = t["dim"][0].as_py()
    x = _matrix(t["v"], dim)
    rng = np.random.default_rng(len(x))
    levels = np.minimum(8, (-np.log(1 - rng.random(len(x))) / math.log(LINKS)).astype(int))
    g = Graph(x, levels)
    one = {"shard": t["shard"][:1], "dim": t["dim"][:1], "ids": pa.array([np.asarray(t["rep"]).astype(np.int64).tobytes()]), "weights": pa.array([np.asarray(t["weight"]).astype(np.int64).tobytes()]), "x": pa.array([x.tobytes()]), "graph": pa.array([g.dump()])}
    return pa.table(one)


class Forest:
    """Union-find over the numbers below n, many links at once; the root of a set is its smallest number."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.up
            ra, rb = up[a], up[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
            while (further := up[up]).tobytes() != up.tobytes():
                up = further
            self.up = up


def links_of(x: np.ndarray, g: Graph, q: np.ndarray, least: float, own: np.ndarray | None = None, audit: dict | None = None):
    """(query, point) of all pairs found with cosine of at least `least`, by beams that pass their audit, part by part.

    own: the point that each query is itself, or -1; that pair is left out. audit: gets the numbers of true links and of
    found ones among the audited queries at the beam they were settled with.
    """
    n, slack = len(x), 1e-4
    own = np.full(len(q), -1) if own is None else own
    audit = {} if audit is None else audit
    probe = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    likeness = q[probe] @ x.T
    is_own = own[probe] >= 0
    likeness[is_own, own[probe][is_own]] = -9
    truth = likeness >= least
    # a graph without links to find shows by the nearest points whether it is searched well
    nearest = likeness.argmax(1)
    spot = np.full(len(q), -1)
    spot[probe] = np.arange(len(probe))
    beam, rest = BEAM, np.arange(len(q))
    while len(rest):
        if beam > WIDEST or beam >= n:
            for lo in range(0, len(rest), DENSE):
                i, j = np.nonzero(q[rest[lo : lo + DENSE]] @ x.T >= least)
                i = rest[lo + i]
                yield i[own[i] != j], j[own[i] != j]
            audited = spot[rest][spot[rest] >= 0]
            both = int(truth[audited].sum())
            audit |= {"true": audit.get("true", 0) + both, "found": audit.get("found", 0) + both}
            return
        ids, sim = g.search(q[rest], beam, own[rest])
        hit = (sim >= least - slack) & (ids >= 0) & (ids != own[rest][:, None])
        full = hit.sum(1) * 2 > beam  # so many links that there may be more
        mine = np.flatnonzero((spot[rest] >= 0) & ~full)  # audited
        at = spot[rest[mine]]
        got = np.zeros((len(at), n), bool)
        k, c = np.nonzero(ids[mine] >= 0)
        got[k, ids[mine][k, c]] = True
        lost = truth[at] & ~got
        near = got[np.arange(len(at)), nearest[at]].mean() if len(at) else 1.0
        if lost.any() or near < NEAREST:  # the audit failed: a wider beam for all
            beam *= 2
            continue
        both = int(truth[at].sum())
        audit |= {"true": audit.get("true", 0) + both, "found": audit.get("found", 0) + both - int(lost.sum())}
        for lo in range(0, len(rest), AT_ONCE):
            i, j = np.nonzero(hit[lo : lo + AT_ONCE] & ~full[lo : lo + AT_ONCE, None])
            qi, xi = rest[lo + i], ids[lo + i, j]
            sure = np.einsum("ij,ij->i", q[qi], x[xi]) >= least
            yield qi[sure], xi[sure]
        rest, beam = rest[full], beam * 2


def _shard_points(dim: int) -> int:
    return max(64, min(SHARD, SHARD_BYTES // (8 * dim)))


def near_duplicates(vectors: DataFrame, scratch: Scratch, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = scratch.save(raw.mapInArrow(_unit, "vec_id long, dim int, key binary, v binary"), "rows")
    same = scratch.save(rows.filter("dim > 0").groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "same")
    sizes = {r[0]: r[1] for r in same.groupBy("dim").count().collect()}  # one row per length of vectors
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    of_dim = lambda f: F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, f(d, n))])[F.col("dim")]
    shards = of_dim(lambda d, n: -(-n // _shard_points(d)))
    first = rows.select("dim", "key", F.col("vec_id").alias("rep"), "v").join(same, ["dim", "key", "rep"]).dropDuplicates(["dim", "key"])
    points = scratch.save(first.withColumn("shard", F.pmod(F.xxhash64("key"), shards).cast("int")).select("dim", "shard", "rep", "weight", "v"), "points")
    graphs = points.groupBy("dim", "shard").applyInArrow(_built, "shard int, dim int, ids binary, weights binary, x binary, graph binary")
    graphs = scratch.save(graphs, "graphs")

    # as many blocks as shards, since a block may be as large; more while that makes too few tasks, but none of under 1,024 queries
    blocks = of_dim(lambda d, n: max(k := -(-n // _shard_points(d)), min(-(-TASKS // k), -(-n // 1024))))
    asks = points.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), blocks).cast("int")).select("dim", "block", "rep", "weight", "v", F.explode(F.sequence(F.lit(0), (shards - 1).cast("int"))).alias("shard"))
    index = graphs.select("*", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"))

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        dim = left["dim"][0].as_py()
        x = np.frombuffer(right["x"][0].as_py(), np.float64).reshape(-1, dim)
        ids, weights = (np.frombuffer(right[c][0].as_py(), np.int64) for c in ("ids", "weights"))
        own = np.asarray(left["rep"])
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, own, sorter=order), len(ids) - 1)]
        at = np.where(ids[at] == own, at, -1)
        nodes, place = np.unique(np.concatenate([own, ids]), return_inverse=True)  # in order, so that the smallest number is the smallest id
        forest, count, audit = Forest(len(nodes)), np.zeros(len(own), np.int64), {"true": 0, "found": 0}
        for qi, xi in links_of(x, Graph.load(x, right["graph"][0].as_py()), _matrix(left["v"], dim), least, at, audit):
            count += np.bincount(qi, weights=weights[xi], minlength=len(own)).astype(np.int64)
            forest.join(place[qi], place[len(own) + xi])
        at = np.flatnonzero(forest.up != np.arange(len(nodes)))
        # counts have b = null, links of the forest n = null, the audit a = null
        a = pa.array([*own.tolist(), *nodes[at].tolist(), None], pa.int64())
        b = pa.array([None] * len(own) + nodes[forest.up[at]].tolist() + [audit["true"]], pa.int64())
        return pa.table({"a": a, "b": b, "n": pa.array(count.tolist() + [None] * len(at) + [audit["found"]], pa.int64())})

    got = asks.groupBy("dim", "shard", "block").cogroup(index.groupBy("dim", "shard", "block")).applyInArrow(asked, "a long, b long, n long")
    got = scratch.save(got, "got")
    n = got.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    # an id with several vectors ties them together
    named = rows.filter("dim > 0").join(same.select("dim", "key", "rep"), ["dim", "key"]).select("vec_id", "rep")
    several = named.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("vec_id", "lo")
    edges = got.filter("n is null").select("a", "b").union(named.join(several, "vec_id").select("lo", "rep").toDF("a", "b"))
    label = components(edges, scratch).toDF("rep", "component")
    of_set = same.join(n, "rep", "left").join(label, "rep", "left").select("dim", "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_set, ["dim", "key"], "left")
    mine = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), F.coalesce(F.col("vec_id") == mine, F.lit(True)).alias("kept"))


def audited(scratch: Scratch) -> tuple[int, int]:
    """(found, true) links of the audited queries of the last run with this scratch folder."""
    r = scratch.spark.read.parquet(scratch.at["got"]).filter("a is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return r[0], r[1]
