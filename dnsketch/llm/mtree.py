"""Operator 7: exact top-k inner products by best-first search in a paged M-tree.

Each component becomes floor(256 x). Inner products are turned into distances by one more dimension: with R the largest
length of all vectors, x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0) give d(q', x')^2 = |q|^2 + R^2 - 2 q.x, so the nearest
are those with the largest inner product. The root page has at most CELLS routing points, rows chosen by a hash; every row
belongs to the nearest one, and a routing point's covering radius is its farthest row's distance. The rows of a routing
point are trees of a bounded size (several, told apart by a hash, where there are many), built of pages: an inner page
holds routing points with covering radii and their distances to the page's own routing point, a leaf page rows with theirs.

A query is a row itself: it is searched for in its own tree when that is built, and its k-th score there is the floor for
all others. Only the root's entries that may reach the floor are asked; there a queue of pages by the best score they may
hold is worked off, and a stored distance to the parent tells by the triangle inequality which entries need no
computation. Bounds carry a margin for rounding, and scores are computed in whole numbers, so the result is exact.

Each tree is written once and read by one task for every QUERY_BYTES of queries that reach it. How much is pruned is the
data's: vectors of many dimensions without clusters are all about equally far from each other, and then no bound avoids
any computation and the work is that of all pairs.

Defined results: vectors that are null, empty or hold null or non-finite components (also once they are 256-fold), and
rows with a null id, take no part; vectors of different lengths are not compared; rows with the query's own id are no
candidates for it; equal scores go to the smaller id (rows with the same id and score are as many results); scores beyond
64 bits count as the largest or smallest such number; where a square of a length leaves the doubles, trees are scanned
whole. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsketch.llm.common import Scratch

TREE_BYTES = 8 << 20  # of the vectors of a tree
QUERY_BYTES = 8 << 20  # of the queries of a task
CELLS = 4_096  # entries of the root page, at most
PAGE = 256  # entries of any other page
SCALE = 256
LARGEST = (1 << 63) - 1


def lifted(x: np.ndarray, r2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(r2 - np.einsum("ij,ij->i", x, x), 0))])


def may(d: np.ndarray, q2: float, r2: float) -> np.ndarray:
    """The largest score at a distance of d or more."""
    return (q2 + r2 - np.maximum(d, 0) ** 2) / 2 + 1e-9 * (q2 + r2) + 1e-6


class Tree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, r2: float, pages: tuple[list[dict], int] | None = None):
        """x: whole numbers as doubles; r2: the square of the largest length there is."""
        self.ids, self.r2, self.x = ids, r2, x
        self.most = float(np.abs(x).max(initial=0.0))
        self.computed = 0  # scores and distances to routing points
        self.scan = not math.isfinite(r2)
        self.pages: list[dict] = []
        if pages:
            self.pages, self.root = pages
        elif not self.scan:
            self.v = lifted(x, r2)
            self.root = self._page(np.arange(len(x)), None)
            del self.v

    def _page(self, at: np.ndarray, parent: np.ndarray | None) -> int:
        """A page over the rows at; parent: the routing point above."""
        to_parent = lambda p: np.zeros(len(p)) if parent is None else np.sqrt(((p - parent) ** 2).sum(1))
        if len(at) <= PAGE:
            self.pages.append({"rows": at, "from_parent": to_parent(self.v[at])})
            return len(self.pages) - 1
        # routing points: far from each other, from a spread of rows; every row goes to the nearest
        some = at[np.linspace(0, len(at) - 1, min(len(at), 8 * PAGE)).astype(int)]
        most = min(PAGE, -(-len(at) // (PAGE // 2)))
        chosen = [some[0]]
        near = np.sqrt(((self.v[some] - self.v[chosen[0]]) ** 2).sum(1))
        while len(chosen) < most and near.max() > 0:
            chosen.append(some[int(near.argmax())])
            near = np.minimum(near, np.sqrt(((self.v[some] - self.v[chosen[-1]]) ** 2).sum(1)))
        c = self.v[np.array(chosen)]
        own = np.empty(len(at), int)
        for lo in range(0, len(at), 4096):
            p = self.v[at[lo : lo + 4096]]
            own[lo : lo + 4096] = ((c * c).sum(1)[None] - 2 * p @ c.T).argmin(1)
        if len(chosen) == 1 or np.bincount(own).max() == len(at):  # all alike: by halves
            own, c = np.arange(len(at)) * 2 // len(at), self.v[at[[0, len(at) - 1]]]
        kept = [k for k in range(len(c)) if (own == k).any()]
        radius = np.array([math.sqrt(((self.v[at[own == k]] - c[k]) ** 2).sum(1).max()) for k in kept])
        children = [self._page(at[own == k], c[k]) for k in kept]
        self.pages.append({"centre": c[kept], "radius": radius, "child": children, "from_parent": to_parent(c[kept])})
        return len(self.pages) - 1

    def scores(self, at: np.ndarray, q: np.ndarray) -> list[int]:
        """Exact, as doubles where these hold every sum, else as Python's whole numbers."""
        self.computed += len(at)
        if self.most * float(np.abs(q).max(initial=0.0)) * len(q) < 2**53:
            return (self.x[at] @ q).astype(np.int64).tolist()
        whole = [int(c) for c in q.tolist()]
        return [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in self.x[at].tolist()]

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), best first, without rows of the id `own` and without scores below the floor."""
        best: list[tuple[int, int]] = []  # a heap with the worst on top: (score, -id)

        def least() -> float:
            worst = best[0][0] if len(best) == k else -math.inf
            return worst if floor is None else max(worst, floor)

        def take(at: np.ndarray) -> None:
            for s, i in zip(self.scores(at, q), self.ids[at].tolist(), strict=True):
                if i == own or s < least():
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))

        if self.scan:
            take(np.arange(len(self.ids)))
            return [(s, -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]
        q2 = float(q @ q)
        point = np.append(q, 0.0)
        queue: list[tuple[float, int, float]] = [(-math.inf, self.root, math.nan)]
        while queue:
            bound, number, d_parent = heapq.heappop(queue)
            if -bound < least():
                break
            page = self.pages[number]
            gap = np.zeros(len(page["from_parent"])) if math.isnan(d_parent) else np.abs(d_parent - page["from_parent"])
            if "rows" in page:
                at = page["rows"][may(gap, q2, self.r2) >= least()]
                if len(at) > 64 and len(best) < k:  # a first few, so that the others meet a bound
                    take(at[:64])
                    at = at[64:]
                if len(at):
                    scores = np.array(self.scores(at, q), dtype=object if self.most >= 2**26 else np.int64)
                    limit = least()
                    hit = np.flatnonzero(scores >= limit) if limit > -math.inf else range(len(at))
                    for j in hit:
                        s, i = int(scores[j]), int(self.ids[at[j]])
                        if i == own or s < least():
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                continue
            near = np.flatnonzero(may(gap - page["radius"], q2, self.r2) >= least())
            if not len(near):
                continue
            self.computed += len(near)
            d = np.sqrt(((page["centre"][near] - point) ** 2).sum(1))
            reach = may(d - page["radius"][near], q2, self.r2)
            for j, dist, b in zip(near.tolist(), d.tolist(), reach.tolist(), strict=True):
                if b >= least():
                    heapq.heappush(queue, (-b, page["child"][j], dist))
        return [(s, -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]

    def dump(self) -> bytes:
        return pickle.dumps((self.pages, getattr(self, "root", -1)))


def _numbers(batches):
    """(vec_id, embedding) -> (vec_id, dim, squared length, whole numbers as doubles); what takes no part is left out."""
    for batch in batches:
        out = []
        for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not e or None in e:
                continue
            with np.errstate(over="ignore"):
                v = np.floor(SCALE * np.array(e, np.float64))
                if np.isfinite(v).all():
                    out.append((i, len(e), float(v @ v), v.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.binary()))], names=["vec_id", "dim", "sq", "v"])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def top(vectors: DataFrame, scratch: Scratch, k: int = 5, queries: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", work: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. work: gets the numbers of computed and of all scores."""
    spark = scratch.spark
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = scratch.save(raw.mapInArrow(_numbers, "vec_id long, dim int, sq double, v binary"), "rows")
    asks = F.pmod("vec_id", F.lit(50)) == 0 if queries is None else queries
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)), F.max("sq")).collect()}  # one row per length of vectors
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per_tree = {d: max(PAGE, TREE_BYTES // (8 * d)) for d in sizes}
    r2 = {d: x[1] for d, x in sizes.items()}

    # the root's routing points: rows with the smallest hashes, about as many as there are trees to be
    wanted = {d: min(CELLS, -(-n // per_tree[d])) if math.isfinite(r2[d]) else 1 for d, (n, _) in sizes.items()}
    space = 1 << 30
    share = {d: min(space, (2 * w + 8) * space // sizes[d][0] + 1) for d, w in wanted.items() if w > 1}
    pivots: dict[int, np.ndarray] = {}
    if share:
        h = F.pmod(F.xxhash64("v"), F.lit(space))
        bound = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("dim")]
        found: dict[int, dict[bytes, int]] = {}
        for r in rows.select("dim", "v", h.alias("h")).filter(F.col("h") < bound).distinct().collect():  # some 2 x CELLS rows per length
            found.setdefault(r["dim"], {})[bytes(r["v"])] = r["h"]
        for d, some in found.items():
            chosen = sorted(some, key=lambda v: (some[v], v))[: wanted[d]]
            pivots[d] = lifted(np.frombuffer(b"".join(chosen), np.float64).reshape(-1, d), r2[d])

    def celled(batches):
        """(dim, vec_id, v, asks) with the nearest routing point's number and the distance to it."""
        for batch in batches:
            dims, n = np.asarray(batch.column(0)), batch.num_rows
            cell, far = np.zeros(n, np.int32), np.zeros(n)
            for d in np.unique(dims).tolist():
                if d in pivots:
                    at, c = np.flatnonzero(dims == d), pivots[d]
                    p = lifted(_matrix(batch.column(2).take(pa.array(at)), d), r2[d])
                    for lo in range(0, len(at), 1024):
                        part = p[lo : lo + 1024]
                        cell[at[lo : lo + 1024]] = own = ((c * c).sum(1)[None] - 2 * part @ c.T).argmin(1)
                        far[at[lo : lo + 1024]] = np.sqrt(((part - c[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["dim", "vec_id", "v", "asks", "cell", "far"])

    placed = scratch.save(rows.select("dim", "vec_id", "v", asks.alias("asks")).mapInArrow(celled, "dim int, vec_id long, v binary, asks boolean, cell int, far double"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # CELLS rows per length at most
    radius = {d: np.full(wanted[d], -math.inf) for d in sizes}
    for r in cells:
        radius[r["dim"]][r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-6
    parts = F.broadcast(spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // per_tree[r["dim"]])) for r in cells], "dim int, cell int, parts int"))
    dealt = placed.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.col("parts")).cast("int"))

    def built(t: pa.Table) -> pa.Table:
        """One tree: a row with its pages, a row for each query in it, and rows with that query's results here."""
        t = t.sort_by("vec_id")
        d, cell, part = (t[c][0].as_py() for c in ("dim", "cell", "part"))
        x, ids = _matrix(t["v"], d), np.asarray(t["vec_id"])
        tree = Tree(x, ids, r2[d])
        out: list[tuple] = [(None, None, None, tree.dump(), x.tobytes(), ids.tobytes())]
        for j in np.flatnonzero(np.asarray(t["asks"])).tolist():
            best = tree.search(x[j], int(ids[j]), k)
            floor = _held(best[-1][0]) if len(best) == k else None
            out.append((int(ids[j]), None, floor, None, x[j].tobytes(), None))
            out += [(int(ids[j]), i, _held(s), None, None, None) for s, i in best]
        out.append((None, tree.computed, int(np.asarray(t["asks"]).sum()) * len(x), None, None, None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        where = [pa.array([v] * len(out), pa.int32()) for v in (d, cell, part)]
        return pa.table(dict(zip(("dim", "cell", "part", "query_id", "vec_id", "score", "pages", "v", "ids"), [*where, *[_column([o[i] for o in out], kind) for i, kind in enumerate(kinds)]], strict=True)))

    index = scratch.save(dealt.select("dim", "cell", "part", "vec_id", "v", "asks").groupBy("dim", "cell", "part").applyInArrow(built, "dim int, cell int, part int, query_id long, vec_id long, score long, pages binary, v binary, ids binary"), "index")
    own = index.filter("query_id is not null and vec_id is not null").select("query_id", "vec_id", "score")

    def routed(batches):
        """(dim, cell, part, query_id, floor, v) -> a row for each of the root's entries that may hold a score of the floor."""
        for batch in batches:
            row, to = [], []
            for j, (d, floor, v) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 4, 5)], strict=True)):
                if d not in pivots:
                    reach = np.arange(wanted[d])
                else:
                    q = np.frombuffer(v, np.float64)
                    dist = np.sqrt(((pivots[d] - np.append(q, 0.0)) ** 2).sum(1)) - radius[d]
                    reach = np.flatnonzero(may(dist, float(q @ q), r2[d]) >= (-math.inf if floor is None else floor))
                row.append(np.full(len(reach), j))
                to.append(reach)
            take = pa.array(np.concatenate(row or [np.zeros(0, int)]))
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns], pa.array(np.concatenate(to or [np.zeros(0, int)]).astype(np.int32))], names=["dim", "own_cell", "own_part", "query_id", "floor", "v", "cell"])

    seeded = index.filter("query_id is not null and vec_id is null").select("dim", "cell", "part", "query_id", F.col("score").alias("floor"), "v")
    sent = scratch.save(seeded.mapInArrow(routed, "dim int, own_cell int, own_part int, query_id long, floor long, v binary, cell int"), "sent")
    blocks = [(r["dim"], r["cell"], -(-r["n"] * 8 * r["dim"] // QUERY_BYTES)) for r in sent.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # as many rows as cells
    blocks = F.broadcast(spark.createDataFrame(blocks, "dim int, cell int, blocks int"))
    left = sent.join(parts, ["dim", "cell"]).join(blocks, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.filter("cell <> own_cell or part <> own_part").select(F.col("dim").alias("qdim"), F.col("cell").alias("qcell"), F.col("part").alias("qpart"), F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")).cast("int").alias("block"), "query_id", "floor", F.col("v").alias("q"))
    right = index.filter("pages is not null").select("dim", "cell", "part", "pages", "v", "ids").join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def searched(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and t.num_rows:
            d = t["dim"][0].as_py()
            x = np.frombuffer(t["v"][0].as_py(), np.float64).reshape(-1, d)
            tree = Tree(x, np.frombuffer(t["ids"][0].as_py(), np.int64), r2[d], pickle.loads(t["pages"][0].as_py()))
            for i, floor, v in zip(*[q[c].to_pylist() for c in ("query_id", "floor", "q")], strict=True):
                out += [(i, j, _held(s)) for s, j in tree.search(np.frombuffer(v, np.float64), i, k, floor)]
            out.append((None, tree.computed, q.num_rows * len(x)))
        return pa.table({c: _column([o[i] for o in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    # the sides' columns have names of their own: both come from one table
    got = left.groupBy("qdim", "qcell", "qpart", "block").cogroup(right.groupBy("dim", "cell", "part", "block")).applyInArrow(searched, "query_id long, vec_id long, score long")
    got = scratch.save(got, "got")
    if work is not None:
        done = index.filter("query_id is null and pages is null").select("vec_id", "score").union(got.filter("query_id is null").select("vec_id", "score")).agg(F.sum("vec_id"), F.sum("score")).first()
        asked = {r["dim"]: r["n"] for r in seeded.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        work |= {"computed": done[0], "all": sum(n * sizes[d][0] for d, n in asked.items())}
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = own.union(got.filter("query_id is not null")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _held(score: int) -> int:
    return max(-LARGEST - 1, min(LARGEST, score))
