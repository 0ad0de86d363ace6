"""Operator 3: toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade > k) = logistic(w.x - theta_k) with one weight vector for all ordered thresholds theta_0 < theta_1 < ...; the
output is the expected grade, sum of P(grade > k), and a text is rejected when that is nearer to a toxic grade than to 0.
Features are whole words and word beginnings that the labelled sample ties to toxicity or away from it (chi-square),
counted per text as log(1 + n). Weights and thresholds maximise the likelihood of the labelled grades.

The grades come from the labels alone: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a text of bad quality
(1 where the quality is null or not labelled).

Defined results: a null or empty text has no feature and gets the expected grade of the thresholds alone; without a
labelled row of both kinds nothing is toxic (severity 0). Rows repeat as they come, further columns stay, and columns
with the names of results are replaced. A label without a document, or null, is not used; a document with several
labels counts once, with the highest grade.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsketch.llm.common import Scratch, batches_of, keep, release

SAMPLE = 12_000  # labelled documents learned from, at most about this many (by a hash of the id)
FEATURES = 2_000  # words and beginnings that are kept
BEGIN = (5, 6, 7)  # lengths of word beginnings
LEAST = 5  # documents a feature must be in
GRADES = 2  # above 0
SEVERE = 0.5  # expected grade from which a document is rejected
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> dict[str, int]:
    """Counts of words ("w") and of their beginnings ("w*")."""
    out: dict[str, int] = {}
    for w in WORD.findall(text.lower()) if text else ():
        out[w] = out.get(w, 0) + 1
    for w, n in list(out.items()):
        for k in BEGIN:
            if len(w) > k:
                out[w[:k] + "*"] = out.get(w[:k] + "*", 0) + n
    return out


@dataclass
class Model:
    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def vector(self, text: str | None) -> dict[int, float]:
        names, n = self.names, {}
        for w in WORD.findall(text.lower()) if text else ():
            i = names.get(w)
            if i is not None:
                n[i] = n.get(i, 0) + 1
            for k in BEGIN:
                if len(w) > k and (i := names.get(w[:k] + "*")) is not None:
                    n[i] = n.get(i, 0) + 1
        return {i: math.log1p(c) for i, c in n.items()}

    def above(self, x: dict[int, float]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        eta = sum(self.weights[i] * v for i, v in x.items())
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds - eta))


def _counted(batches):
    """(feature, documents, toxic documents) of a partition."""
    n: dict[str, list[int]] = {}
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in features(text):
                c = n.setdefault(w, [0, 0])
                c[0] += 1
                c[1] += y
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([c[0] for c in n.values()], pa.int64()), pa.array([c[1] for c in n.values()], pa.int64())], names=["f", "n", "t"])


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """text, grade of about so many labelled documents at most: one scan of the documents, written once."""
    toxic = F.col("toxic") > 0
    bad = F.coalesce(F.col("quality") <= 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.when(toxic & bad, 2).when(toxic, 1).otherwise(0).alias("grade"))
    rows = rows.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(sample / total * (1 << 20)))
    rows = scratch.save(rows, "labels")
    few = F.broadcast(rows) if rows.count() <= 2 * sample else rows  # the bound of what is sent, checked
    return scratch.save(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(few, "doc_id").select("text", "grade"), "labelled")


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """Features by chi-square over the sample, then the ordinal model on their hits."""
    rows = labelled(docs, labels, scratch, sample)
    y = (F.col("grade") > 0).cast("int")
    totals = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(y), F.lit(0))).first()
    n, t = int(totals[0]), int(totals[1])
    if not 0 < t < n:
        return Model()
    c = rows.select("text", y.alias("y")).mapInArrow(_counted, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("n") >= LEAST)
    gap = F.col("t") * n - F.col("n") * t  # chi-square of the 2 x 2 table, up to a constant
    chi = gap.cast("double") * gap / (F.col("n") * (n - F.col("n") + 1.0))
    top = c.select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(FEATURES).collect()
    model = Model(names={r["f"]: i for i, r in enumerate(top)}, weights=np.zeros(len(top)))

    def hits(batches):
        for batch in batches:
            xs = [model.vector(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(x) for x in xs], pa.list_(pa.int32())), pa.array([list(x.values()) for x in xs], pa.list_(pa.float32()))], names=["grade", "i", "v"])

    got = rows.mapInArrow(hits, "grade int, i array<int>, v array<float>").toArrow()  # the bounded sample
    scratch.drop("labels", "labelled")
    at = got["i"].combine_chunks()
    lengths = np.diff(np.asarray(at.offsets))
    row, col, val = np.repeat(np.arange(n), lengths), np.asarray(at.flatten()), np.asarray(got["v"].combine_chunks().flatten(), dtype=np.float64)
    model.weights, model.thresholds = fitted(Hits(row, col, val, np.asarray(got["grade"]), len(top)))
    return model


@dataclass
class Hits:
    """Training rows: value val of feature col in row row, and the grade of each row."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    grade: np.ndarray
    features: int


def thresholds(p: np.ndarray) -> np.ndarray:
    """The first threshold and the logarithms of the steps between them -> ordered thresholds."""
    return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])


def loss(h: Hits, w: np.ndarray, p: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with its ridge, and its gradients by w and p.

    P(grade = g) = F(theta_g - eta) - F(theta_(g-1) - eta) with the logistic F, which is 0 below the first threshold and 1 above the last.
    """
    n, theta = len(h.grade), thresholds(p)
    eta = np.bincount(h.row, weights=w[h.col] * h.val, minlength=n)
    cdf = np.column_stack([np.zeros(n), 1 / (1 + np.exp(np.clip(eta[:, None] - theta[None], -500, 500))), np.ones(n)])
    rows = np.arange(n)
    hi, lo = cdf[rows, h.grade + 1], cdf[rows, h.grade]
    prob = np.maximum(hi - lo, 1e-300)
    g = np.bincount(h.col, weights=(1 - hi - lo)[h.row] * h.val, minlength=h.features) / n + ridge * w
    by_theta = np.zeros(len(theta))
    for k in range(len(theta)):  # the upper bound of grade k, the lower one of grade k + 1
        f = cdf[:, k + 1] * (1 - cdf[:, k + 1]) / prob
        by_theta[k] = (f[h.grade == k + 1].sum() - f[h.grade == k].sum()) / n
    tail = np.cumsum(by_theta[::-1])[::-1]
    gp = np.concatenate([tail[:1], tail[1:] * np.exp(p[1:])])
    return float(-np.log(prob).mean() + ridge / 2 * (w @ w)), g, gp


def fitted(h: Hits, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by Adam over all rows at once."""
    above = np.clip([(h.grade > k).mean() for k in range(GRADES)], 1e-4, 1 - 1e-4)
    start = np.log((1 - above) / above)
    x = np.concatenate([np.zeros(h.features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        _, g, gp = loss(h, x[: h.features], x[h.features :], ridge)
        gr = np.concatenate([g, gp])
        m1 += 0.1 * (gr - m1)
        m2 += 0.01 * (gr * gr - m2)
        x -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return x[: h.features], thresholds(x[h.features :])


def grade(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with severity double (expected grade), toxic_p double (P(grade > 0)), grade int (most probable), rejected boolean (severity of at least SEVERE)."""
    new = [T.StructField("severity", T.DoubleType()), T.StructField("toxic_p", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())]
    rest = [c for c in df.columns if c not in {x.name for x in new}]
    schema, place = T.StructType([df.schema[c] for c in rest] + new), rest.index(text)

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, place):
                p = np.array([model.above(model.vector(t)) for t in batch.column(place).to_pylist()]).reshape(batch.num_rows, GRADES)
                each = np.hstack([np.ones((len(p), 1)), p]) - np.hstack([p, np.zeros((len(p), 1))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(each.argmax(1).astype("int32")), pa.array(p.sum(1) >= SEVERE)], names=[x.name for x in schema])
        release()

    return df.select(*rest).mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with df's columns."""
    return keep(df, {"severity", "toxic_p", "grade", "rejected"}, lambda d: grade(d, model), ~F.col("rejected"))
