"""Counters per minute, type histograms, and the sizing advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsketch.functions.formulas import filter_size, optimal_k, round_up
from dnsketch.functions.names import normalised, tokens
from dnsketch.operators.lpm import client_entities
from dnsketch.sources.dnslog import accepted

TYPES = {"n_qa": "A", "n_qaaaa": "AAAA", "n_qns": "NS", "n_qmx": "MX", "n_qptr": "PTR"}


def counters(log: DataFrame, prefixes: DataFrame | None, window: Column, interval: int = 60) -> DataFrame:
    """The counters of each window.

    A client query that decodes is processed; of class IN and an accepted type it is accepted, else neither accepted nor
    skipped. A query that does not decode (null name), and any other message, is processed, skipped and invalid.
    """
    ok = (F.col("msg_type") == "CLIENT_QUERY") & F.col("qname").isNotNull()
    good = ok & accepted()
    if prefixes is not None:
        log = log.join(client_entities(log, prefixes), "ip", "left")
    entity = F.col("entity") if prefixes is not None else F.lit(None).cast("string")
    return log.groupBy(window.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_proc"), F.count_if(good).alias("n_acc"), F.count_if(~ok).alias("n_skip"), F.floor(F.count(F.lit(1)) / interval).alias("n_qsec"),
        *[F.count_if(good & (F.col("qtype") == t)).alias(c) for c, t in TYPES.items()],
        F.count_if(good & entity.isNotNull()).alias("n_qcat"), F.count_if(good & entity.isNull()).alias("n_qncat"), F.count_if(~ok).alias("n_invfrm"),
    )


def counter_line(c: DataFrame) -> DataFrame:
    """The counters as one line of a log."""
    order = ("n_proc", "n_acc", "n_skip", "n_qsec", *TYPES, "n_qcat", "n_qncat", "n_invfrm")
    return c.select("window_start", F.concat(F.lit("Instrumentation: "), F.concat_ws(",", *[F.concat(F.lit(f"{x}="), F.col(x)) for x in order])).alias("line"))


def distinct_tokens(rows: DataFrame, length: int, alias: str = "n") -> DataFrame:
    """Distinct tokens of each tumbling window; rows are made distinct before tokens are."""
    w = F.window("ts", f"{length} seconds")["start"].alias("window_start")
    once = rows.select(w, "host", "qtype").distinct()
    return once.select("window_start", F.explode(tokens(F.col("host"), F.col("qtype"))).alias("token")).distinct().groupBy("window_start").agg(F.count(F.lit(1)).alias(alias))


def advice(n: DataFrame, column: str, rates: tuple[float, ...] = (1e-3, 1e-4, 1e-5)) -> DataFrame:
    """p, m, k for the number in the first row of n: bits rounded up to 100,000 and shown with a tenth more, hashes for the bits without it."""
    rows = n.select(column, F.explode(F.array(*[F.struct(F.lit(int(round(1 / p))).alias("one_in"), filter_size(F.col(column), p).alias("raw")) for p in rates])).alias("x"))
    m = round_up(F.col("x.raw"), 100_000)
    return rows.select(column, F.col("x.one_in").alias("one_in"), F.floor(m * F.lit(1.1)).cast("long").alias("m"), optimal_k(F.col(column), m).alias("k"))


def accepted_rows(log: DataFrame) -> DataFrame:
    return log.filter(accepted()).select("event_id", "ts", "ip", "client", normalised("qname").alias("host"), "qtype")
