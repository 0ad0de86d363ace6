"""The report on a period's state, in four sections, as one text per period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsketch.functions.formulas import actual_fpr, approx_count, fill_rate
from dnsketch.operators.sketch import State


def _line(name: str, value: Column, width: int) -> Column:
    return F.concat(F.lit(f"{name:<{width}}: "), F.coalesce(value.cast("string"), F.lit("0")))


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def info_text(state: State) -> DataFrame:
    """period_end, report: versions, period, filter configuration, and a pair of lines for each filter."""
    cfg, b = state.config, F.col("bits_set")
    fill = fill_rate(b, cfg.bits)
    pair = F.format_string(
        "%2d. Number of bits set: %10d (Estimated number of host names: %10d)\n    Fill Rate:        %.10f (False positive probability:   %.20f)",
        F.col("filter_idx") + 1, b, approx_count(b, cfg.bits, cfg.hashes), fill, actual_fpr(fill, cfg.hashes),
    )
    filters = state.filter.select("period_end", F.struct("filter_idx", pair.alias("t")).alias("f")).groupBy("period_end").agg(F.array_sort(F.collect_list("f")).alias("f"))
    h = state.header.join(filters, "period_end")
    sections = [
        F.lit("\n## Version information ##\n"),
        _line("State file version", F.concat_ws(".", "major", "minor"), 18),
        F.lit("\n## Period information ##\n"),
        _line("Period begin", _time("period_begin"), 30), _line("First request", _time("first_request"), 30), _line("Last request", _time("last_request"), 30), _line("Period end", _time("period_end"), 30),
        _line("Estimated number of clients", F.col("est_clients"), 30), _line("Estimated number of host names", F.col("est_host_names"), 30), _line("Number of requests", F.col("number_of_requests"), 30),
        F.lit("\n## Filter configuration ##\n"),
        *[_line(name, F.col(c), 26) for name, c in (("Number of filters", "number_of_filters"), ("Number of filters per user", "number_of_filters_per_user"), ("Number of hashes", "number_of_hashes"), ("Number of bits per filter", "number_of_bits_per_filter"), ("Flatten threshold", "flatten_threshold"))],
        F.lit("\n## Filter information ##\n"),
        F.array_join(F.transform("f", lambda x: x["t"]), "\n"),
    ]
    return h.select("period_end", F.concat_ws("\n", *sections).alias("report"))
