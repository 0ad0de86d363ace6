"""Bloom filter formulas as columns."""

from __future__ import annotations

from math import ceil, log, log2, trunc

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsketch.model import FULL


def fill_rate(bits_set: Column, m) -> Column:
    return bits_set.cast("double") / m


def actual_fpr(fill: Column, k) -> Column:
    return F.pow(fill, F.lit(k).cast("double"))


def approx_count(bits_set: Column, m: int, k: int) -> Column:
    """Distinct entries behind so many set bits; the largest 32-bit number if all are set."""
    x = bits_set.cast("double")
    estimate = F.round(-F.lit(m / k) * F.log(1 - F.least(x, F.lit(m - 1.0)) / m)).cast("long")
    return F.when(bits_set >= m, F.lit(FULL)).otherwise(estimate)


def optimal_k(n: Column, m: Column) -> Column:
    """Hash functions for n entries in m bits; m is divided by n as whole numbers first."""
    ratio = F.floor(m.cast("double") / n.cast("double"))
    return F.when(n > 0, F.ceil(ratio * F.log(F.lit(2.0)))).otherwise(F.lit(0)).cast("long")


def filter_size(n: Column, p: float) -> Column:
    """Bits for n entries at a false-positive rate of p."""
    return (-(n.cast("double") * log(p)) / (log(2) ** 2)).cast("long")


def theoretical_fpr(k: Column, n: Column, m: Column) -> Column:
    """(1 - exp(-k n / m))^k with whole-number division inside."""
    inner = -F.floor((k * n).cast("double") / m)
    return F.pow(1 - F.exp(inner.cast("double")), k.cast("double"))


def round_up(x: Column, multiple: int) -> Column:
    return x if multiple == 0 else (F.ceil(x.cast("double") / multiple) * multiple).cast("long")


def required_entropy(m: int, k: int) -> int:
    """Bits of hash that k offsets in m bits consume; more than 512 deserve a warning."""
    return k * ceil(log2(m))


def advised(n: int, p: float) -> tuple[int, int]:
    """(bits shown, hashes) of the sizing advice: bits rounded up to 100,000 plus a tenth, hashes from those before."""
    m = trunc(-(n * log(p)) / (log(2) ** 2))
    m = -(-m // 100_000) * 100_000
    return trunc(m * 1.1), ceil((m // n) * log(2)) if n > 0 else 0
