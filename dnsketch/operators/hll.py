"""HyperLogLog as a table of registers (p = 14): add, merge, estimate; and Spark's own sketch beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsketch.functions.hashing import rank, register
from dnsketch.model import BIAS, BIAS_END

REGISTERS = 16384


def registers(rows: DataFrame, keys: list[str], h: str) -> DataFrame:
    """keys, reg, rank: the largest rank of each register; a map-side maximum, so no distinct is needed before."""
    return rows.select(*keys, register(F.col(h)).alias("reg"), rank(F.col(h)).alias("rank")).groupBy(*keys, "reg").agg(F.max("rank").alias("rank"))


def merged(table: DataFrame, keys: list[str], parity: bool = False) -> DataFrame:
    """Union of sketches: the maximum per register; parity gives the bitwise or, which overestimates."""
    return table.groupBy(*keys, "reg").agg((F.bit_or if parity else F.max)("rank").alias("rank"))


def estimated(table: DataFrame, keys: list[str], out: str = "estimate") -> DataFrame:
    """Linear counting below 2.5 x registers, bias-corrected raw estimate below 72000, raw beyond; truncated."""
    m = float(REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    s = table.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank").cast("double"))).alias("s"), F.count(F.lit(1)).alias("used"))
    zero = F.lit(REGISTERS) - F.col("used")
    raw = F.lit(alpha * m * m) / (F.col("s") + zero)
    s = s.withColumn("zero", zero).withColumn("raw", raw)
    e = F.col("raw")
    bias: Column = F.lit(BIAS[0])
    for c in BIAS[1:]:
        bias = bias * e + F.lit(c)
    value = F.when((e < 2.5 * m) & (F.col("zero") != 0), F.lit(m) * F.log(F.lit(m) / F.greatest("zero", F.lit(1)))).when(e < BIAS_END, e - e * (bias / 100)).otherwise(e)
    return s.select(*keys, value.cast("long").alias(out))


def native(rows: DataFrame, keys: list[str], column: str, out: str = "estimate") -> DataFrame:
    """Spark's HyperLogLog sketch at the same precision; merges with hll_union_agg."""
    return rows.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, 14)).alias(out))
