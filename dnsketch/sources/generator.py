"""Random lookups for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("A", "AAAA", "NS", "MX")


def random_queries(spark: SparkSession, n: int, seed: int = 7, prefix: str = "load", suffix: str = "example.test") -> DataFrame:
    """id, qname, qtype: a middle label of 5 to 15 random letters; the same for the same seed and number.

    All of a name comes from the digits of SHA-256 of `seed|id`: the first four give its length, the next pairs its letters,
    the last two its type.
    """
    rows = spark.range(n).withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col("id").cast("string")), 256))
    digits = lambda at, k: F.conv(F.substring("h", at, k), 16, 10).cast("int")
    letter = lambda i: F.chr((97 + F.conv(F.substring(F.col("h"), 5 + 2 * i, F.lit(2)), 16, 10).cast("int") % 26).cast("long"))
    label = F.concat_ws("", F.transform(F.sequence(F.lit(0), digits(1, 4) % 11 + 4), letter))
    types = F.array(*[F.lit(t) for t in TYPES])
    return rows.select("id", F.concat_ws(".", F.lit(prefix), label, F.lit(suffix)).alias("qname"), types[digits(63, 2) % 4].alias("qtype"))
