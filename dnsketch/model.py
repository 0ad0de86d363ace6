"""Sketch geometry, table schemas and fixed values."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import types as T

# Fixed values
ACCEPTED_TYPES = ("A", "NS", "MX", "AAAA", "PTR")
MURMUR_SEED = 0xADC83B19
BUCKET_BITS = 32768  # bits of one bitmap row
UNKNOWN = "UNKNOWN"
FULL = 4294967295  # estimate of a filter whose bits are all set
FPR_ALARM = 0.001
# the bias of a raw estimate, in per cent, as a polynomial (highest power first), and where it ends
BIAS = (5.9119e-18, -1.4253e-12, 1.2940e-7, -5.2921e-3, 83.3216)
BIAS_END = 72000
THREAT_LEVELS = {1: "High", 2: "Medium", 3: "Low", 4: "Undefined"}
VERSION = (1, 0)


@dataclass(frozen=True)
class BloomConfig:
    """Geometry of a period's filters; every number must be positive and the bits a multiple of 8."""

    filters: int = 1
    bits: int = 1_048_576
    hashes: int = 10
    per_user: int = 1
    period: int = 86_400
    flatten: int = 0

    def __post_init__(self):
        if min(self.filters, self.bits, self.hashes, self.per_user, self.period) <= 0 or self.flatten < 0:
            raise ValueError("every count of a filter configuration must be positive")
        if self.bits % 8 or self.bits >= 1 << 32:
            raise ValueError("the bits of a filter must be a multiple of 8 below 2^32")
        if self.per_user > self.filters:
            raise ValueError("a user cannot have more filters than there are")

    @property
    def combos(self) -> list[tuple[int, ...]]:
        """All filter subsets of a user, in lexicographic order."""
        return list(combinations(range(self.filters), self.per_user))


SINGLE = BloomConfig()
SAMPLE = BloomConfig(6, 8_388_608, 5, 3, 86_400, 1)
TINY = BloomConfig(4, 4_096, 3, 2)
BENCH = BloomConfig(4, 134_217_728, 10, 2)


def combination_count(n: int, k: int) -> int:
    return comb(n, k)


def lookup_combination(n: int, k: int, index: int) -> tuple[int, ...]:
    """The index-th k-subset of range(n) in lexicographic order, without listing the others."""
    out, lo = [], 0
    for left in range(k, 0, -1):
        while index >= (c := comb(n - lo - 1, left - 1)):
            index -= c
            lo += 1
        out.append(lo)
        lo += 1
    return tuple(out)


SUBNETS = T.StructType().add(
    "subnet_activity",
    T.ArrayType(T.StructType().add("entity", T.StringType()).add("prefixes", T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))),
)
JOB = T.StructType().add("groups", T.ArrayType(T.StructType().add("id", T.LongType()).add("hostnames", T.MapType(T.StringType(), T.StringType()))))
GROUND_TRUTH = "ts long, kind string, client string, class string, type string, fqdn string"
MAIL_LOG = "ts string, ip string"
THREATS = T.StructType().add("response", T.ArrayType(T.StructType().add("Event", T.StructType().add("Attribute", T.ArrayType(T.StructType().add("type", T.StringType()).add("event_id", T.StringType())))
    .add("info", T.StringType()).add("threat_level_id", T.StringType()).add("Tag", T.ArrayType(T.StructType().add("name", T.StringType()))))))
