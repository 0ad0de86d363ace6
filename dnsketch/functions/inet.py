"""Addresses and prefixes."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 text -> number; null if it is none."""
    o = F.split(ip, r"\.")
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, ((o[0].cast("long") * 256 + o[1].cast("long")) * 256 + o[2].cast("long")) * 256 + o[3].cast("long"))


def ipv4_text(n: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.shiftrightunsigned(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def ipv4_bytes(n: Column) -> Column:
    """The four bytes of an IPv4 number, most significant first."""
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def _halves(n: int, width: int) -> tuple[int, int]:
    """An address as 128 bits, from the left, in two signed 64-bit numbers."""
    n <<= 128 - width
    return tuple(x - (1 << 64) if x >> 63 else x for x in (n >> 64, n & (1 << 64) - 1))


def masked_halves(hi: Column, lo: Column, plen: Column) -> tuple[Column, Column]:
    """The first plen bits of the 128, the others 0."""
    ones = lambda n: F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int"))
    left = F.when(plen <= 0, F.lit(0)).when(plen >= 64, hi).otherwise(hi.bitwiseAND(ones(64 - plen)))
    right = F.when(plen <= 64, F.lit(0)).when(plen >= 128, lo).otherwise(lo.bitwiseAND(ones(128 - plen)))
    return left.cast("long"), right.cast("long")


def packed(af: Column, hi: Column, lo: Column) -> Column:
    """The 4 or 16 bytes of an address."""
    text = F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (hi, lo)])
    return F.unhex(F.when(af == 4, F.substring(text, 1, 8)).when(af == 6, text))


ADDRESS = T.StructType().add("af", T.IntegerType()).add("hi", T.LongType()).add("lo", T.LongType()).add("text", T.StringType())


@F.pandas_udf(ADDRESS)
def address(text: pd.Series) -> pd.DataFrame:
    """af (4 or 6), 128 bits as two numbers (IPv4 in the first 32), canonical text; nulls for what is no address."""
    rows = []
    for x in text:
        try:
            a = ipaddress.ip_address(x)
            rows.append((a.version, *_halves(int(a), a.max_prefixlen), str(a)))
        except ValueError:
            rows.append((None, None, None, None))
    return pd.DataFrame(rows, columns=["af", "hi", "lo", "text"], dtype=object).astype({"af": "Int32", "hi": "Int64", "lo": "Int64"})


PREFIX = T.StructType().add("af", T.IntegerType()).add("hi", T.LongType()).add("lo", T.LongType()).add("plen", T.IntegerType())


@F.pandas_udf(PREFIX)
def prefix(text: pd.Series) -> pd.DataFrame:
    """`address/length` -> af, 128 bits with host bits cleared, plen; nulls for what is none."""
    rows = []
    for x in text:
        try:
            n = ipaddress.ip_network(x, strict=False)
            rows.append((n.version, *_halves(int(n.network_address), n.max_prefixlen), n.prefixlen))
        except ValueError:
            rows.append((None, None, None, None))
    return pd.DataFrame(rows, columns=["af", "hi", "lo", "plen"], dtype=object).astype({"af": "Int32", "hi": "Int64", "lo": "Int64", "plen": "Int32"})


ENDPOINT = re.compile(r"^(?:\[(?P<six>[0-9A-Fa-f:.]+)\]|(?P<four>\*|[0-9.]+))(?::(?P<port>\d{1,5}))?$")


def endpoint(text: str) -> tuple[str, int | None]:
    """`ip[:port]` or `[ip6][:port]`, * for any address."""
    m = ENDPOINT.match(text)
    if not m:
        raise ValueError(f"no address: {text!r}")
    port = int(m["port"]) if m["port"] else None
    if port is not None and not 1 <= port <= 65535:
        raise ValueError(f"no port: {text!r}")
    ip = m["six"] or m["four"]
    return ("*" if ip == "*" else str(ipaddress.ip_address(ip))), port
