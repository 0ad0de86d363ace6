"""Operator 10: substring dedup by hashing lines and their sentences.

Units: lines are cut where a sentence ends and where a capitalised word follows, so that a passage pasted into the
middle of a line has units of its own. Words are what white space of any kind separates, or every SIGNS characters, or
every DENSE_SIGNS characters of a script without spaces, where that is more. A unit is normalised (lower case, single spaces) and hashed to 128 bits. One of
fewer than ANCHOR words says too little by itself: it is hashed twice, with as many units behind it and with as many
before it as give ANCHOR words, across lines. Digests are grouped over the whole table, the occurrence with the smallest
(doc_id, text hash, offset) is kept, and every later one is a repeat; a short unit is one if either of its digests is.
Units travel packed, not as rows: a slice of documents is one row, sends the first place of each of its digests to the
digests' buckets, one row for each, and gets back those that another slice has earlier.
What is removed are runs of repeated units of one document with RUN words or more. Only white space lies between the
units of a run, so no text goes that was not compared: a unit of its own ends a run, however short, and a single short
sentence that two documents happen to share stays. The spans that go are returned with their offsets in the original text.

Defined results: null or empty texts have no unit and stay as they are. Null ids rank last. Rows with the same doc_id
and text are one document (each keeps or loses the same). A repeat within one document is removed as well. A document
that loses everything stays with an empty text. Repeats of fewer than RUN words stay and are listed in ``repeated``.
Further columns stay; columns named ``removed`` or ``repeated`` are replaced.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsketch.llm.common import Scratch, batches_of, release

ANCHOR = 4  # words a unit needs to be hashed by itself
RUN = 25  # words a run of repeated units needs to go
SIGNS = 10  # so many characters without a space count as a word
DENSE_SIGNS = 2  # and so many of a script that is written without spaces
SLICE = 4 << 20  # bytes of text whose units are one row
BUCKET = 500_000  # digests of all slices that are compared at once

DOC = np.dtype([("d", "<i8"), ("h", "<i8"), ("last", "?"), ("units", "<i4")])
UNIT = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("words", "<i4")])
ENTRY = np.dtype([("unit", "<i4"), ("key", "<i4")])  # a digest of a unit: their places among the slice's units and keys
KEY = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("d", "<i8"), ("h", "<i8"), ("lo", "<i4"), ("last", "?")])  # a digest's first place in a slice
REPLY = np.dtype([("key", "<i4"), ("d", "<i8"), ("last", "?")])  # a key that another slice has earlier, in document d


def _upper() -> str:
    """The upper-case letters as a character class, from Unicode's own rule."""
    out, start = [], None
    for c in range(0x250C0):
        up = chr(c).isupper()
        if up and start is None:
            start = c
        elif not up and start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(c - 1)) if c - 1 > start else ""))
            start = None
    return "".join(out)


STOPS, WIDE, CLOSING = ".!?…。！？｡", "。！？｡", "」』”’）》】"  # wide stops need no space behind them, closing marks belong to them
# white space or a stop: then the space behind a stop, the end of a wide sentence, a line feed, or a space that a capitalised
# word follows (what stands before it is looked at by the caller). One class of signs in front keeps the search fast, and a
# space before a to z, which most are, is no cut.
CUT = re.compile(rf"[\s{STOPS}](?:(?![a-z])|(?<=[\n{WIDE}]))(?:(?<=[{STOPS}])(\s+)|(?<=[{WIDE}])([{CLOSING}]?)(?![\s{WIDE}{CLOSING}])|(?<=\n)\s*|(?<=[^\S\n])[^\S\n]*(?:\n\s*|()(?=[{_upper()}][^\W\d_A-Z])))")
# Blocks of scripts that are written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han)
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of each unit, in order; all but white space is in one of them."""
    cuts = []  # where a unit ends and where the next begins
    for m in CUT.finditer(text):
        lo, kind = m.start(), m.lastindex
        if kind == 1:
            lo += 1
        elif kind == 2:
            lo = m.end()
        elif kind == 3 and not (lo and ((before := text[lo - 1]) in ",;:" or before.isalpha() and not "A" <= before <= "Z")):
            continue
        cuts.append((lo, m.end()))
    cuts.append((len(text), len(text)))
    out: list[tuple[int, int, int]] = []
    at = 0
    dense = DENSE.search(text) is not None
    for lo, behind in cuts:
        u = text[at:lo]
        if n := len(u.split()):
            if (signs := (len(u) - n + 1) // SIGNS) > n:
                n = signs
            out.append((at, lo, max(n, len(DENSE.findall(u)) // DENSE_SIGNS) if dense else n))
        at = behind
    return out


def hashed(text: str, found: list[tuple[int, int, int]]) -> list[list[bytes]]:
    """What is hashed of each unit: itself, or with the units behind it and before it if it is short."""
    low = text.lower()
    if len(low) == len(text) and "\u03a3" not in text:  # else a letter's place, or a sigma's form, depends on what stands around
        norms = [" ".join(low[lo:hi].split()) for lo, hi, _ in found]
    else:
        norms = [" ".join(text[lo:hi].lower().split()) for lo, hi, _ in found]
    out = []
    for k, (_, _, n) in enumerate(found):
        if n >= ANCHOR:
            out.append([norms[k].encode()])
            continue
        parts, j, m = [], k + 1, n
        while j < len(found) and (m := m + found[j][2]) < ANCHOR:
            j += 1
        if j < len(found):
            parts.append("\n".join([">", *norms[k : j + 1]]).encode())
        j = k - 1
        while j >= 0 and (n := n + found[j][2]) < ANCHOR:
            j -= 1
        if j >= 0:
            parts.append("\n".join(["<", *norms[j : k + 1]]).encode())
        out.append(parts)
    return out


def _by_digest(d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by digest, and for each place in it whether a digest begins there."""
    order = np.argsort(d1, kind="stable")
    a, b = d1[order], d2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((d2, d1))
        a, b = d1[order], d2[order]
    return order, np.append(np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))


def _sliced(batches):
    """(d, h, text) -> one row for each slice: its documents in order, their units, what is hashed of them, and its keys by digest."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for whole in batches:
        for batch in batches_of(whole, 2, SLICE):
            last = np.asarray(batch.column(0).is_null())
            d, h = np.asarray(pc.fill_null(batch.column(0), 0)), np.asarray(batch.column(1))
            docs, units_, unit_of, digests = [], [], [], []
            before, at = None, 0
            for i in np.lexsort((h, d, last)).tolist():
                text, place = batch.column(2)[i].as_py(), (d[i], h[i], last[i])
                if not text or place == before:  # rows with the same id and text are one document
                    continue
                before = place
                if found := units(text):
                    for k, parts in enumerate(hashed(text, found), at):
                        for part in parts:
                            unit_of.append(k)
                            digests.append(digest(part))
                    units_.append(np.array(found, "<i4"))
                    docs.append((*place, len(found)))
                    at += len(found)
            if not docs:
                continue
            docs, units_ = np.array(docs, DOC), np.concatenate(units_)
            two = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            order, new = _by_digest(two[:, 0], two[:, 1])
            entries = np.empty(len(order), ENTRY)
            entries["unit"] = unit_of
            entries["key"][order] = np.cumsum(new) - 1
            first = order[new]  # units are in the order of their places, and the order by digest keeps that
            unit = entries["unit"][first]
            doc = docs[np.repeat(np.arange(len(docs)), docs["units"])[unit]]
            keys = np.empty(len(first), KEY)
            keys["d1"], keys["d2"], keys["lo"] = two[first, 0], two[first, 1], units_[unit, 0]
            for c in ("d", "h", "last"):
                keys[c] = doc[c]
            yield pa.RecordBatch.from_pylist([{"s": uuid.uuid4().hex, "n": len(keys), "docs": docs.tobytes(), "units": units_.tobytes(), "entries": entries.tobytes(), "keys": keys.tobytes()}])
    release()


def _dealt(buckets: int):
    """(s, keys) -> the keys of each slice in each bucket; at: how many of the slice's keys stand before them."""

    def deal(batches):
        for batch in batches:
            for s, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bucket = ((np.frombuffer(keys, KEY)["d1"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
                ends = np.append(starts[1:], len(bucket))
                parts = [keys[lo * KEY.itemsize : hi * KEY.itemsize] for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array([s] * len(parts)), pa.array(starts, pa.int32()), pa.array(parts, pa.binary())], names=["b", "s", "at", "keys"])

    return deal


def _answered(table: pa.Table) -> pa.Table:
    """The keys of one bucket -> replies to the slices: the keys that another slice has earlier, with the earliest document."""
    parts = [np.frombuffer(x, KEY) for x in table["keys"].to_pylist()]
    sizes = np.array([len(x) for x in parts])
    source = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.asarray(table["at"])[source]
    keys = np.concatenate(parts)
    order, new = _by_digest(keys["d1"], keys["d2"])
    several = order[~(new & np.append(new[1:], True))]
    several = several[np.lexsort([keys[c][several] for c in ("lo", "h", "d", "last", "d2", "d1")])]
    x = keys[several]
    begin = np.append(np.ones(min(1, len(x)), bool), (x["d1"][1:] != x["d1"][:-1]) | (x["d2"][1:] != x["d2"][:-1]))
    first = x[np.flatnonzero(begin)][np.cumsum(begin) - 1]
    later = np.zeros(len(x), bool)
    for c in ("last", "d", "h", "lo"):
        later |= x[c] != first[c]
    later = np.flatnonzero(later)
    later = later[np.argsort(source[several[later]], kind="stable")]
    out = np.empty(len(later), REPLY)
    out["key"], out["d"], out["last"] = place[several[later]], first["d"][later], first["last"][later]
    to, starts = np.unique(source[several[later]], return_index=True)
    ends = np.append(starts[1:], len(out))
    return pa.table({"s": table["s"].combine_chunks().take(pa.array(to)).cast(pa.string()), "replies": pa.array([out[lo:hi].tobytes() for lo, hi in zip(starts.tolist(), ends.tolist()[: len(starts)], strict=True)], pa.binary())})


RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("words", pa.int32()), ("of", pa.list_(pa.int64()))]))


def _joined(slices: pa.Table, replies: pa.Table) -> pa.Table:
    """A slice and the replies to it -> the runs of repeated units of each of its documents."""
    docs, units_, entries = (np.frombuffer(slices[c][0].as_py(), kind) for c, kind in (("docs", DOC), ("units", UNIT), ("entries", ENTRY)))
    got = np.frombuffer(b"".join(replies["replies"].to_pylist()), REPLY)
    doc = np.repeat(np.arange(len(docs)), docs["units"])
    n = int(slices["n"][0].as_py())
    first = np.empty(n, np.int64)
    first[entries["key"][::-1]] = entries["unit"][::-1]
    of, unknown, other = docs["d"][doc[first]], docs["last"][doc[first]], np.zeros(n, bool)
    of[got["key"]], unknown[got["key"]], other[got["key"]] = got["d"], got["last"], True
    again = entries[other[entries["key"]] | (entries["unit"] != first[entries["key"]])]
    unit = np.unique(again["unit"])
    begin = np.append(np.ones(min(1, len(unit)), bool), (np.diff(unit) > 1) | (np.diff(doc[unit]) > 0))
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(unit))[: len(starts)]
    words = np.add.reduceat(units_["words"][unit].astype(np.int64), starts) if len(starts) else starts
    run = (np.cumsum(begin) - 1)[np.searchsorted(unit, again["unit"])]
    known = ~unknown[again["key"]]
    run, kept = run[known], of[again["key"]][known]
    order = np.lexsort((kept, run))
    run, kept = run[order], kept[order]
    new = np.append(np.ones(min(1, len(run)), bool), (np.diff(run) > 0) | (kept[1:] != kept[:-1]))
    run, kept = run[new], kept[new]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(run, np.arange(len(starts) + 1)), pa.int32()), pa.array(kept, pa.int64()))
    lo, hi = units_["lo"][unit[starts]], units_["hi"][unit[ends - 1]]
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (lo, hi, np.minimum(words, 2**31 - 1))] + [lists], names=["lo", "hi", "words", "of"])
    at, counts = np.unique(doc[unit[starts]], return_counts=True)
    found = docs[at]
    return pa.table({"d": pa.array(found["d"]), "h": pa.array(found["h"]), "last": pa.array(found["last"]), "runs": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), runs).cast(RUNS)})


def repeats(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d (doc_id, 0 if null), h (text hash), last (doc_id is null), runs: the runs of repeated units of each document that has one."""
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    slices = scratch.save(rows.mapInArrow(_sliced, "s string, n long, docs binary, units binary, entries binary, keys binary"), "slices")
    total = slices.agg(F.sum("n")).first()[0] or 0
    buckets = max(min(256, total // 1000 + 1), -(-total // BUCKET))
    sent = slices.select("s", "keys").mapInArrow(_dealt(buckets), "b int, s string, at int, keys binary")
    replies = sent.groupBy("b").applyInArrow(_answered, "s string, replies binary")
    back = slices.select("s", "n", "docs", "units", "entries").groupBy("s").cogroup(replies.groupBy("s"))
    found = scratch.save(back.applyInArrow(_joined, "d long, h long, last boolean, runs array<struct<lo: int, hi: int, words: int, of: array<long>>>"), "runs")
    scratch.drop("slices")
    return found


def spans(runs: list[dict], text: str, least: int = RUN) -> list[tuple[int, int, list[int]]]:
    """The spans of text that go: neighbouring repeated units with enough words together, and the space behind them.

    This and all_spans are the plain form, for a caller that has one document's repeated units; the tests hold tables against it.
    With each span, the documents that have the earliest occurrences of its units.
    """
    return [(lo, hi, of) for lo, hi, of, n in all_spans(runs, text) if n >= least]


def all_spans(runs: list[dict], text: str) -> list[tuple[int, int, list[int], int]]:
    """The same for all runs of repeated units, however short, with their words."""
    out: list[tuple[int, int, list[int], int]] = []
    runs = sorted(runs, key=lambda r: r["k"])  # a short unit comes twice if both of its digests are repeats
    i = 0
    while i < len(runs):
        j, n = i, runs[i]["words"]
        while j + 1 < len(runs) and (step := runs[j + 1]["k"] - runs[j]["k"]) <= 1:
            j += 1
            n += runs[j]["words"] if step else 0
        lo, hi = runs[i]["lo"], runs[j]["hi"]
        while hi < len(text) and text[hi].isspace():
            hi += 1
        out.append((lo, hi, sorted({r["of"] for r in runs[i : j + 1]} - {None}), n))
        i = j + 1
    return out


def without_repeats(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least: int = RUN) -> DataFrame:
    """docs with text without its repeated passages, removed and repeated, both array<struct<start, end, kept_in>>: offsets in the
    original text, and the documents that have the earliest occurrence (null ids are left out of that list).

    removed: the runs that went; repeated: those of fewer than `least` words, down to a single line, that stay. least = 1
    removes every repeated unit.
    """
    rest = [c for c in docs.columns if c not in ("removed", "repeated")]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kept_in", T.ArrayType(T.LongType()))])
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, T.ArrayType(span)) for c in ("removed", "repeated")])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept_in", pa.list_(pa.int64()))]))
    names = [*rest, "removed", "repeated"]
    place = rest.index(text)

    def cut(batches):
        for whole in batches:
            for batch in batches_of(whole, place):
                texts, gone, stay = [], [], []
                for t, runs in zip(batch.column(place).to_pylist(), batch.column(len(rest)).to_pylist(), strict=True):
                    removed, repeated = [], []
                    for r in runs or ():
                        hi = r["hi"]
                        while hi < len(t) and t[hi].isspace():
                            hi += 1
                        (removed if r["words"] >= least else repeated).append({"start": r["lo"], "end": hi, "kept_in": r["of"]})
                    if removed:
                        ends = [0, *(x for r in removed for x in (r["start"], r["end"])), len(t)]
                        t = "".join(t[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)).rstrip()
                    texts.append(t)
                    gone.append(removed)
                    stay.append(repeated)
                columns = [*batch.columns[:place], pa.array(texts, pa.string()), *batch.columns[place + 1 : len(rest)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, kind), pa.array(stay, kind)], names=names)
        release()

    # rows of one id and text may lie in several slices, which all find the same
    found = repeats(docs, scratch, doc_id, text).groupBy("d", "h", "last").agg(F.first("runs").alias("_runs")).withColumnsRenamed({"d": "_of", "h": "_hash", "last": "_null"})
    key = F.col(doc_id).cast("long")
    marked = docs.select(*rest, F.coalesce(key, F.lit(0)).alias("_d"), F.xxhash64(text).alias("_h"), key.isNull().alias("_last"))
    joined = marked.join(found, (F.col("_d") == F.col("_of")) & (F.col("_h") == F.col("_hash")) & (F.col("_last") == F.col("_null")), "left")
    return joined.select(*rest, "_runs").mapInArrow(cut, schema)
