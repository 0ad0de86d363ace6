"""Operator 8: packing token sequences by shortest-pack-first over the length histogram.

Every text is tokenised with an end id; a document longer than a sequence is cut at multiples of the sequence length.
The histogram of piece lengths (at most one entry per length) goes to the driver, which places lengths longest first,
each into the packs that are shortest so far, and keeps counts of packing patterns instead of packs. The patterns are
a small table of slots; pieces get a rank within their length and find their slot by it.

Defined results: a null or empty text has the end id alone; the tokenizer's special strings in a text have their own ids,
as the library gives them; repeated rows are packed each; equal pieces are told apart by a hash of the whole row only as far as the rank needs it, so which of two
equal rows gets which slot is arbitrary but each gets one. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsketch.llm.common import Scratch, batches_of, listed, ranked, release, words_of

MEMO = 120_000  # remembered words, in each of two generations
MEMO_CHARS = 64
AT_ONCE = 5_000  # words that the library encodes at once; its results are large


class WordTokenizer:
    """Ids of a tokenizer that lowers case and drops white space: words between ASCII spaces are tokenised apart and
    remembered, and so is a full stop or comma behind a letter, which such a tokenizer never joins with it.

    Special strings are taken out of the text as it is written, before anything else, as the library does.
    """

    def __init__(self, file: str, end: int, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        added = self.library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that look at what is around them are not supported")
        self.special = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        either = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = re.compile(f"({either})") if either else None
        # a word is never special: what is special in it only once case is gone is ordinary text
        self.library.encode_special_tokens = True
        self.end, self.most = end, memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, then the end id, as little-endian 32-bit numbers."""
        tail = self.end.to_bytes(4, "little")
        hit = self.cut and pc.match_substring_regex(texts, self.cut.pattern)
        if not hit or not pc.any(hit).as_py():
            return [x + tail for x in self.plain(texts)]
        rows = [self.cut.split(t or "") for t in texts.to_pylist()]  # text, special, text, ...
        got = iter(self.plain(pa.array([x for r in rows for x in r[::2]], pa.large_string())))
        return [b"".join(self.special[x] if i % 2 else next(got) for i, x in enumerate(r)) + tail for r in rows]

    def plain(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text without special strings."""
        flat, counts = words_of(texts, lower=True, stops=True)
        d = flat.dictionary_encode()
        words = [w.decode() for w in listed(d.dictionary)]
        new, old = self.memo, self.older
        of = list(map(new.get, words))
        fresh = []
        for i in [i for i, x in enumerate(of) if x is None]:
            x = old.get(words[i])
            if x is None:
                fresh.append(i)
            else:
                of[i] = new[words[i]] = x
        for k in range(0, len(fresh), AT_ONCE):
            some = fresh[k : k + AT_ONCE]
            for i, e in zip(some, self.library.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                of[i] = x = array("I", e.ids).tobytes()
                if len(words[i]) <= MEMO_CHARS:
                    new[words[i]] = x
        if len(new) >= self.most:
            self.memo, self.older = {}, new
        each = np.empty(len(of), object)
        each[:] = of
        at = each[np.asarray(d.indices)]
        ends = np.cumsum(counts).tolist()
        return [b"".join(at[lo:hi].tolist()) for lo, hi in zip([0, *ends], ends)]


@cache
def loaded(file: str, end: int, memo: int = MEMO) -> WordTokenizer:
    """One per Python worker, so that what is remembered outlives a task."""
    return WordTokenizer(file, end, memo)


def pieces(docs: DataFrame, file: str, length: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (binary, little-endian 32 bits) of each piece.

    memo: words that a Python worker remembers; more of them take memory and save time.
    """
    import os
    import zlib

    schema = T.StructType([docs.schema[doc_id], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")], *[T.StructField("ids", T.BinaryType())] * with_ids])
    names = [f.name for f in schema]

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = loaded(file, end, memo)
        for whole in batches:
            for batch in batches_of(whole, 1, 6 << 20):
                row, start, n, crc, total, ids = [], [], [], [], [], []
                for i, x in enumerate(t.packed(batch.column(1))):
                    for k in range(0, len(x), 4 * length):
                        part = x[k : k + 4 * length]
                        row.append(i)
                        start.append(k // 4)
                        n.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(x) // 4)
                        if with_ids:
                            ids.append(part)
                own = batch.column(0).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, pa.int64()) for c in (start, n, crc, total)], *[pa.array(ids, pa.binary())] * with_ids], names=names)
        release()

    return docs.select(doc_id, text).mapInArrow(run, schema)


@dataclass
class Pattern:
    """So many sequences, each with pieces of these lengths in this order."""

    count: int
    lengths: tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[Pattern]:
    """Packing patterns for the histogram: lengths longest first, each into the shortest packs that are open.

    A pack is open while it has room. Packs with the same contents are one pattern with a count, which is split when
    only some of them take the next piece.
    """
    room: dict[int, list[Pattern]] = {}
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        taken: list[tuple[int, Pattern]] = []  # a pack takes a piece of this length, then waits for the others
        while left:
            most = max(room, default=-1)
            if most < n:  # a new pack takes as many of this length as fit, being the shortest, before the next is opened
                per = length // n
                for k, m in ((left // per, per), (1, left % per)):
                    if k and m:
                        taken.append((length - m * n, Pattern(k, (n,) * m)))
                left = 0
                break
            stack = room[most]
            p = stack.pop()
            if not stack:
                del room[most]
            k = min(left, p.count)
            if k < p.count:
                room.setdefault(most, []).append(Pattern(p.count - k, p.lengths))
            left -= k
            r = most - n
            if r >= n:  # may take another of this length once the shorter packs have had theirs
                room.setdefault(r, []).append(Pattern(k, (*p.lengths, n)))
            else:
                taken.append((r, Pattern(k, (*p.lengths, n))))
        for r, p in taken:
            same = next((q for q in room.get(r, []) if q.lengths == p.lengths), None)
            if same:
                same.count += p.count
            else:
                room.setdefault(r, []).append(p)
    return [p for r in sorted(room) for p in room[r]]


def slots(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    """length, first rank, count, first sequence, offset: where the pieces of each length go, by rank.

    At most patterns x pieces of a pattern rows; both are bounded by the number of lengths, not by the data.
    """
    rows, next_rank, base = [], {}, 0
    for p in patterns:
        at = 0
        for n in p.lengths:
            lo = next_rank.get(n, 0)
            rows.append((n, lo, lo + p.count, base, at))
            next_rank[n] = lo + p.count
            at += n
        base += p.count
    return spark.createDataFrame(rows or [], "s_length long, lo long, hi long, base long, s_offset long")


def pack(parts: DataFrame, scratch: Scratch, length: int = 2048) -> DataFrame:
    """parts (doc_id, start, length, ...) with sequence_id and offset."""
    parts = scratch.save(parts, "pieces")
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # one row per length
    plan = slots(scratch.spark, shortest_pack_first(histogram, length))
    keys = [F.col(c) for c in ("doc_id", "start", *(c for c in ("ids_crc32", "doc_tokens") if c in parts.columns))]
    buckets = max(16, max(histogram.values(), default=0) // 200_000)
    rank = ranked(parts, ["length"], keys, "rank", buckets)
    hit = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = rank.join(F.broadcast(plan), hit)
    return placed.select(*parts.columns, (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("s_offset").alias("offset"))
