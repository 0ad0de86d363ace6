"""Operator 2: language identification by compression.

A text is compressed with one zstandard raw-content dictionary per language; the language whose dictionary gives the
fewest bytes wins. The margin to the runner-up is the score, and a narrow margin is a rejection.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected. Equal sizes go to the
language with more training documents, then the smaller name, with score 0. Without any training row, all is ``und``.
Rows repeat as they come; further columns stay; columns with the names of results are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsketch.llm.common import Scratch, batches_of, keep, release

UND = "und"
SAMPLE = 400  # documents read for each language's dictionary, at most
EXCERPT = 512  # bytes that one of them adds
DICTIONARY = 32 << 10  # bytes of a dictionary
BLOCK = 2048  # bytes compressed at once, so that a long text cannot become its own dictionary
LEVEL, SHORT, SHORT_LEVEL = 6, 400, 19  # texts of up to SHORT bytes get the level that finds 3-byte matches
MARGIN = 0.005  # a rejection below it
FULL = 0.25  # a margin that gives score 1

LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case words of letters, one space between: case, digits and signs say little of a language. Empty without a letter."""
    words = LETTERS.findall(text.lower())
    return " ".join(words).encode() if any(c.isalpha() for w in words for c in w) else b""


def learn(docs: DataFrame, usable: Column, scratch: Scratch, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary per language from at most SAMPLE documents of each, chosen by a hash of the key.

    Two passes: one counts languages (no text is read), one reads the texts whose hash is below its language's bound. Each
    language's excerpts are gathered in a task of their own; the driver gets three dictionaries of each and no text, and
    a worker holds one of each, so memory grows with the number of languages by DICTIONARY bytes and by nothing else.
    """
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()  # one row per language
    if not counts:
        return {}
    names = [r[0] for r in counts]
    # a hash in 0..2^20-1 below share * 2^20 keeps about twice SAMPLE documents; the smallest hashes are used
    space = 1 << 20
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(space, -(-2 * SAMPLE * space // r[1]) + 8))])
    h = F.pmod(F.xxhash64(key), F.lit(space))
    chosen = rows.filter(h < bounds[F.col(lang)]).select(F.col(lang).alias("lang"), h.alias("h"), F.col(key).alias("key"), F.substring(text, 1, 4 * EXCERPT).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "text"))
    chosen = chosen.select("lang", nth.cast("int").alias("nth"), "text").filter(F.col("nth") <= SAMPLE)
    samples = scratch.save(chosen.groupBy("lang").applyInArrow(_excerpts, "lang string, nth int, body binary"), "samples")
    halves = [_dictionaries(samples.filter(F.col("nth") % 2 == k), names) for k in (0, 1)]
    judges = [d if len(d) > 1 else {} for d in halves]

    def agreed(batches):  # what the dictionaries of the other half of the sample put in another language goes
        judge = [Classifier(d) if d else None for d in judges]
        for batch in batches:
            ok = [(j := judge[1 - n % 2]) is None or name not in j.names or j.best(b)[0] == name for name, n, b in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], names=["lang", "nth", "body", "ok"])

    # a wrong label would put a foreign text into a dictionary, and each of its copies would then fit there
    judged = scratch.save(samples.mapInArrow(agreed, "lang string, nth int, body binary, ok boolean"), "judged")
    all_out = judged.groupBy("lang").agg(F.bool_or("ok").alias("any"))
    kept = judged.join(all_out, "lang").filter("ok or not any").select("lang", "nth", "body")
    found = _dictionaries(kept, names)
    scratch.drop("samples", "judged")
    return found


def _excerpts(t: pa.Table) -> pa.Table:
    """One language's (lang, nth, text) -> its distinct excerpts in order, numbered from 0."""
    t = t.sort_by("nth")
    parts = [b for b in dict.fromkeys(plain(x)[:EXCERPT] for x in t["text"].to_pylist()) if len(b) >= 8]
    return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(parts), pa.string()), "nth": pa.array(range(len(parts)), pa.int32()), "body": pa.array(parts, pa.binary())})


def _dictionaries(samples: DataFrame, names: list[str]) -> dict[str, bytes]:
    """Excerpts joined in order up to the size of a dictionary; languages without any are left out."""

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("nth")
        return pa.table({"lang": t["lang"][:1], "d": pa.array([b" ".join(t["body"].to_pylist())[:DICTIONARY]], pa.binary())})

    got = {r["lang"]: bytes(r["d"]) for r in samples.groupBy("lang").applyInArrow(joined, "lang string, d binary").collect()}
    return {name: got[name] for name in names if name in got}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        """dictionaries: the language with most training documents first."""
        self.names = list(dictionaries)
        self.levels = {lvl: [self._compressor(d, lvl) for d in dictionaries.values()] for lvl in (LEVEL, SHORT_LEVEL)}

    @staticmethod
    def _compressor(d: bytes, level: int):
        import zstandard

        raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False, write_checksum=False)

    def best(self, b: bytes) -> tuple[str, float]:
        """(language, margin to the runner-up as a share of its size)"""
        compressors = self.levels[SHORT_LEVEL if len(b) <= SHORT else LEVEL]
        blocks = [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]
        sizes = [sum(len(c.compress(x)) for x in blocks) for c in compressors]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)  # stable: ties to more training documents
        if len(order) == 1:
            return self.names[order[0]], 1.0
        return self.names[order[0]], (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        b = plain(text) if text else b""
        if not b or not self.names:
            return UND, 0.0, True
        name, margin = self.best(b)
        return name, min(1.0, margin / FULL), margin < MARGIN


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """df with lang_pred string, score double, rejected boolean."""
    rest = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    place, names = rest.index(text), [*rest, "lang_pred", "score", "rejected"]

    def run(batches):
        c = Classifier(dictionaries)
        for whole in batches:
            for batch in batches_of(whole, place):
                got = [c.predict(t) for t in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=names)
        release()

    return df.select(*rest).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], shortest: int = 100) -> DataFrame:
    """The rows that are not rejected, with df's columns.

    A text of fewer than ``shortest`` letters says too little for a margin to count against it and stays, if it has any.
    """
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return keep(df, {"lang_pred", "score", "rejected"}, lambda d: identify(d, dictionaries), ~F.col("rejected") | ((F.col("lang_pred") != UND) & (letters < shortest)))
