"""Operator 1: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps the adjacent symbol pairs that form a piece on a score-ordered agenda and merges the best first
(ties: leftmost). Texts are cut where no piece of the vocabulary can reach across, so each piece of text is merged on
its own and the ids of short pieces are remembered. In each Arrow batch, every newly merged piece of text and the decoded
form of every row are checked against the sentencepiece library, and so are the ids of whole rows, one in CHECKED and one a
batch at least: there a difference fails the task.

Defined results: a null or empty text has no pieces, so only the end id; rows repeat as they come; further columns stay.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsketch.llm.common import batches_of

SPACE = "▁"
MEMO = 500_000  # remembered pieces of text, in each of two generations
MEMO_CHARS = 48  # longer ones are merged anew each time
CHECKED = 64  # one row in so many is compared with the library as a whole
SHORT = 32  # up to here the agenda is a plain list, scanned for its best entry; beyond, a heap


def _fields(b: bytes):
    """(field number, value) of one protobuf message."""
    i = 0

    def varint():
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            v = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class PieceBpe:
    """A merge-type vocabulary read from its model file."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        with open(model, "rb") as f:
            top = list(_fields(f.read()))
        spec = dict(_fields(next((v for k, v in top if k == 3), b"")))
        train = dict(_fields(next((v for k, v in top if k == 2), b"")))
        if train.get(3, 1) != 2 or spec.get(2, b""):
            raise ValueError("the model is no merge-type vocabulary without a character map")
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.squeeze or not self.escape:
            raise ValueError("models that squeeze or keep plain spaces are not supported")
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)}
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        order = {v: r for r, v in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.never = len(order)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk, self.eos = sp.unk_id(), sp.eos_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        # what an id stands for if it stands for that whatever is beside it; NUL for the others
        self.plain = ["" if i in self.silent else "\0" if i == self.unk or self.byte_of.get(i, 1) in (0, *range(128, 256)) else chr(self.byte_of[i]) if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        # a cut is safe before a space mark that follows another sign, and around line feeds, if no piece crosses it
        safe = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        line = "\n" if not any("\n" in p for p in self.ids) else ""
        self.cut = re.compile(f"{line}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S) if safe else re.compile(".+", re.S)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, s: str) -> list[int]:
        """The ids of one piece of text, by the agenda."""
        return self.named(self.scanned(s) if len(s) <= SHORT else self.heaped(s))

    def scanned(self, s: str) -> list[str]:
        rank, never, sym = self.rank.get, self.never, list(s)
        agenda = [rank(a + b, never) for a, b in zip(sym, sym[1:])]
        while agenda and (best := min(agenda)) < never:
            i = agenda.index(best)
            sym[i] += sym.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(sym[i] + sym[i + 1], never)
            if i:
                agenda[i - 1] = rank(sym[i - 1] + sym[i], never)
        return sym

    def heaped(self, s: str) -> list[str]:
        sym: list[str] = list(s)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, agenda = self.rank, []

        def offer(i: int, j: int) -> None:
            whole = sym[i] + sym[j]
            v = rank.get(whole)
            if v is not None:
                heapq.heappush(agenda, (v, i, j, len(whole)))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or right[i] != j or len(sym[i]) + len(sym[j]) != size:
                continue  # one side has been merged meanwhile
            sym[i] += sym[j]
            sym[j] = ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                offer(i, k)
            if left[i] >= 0:
                offer(left[i], i)
        return sym

    def named(self, sym: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in sym if p]
        except KeyError:  # a sign without a piece
            pass
        out: list[int] = []
        for p in sym:
            if p:
                v = self.ids.get(p)
                if v is not None:
                    out.append(v)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in p.encode())
                else:
                    out.append(self.unk)
        return out

    def packed(self, texts: list[str | None], end: bool = True) -> tuple[list[bytes], bool]:
        """The ids of each text as little-endian 32-bit numbers, and whether the library agrees on every new piece of text.

        Pieces seen lately are remembered in two generations: when the newer is full, it becomes the older one.
        """
        out, fresh = [], []
        tail = self.eos.to_bytes(4, "little") if end else b""
        new, old = self.memo, self.older
        for text in texts:
            if not text:
                out.append(tail)
                continue
            parts = self.cut.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))
            got = list(map(new.get, parts))
            if None in got:
                for i, x in enumerate(got):
                    if x is None:
                        s = parts[i]
                        x = new.get(s) or old.get(s)
                        if x is None:
                            x = array("i", self.merge(s)).tobytes()
                            fresh.append((s, x))
                        if len(s) <= MEMO_CHARS:
                            new[s] = x
                        got[i] = x
                if len(new) >= MEMO:
                    old, new = new, {}
            got.append(tail)
            out.append(b"".join(got))
        self.memo, self.older = new, old
        return out, self.confirmed(fresh)

    def confirmed(self, fresh: list[tuple[str, bytes]]) -> bool:
        """The library, too, gives these pieces of text these ids. Behind a line feed no space mark is put before a text."""
        lead = [self.bytes.get(10, -1)] if "\n" not in self.ids else None
        if not self.dummy or lead is None:
            theirs = self.library.encode([s for s, _ in fresh], num_threads=1) if not self.dummy else [list(array("i", x)) for _, x in fresh]
            return all(array("i", x).tolist() == t for (_, x), t in zip(fresh, theirs, strict=True))
        theirs = self.library.encode(["\n" + s for s, _ in fresh], num_threads=1)
        skip = self.library.encode("\n")
        return all(skip + array("i", x).tolist() == t for (_, x), t in zip(fresh, theirs, strict=True))

    def check_rows(self, texts: list[str | None], ids: list[list[int]], end: bool) -> None:
        """Whole rows against the library, one in CHECKED and a batch's first at least; a difference fails the task."""
        for i in range(0, len(texts), CHECKED):
            want = self.library.encode(texts[i] or "", add_eos=end)
            if want != ids[i]:
                raise RuntimeError(f"the library gives other ids for the text that begins {(texts[i] or '')[:80]!r}")

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        return array("i", self.packed([text], end)[0][0]).tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces gathered as UTF-8 (a bad byte gives U+FFFD), the leading mark dropped."""
        whole = "".join(map(self.plain.__getitem__, ids))
        if "\0" not in whole:
            first = next((i for i in ids if i not in self.silent), None)
            return whole[1:] if self.dummy and first not in self.byte_of and whole.startswith(" ") else whole
        out, raw, first = [], bytearray(), True

        def flush() -> None:
            if raw:
                out.append(bytes(raw).decode("utf-8", "replace"))
                raw.clear()

        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                first = False
                continue
            flush()
            if i in self.silent:
                continue
            p = " ⁇ " if i == self.unk else self.pieces[i].replace(SPACE, " ")
            if first and self.dummy and i != self.unk and p.startswith(" "):
                p = p[1:]
            first = False
            out.append(p)
        flush()
        return "".join(out)


@cache
def loaded(model: str) -> PieceBpe:
    """One per Python worker, so that what is remembered outlives a task."""
    return PieceBpe(model)


def encode_decode(df: DataFrame, model: str, text: str = "text", end: bool = True) -> DataFrame:
    """df with columns ids array<int>, decoded string, and agrees boolean (so does the library, for the row's batch of newly merged pieces and its decoded text).

    Columns of df with those names are replaced. The model path must be readable on every executor.
    """
    rest = [c for c in df.columns if c not in ("ids", "decoded", "agrees")]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())])
    place = rest.index(text)

    def run(batches):
        bpe = loaded(model)
        for whole in batches:
            for batch in batches_of(whole, place, 2 << 20):
                packed, agrees = bpe.packed(batch.column(place).to_pylist(), end)
                flat = np.frombuffer(b"".join(packed), "<i4")
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                ids = [x.tolist() for x in np.split(flat, offsets[1:-1])]
                decoded = [bpe.decode(x) for x in ids]
                bpe.check_rows(batch.column(place).to_pylist(), ids, end)
                ok = [agrees and a == b for a, b in zip(decoded, bpe.library.decode(ids), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string()), pa.array(ok)], names=[f.name for f in schema])

    return df.select(*rest).mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees of encode_decode's rows."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
