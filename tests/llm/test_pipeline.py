"""The whole pipeline on a small corpus, stage by stage against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dnsketch.llm.common import Scratch
from dnsketch.llm import langid, linededup, toxicity
from dnsketch.llm.queries import tokenizer_path

WORDS = {"en": "the of and to in is that for with was on as by it at from river stone paper window".split(), "de": "der die und das nicht ein ist von mit sich auf für den dem im Fluss stein papier fenster".lower().split()}
BAD = ["vile", "scumbag", "horridful"]


def prose(lang, n, r):
    out = []
    while len(out) < n:
        k = r.randint(6, 14)
        s = [r.choice(WORDS[lang]) + str(r.randrange(40)) * (r.random() < 0.5) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    d = str(tmp_path_factory.mktemp("corpus"))
    passage = prose("en", 70, r)
    rows, labels = [], []
    for i in range(240):
        lang = "de" if i % 3 == 0 else "en"
        t, toxic = prose(lang, r.randint(40, 120), r), i % 8 == 1
        if toxic:
            w = t.split(" ")
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(BAD)
            t = " ".join(w)
        if i % 20 == 2:
            t = t + " " + passage
        rows.append((i, t, lang, f"s{i % 4}", len(t)))
        labels.append((i, 1, int(toxic)))
    for i in range(240, 270):  # exact and near copies
        t = rows[(i - 240) * 3 + 2][1]
        w = t.split(" ")
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), rows[(i - 240) * 3 + 2][2], "copy", 5))
    rows += [(270, None, "en", "x", None), (271, "", "en", "x", 0), (272, "12 34 .. !!", None, "x", 11), (273, "Hi.", "en", None, 3), (None, rows[5][1], "en", "x", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def key(rows):
    return sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows)


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(str(tmp_path / name))
        before = [tuple(r) for r in docs.collect()]
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, after)

    before, after = seen["language"]
    known = langid.Classifier(langid.learn(spark.read.parquet(f"{corpus}/documents.parquet"), ~langid.held_out(), Scratch(spark)))
    letters = lambda t: len(re.sub(r"[\W\d_]", "", t or ""))
    plain = [r for r in before if not (p := known.predict(r[1]))[2] or (p[0] != "und" and letters(r[1]) < 100)]
    assert key(after) == key(plain) and {270, 271, 272} & {r[0] for r in after} == set() and len(after) >= len(before) - 6

    before, after = seen["toxicity"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    toxic = {i for i in range(240) if i % 8 == 1}
    copies = {i for i in range(240, 270) if ((i - 240) * 3 + 2) % 8 == 1}
    assert len(toxic - gone) <= 2 and len(gone - toxic - copies) <= 2
    model = toxicity.train(spark.createDataFrame(before, spark.read.parquet(f"{corpus}/documents.parquet").schema), spark.read.parquet(f"{corpus}/labels.parquet"), Scratch(spark))
    assert key(after) == key([r for r in before if not model.above(model.vector(r[1])).sum() >= toxicity.SEVERE])

    before, after = seen["near duplicates"]

    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode())
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    s = {r[0]: shingles(r[1]) for r in before if r[0] is not None}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] & s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert key(after) == key([r for r in before if r[0] is None or find(r[0]) == r[0]]) and len(after) < len(before)

    before, after = seen["repeated passages"]
    first = {}
    cut = {}
    units = {r[0]: [(lo, hi, n, " ".join(r[1][lo:hi].lower().split())) for lo, hi, n in linededup.units(r[1] or "")] for r in before}
    order = sorted(units, key=lambda i: (i is None, i))
    for i in order:
        runs = []
        for k, (lo, hi, n, u) in enumerate(units[i]):
            if first.setdefault(u, (i, lo)) != (i, lo):
                runs.append({"k": k, "lo": lo, "hi": hi, "words": n, "of": 0})
        cut[i] = runs
    want = []
    for r in before:
        t = r[1]
        for lo, hi, _ in reversed(linededup.spans(cut[r[0]], t)):
            t = t[:lo] + t[hi:]
        want.append((r[0], t.rstrip() if t != r[1] else t))
    assert key(after) == key(want) and sum(a != b for a, b in zip(key(before), key(after), strict=True)) >= 3

    before, after = seen["packing"]
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    names = docs.columns
    by = defaultdict(list)
    for r in docs.collect():
        by[r["sequence_id"]].append(r)
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r["length"] for v in by.values() for r in v) == total and len(by) == -(-total // 2048) and "doc_tokens" in names
    assert np.all([sum(r["length"] for r in v) <= 2048 for v in by.values()])


def test_run_is_the_stages_in_turn(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 150
