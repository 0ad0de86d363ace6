"""Operators 1, 2, 3, 8, 9 and 10 on small tables, against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dnsketch.llm import langid, linededup, packing, piece_bpe, template, toxicity
from dnsketch.llm.common import Scratch, bounded, words_of
from dnsketch.llm.queries import tokenizer_path

ODD = [None, "", " ", "  two  spaces ", "a\n\nb", "日本語 𐍈 ▁x \t\r\n", "<s> </s> <|endoftext|>", "a\u0000b", "x" * 3000, "word " * 2000, "same", "same", "É. é, ×. A.B. c.. d., It's 5."]


def table(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.PieceBpe(tokenizer_path("piece_bpe_32k.model"))


def test_pieces_are_the_librarys(spark, bpe):
    bounded(spark)
    df = table(spark, ODD, ids=["own"] * len(ODD)).withColumn("decoded", F.lit(1))
    got = {r["doc_id"]: r for r in piece_bpe.encode_decode(df, tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(ODD):
        want = bpe.library.encode(t or "", add_eos=True)
        assert got[i]["ids"] == want and got[i]["decoded"] == bpe.library.decode(want) and got[i]["agrees"]
    d = {r["doc_id"]: r for r in piece_bpe.digests(piece_bpe.encode_decode(df, tokenizer_path("piece_bpe_32k.model"))).collect()}
    assert d[0]["n_tokens"] == 1 and d[0]["ids_sha256"] == hashlib.sha256(b"2").hexdigest() and d[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert piece_bpe.encode_decode(df.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_a_row_that_differs_from_the_library_fails(bpe):
    ids = bpe.library.encode("plain words", add_eos=True)
    bpe.check_rows(["plain words"], [ids], True)
    with pytest.raises(RuntimeError, match="plain words"):
        bpe.check_rows(["plain words"], [ids[1:]], True)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text_has_the_librarys_pieces(bpe, text):
    text = text.encode("utf-8", "ignore").decode()
    want = bpe.library.encode(text, add_eos=True)
    assert bpe.encode(text) == want and bpe.decode(want) == bpe.library.decode(want)


@given(st.text(alphabet="ab c\n", max_size=80))
@settings(max_examples=60, deadline=None)
def test_list_and_heap_agree(bpe, text):
    assert bpe.scanned(text) == [s for s in bpe.heaped(text) if s]


WORDS = {"en": "the of and to in is that for with was on as by it at from".split(), "de": "der die und das nicht ein ist von mit sich auf für den dem im".split()}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_languages(spark):
    langs = [("en", "de")[i % 2] for i in range(120)]
    df = table(spark, [prose(x, 40, i) for i, x in enumerate(langs)], lang=langs)
    known = langid.learn(df, ~langid.held_out(), Scratch(spark))
    assert set(known) == {"en", "de"}
    got = langid.identify(df.select("doc_id", "text"), known).join(df.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() == 120 and got.filter("score < 0 or score > 1").count() == 0
    odd = table(spark, [*ODD, "12 34 !?", prose("de", 30, 1).upper()], score=["x"] * (len(ODD) + 2))
    r = {x["doc_id"]: x for x in langid.identify(odd, known).collect()}
    assert [r[i]["lang_pred"] for i in (0, 1, 2, len(ODD))] == ["und"] * 4 and r[len(ODD) + 1]["lang_pred"] == "de"
    kept = langid.keep_identified(odd, known)
    assert kept.columns == odd.columns and {0, 1, 2, len(ODD)} & {x["doc_id"] for x in kept.collect()} == set() and kept.filter("score = 'x'").count() == kept.count()
    assert langid.learn(df.limit(0), F.lit(True), Scratch(spark)) == {}
    assert {x["lang_pred"] for x in langid.identify(odd, {}).collect()} == {"und"}


def test_a_rare_language_is_learned_beside_low_hashes_of_another(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 2)
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    low = [r[0] for r in spark.range(2_000_000).filter(h < 20).collect()]
    high = [r[0] for r in spark.range(100).filter(h > 1000).limit(3).collect()]
    rows = [(i, prose("en", 20, i), "en") for i in low] + [(i, prose("de", 20, i), "de") for i in high]
    assert len(low) > 12 and set(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), Scratch(spark))) == {"en", "de"}


def test_predictions_are_those_of_plain_compression(spark):
    """Dictionaries from the chosen documents in order, and the smallest sum of block sizes, in plain Python."""
    import zstandard

    r = random.Random(12)
    langs = [("en", "de", "fr")[i % 3] for i in range(90)]
    WORDS["fr"] = "le la et les des en un une est que dans pour au avec sur".split()
    texts = [prose(x, r.randint(10, 900), i) for i, x in enumerate(langs)]
    texts[4] = prose("fr", 60, 1)  # a wrong label
    df = table(spark, texts, lang=langs)
    known = langid.learn(df, ~langid.held_out(), Scratch(spark))
    h = {x["doc_id"]: x["h"] for x in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h")).collect()}
    train = [i for i in range(90) if zlib.crc32(str(i).encode()) % 4 != 2]
    parts = {x: list(dict.fromkeys(langid.plain(texts[i])[: langid.EXCERPT] for i in sorted(train, key=lambda i: (h[i], i)) if langs[i] == x)) for x in ("en", "de", "fr")}

    def size(d, b):
        lvl = langid.SHORT_LEVEL if len(b) <= langid.SHORT else langid.LEVEL
        c = zstandard.ZstdCompressor(level=lvl, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(b[i : i + langid.BLOCK])) for i in range(0, len(b), langid.BLOCK))

    def judged(x, k, b):
        half = {y: b" ".join(p[1 - k % 2 :: 2])[: langid.DICTIONARY] for y, p in parts.items()}
        return min(half, key=lambda y: size(half[y], b)) == x

    plain = {x: b" ".join(b for k, b in enumerate(p) if judged(x, k, b))[: langid.DICTIONARY] for x, p in parts.items()}
    assert known == plain and langid.plain(texts[4])[:80] not in known[langs[4]]
    got = {x["doc_id"]: x for x in langid.identify(df.select("doc_id", "text"), known).collect()}
    for i, t in enumerate(texts):
        sizes = sorted((size(d, langid.plain(t)), k, x) for k, (x, d) in enumerate(known.items()))
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert got[i]["lang_pred"] == sizes[0][2] and abs(got[i]["score"] - min(1, margin / langid.FULL)) < 0.1


def test_held_out_is_the_remainder_of_crc32(spark):
    got = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_learning_sees_no_held_out_text(spark):
    df = table(spark, [prose("en", 20, i) + f" secret{i}" for i in range(60)], lang=["en"] * 60)
    body = langid.learn(df, ~langid.held_out(), Scratch(spark))["en"].decode()
    for i in range(60):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            assert prose("en", 20, i)[:60] not in body


def test_toxicity(spark):
    r = random.Random(2)
    texts, bad = [], []
    for i in range(300):
        w = [r.choice(WORDS["en"]) for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(r.randint(1, 6) if toxic else 0):
            w[r.randrange(40)] = r.choice(["vile", "scumbag", "horridful"])
        texts.append(" ".join(w))
        bad.append(toxic)
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(texts[i].count("vile") < 2), int(b)) for i, b in enumerate(bad[:200])] + [(None, 1, 1), (6, 1, None), (99999, 1, 1), (7, None, 0), (7, 0, 0), (10, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, Scratch(spark))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {x["doc_id"]: x for x in toxicity.grade(docs, model).collect()}
    assert sum(got[i]["rejected"] == b for i, b in enumerate(bad)) >= 290 and all(0 <= x["severity"] <= toxicity.GRADES for x in got.values())
    many = toxicity.grade(table(spark, ["the vile scumbag horridful vile scumbag", "the vile of", None, ""]), model).orderBy("doc_id").collect()
    assert many[0]["severity"] > many[1]["severity"] > many[2]["severity"] == many[3]["severity"]
    clash = docs.withColumn("grade", F.lit("own"))
    kept = toxicity.keep_clean(clash, model)
    assert kept.columns == clash.columns and kept.filter("grade = 'own'").count() == kept.count() >= 230
    none = toxicity.train(docs, labels.limit(0), Scratch(spark))
    assert toxicity.grade(docs, none).filter("rejected or severity > 0").count() == 0


@pytest.fixture(scope="module")
def words_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


STRINGS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|endoftext|"]


def test_ordinal_likelihood_and_fit():
    r = np.random.default_rng(4)
    n, f = 400, 6
    x = (r.random((n, f)) < 0.4) * r.random((n, f))
    grade = (x @ np.array([3, 2, 0, -2, 1, 4]) + r.logistic(size=n) > np.array([[1.0], [2.5]])).sum(0)
    row, col = np.nonzero(x)
    h = toxicity.Hits(row, col, x[row, col], grade, f)

    def plain(w, p):
        theta, total = [p[0], p[0] + np.exp(p[1])], 0.0
        for i in range(n):
            above = [1.0, *(1 / (1 + np.exp(t - x[i] @ w)) for t in theta), 0.0]
            total -= np.log(above[grade[i]] - above[grade[i] + 1])
        return total / n + 0.01 / 2 * (w @ w)

    w, p = r.normal(size=f), np.array([0.3, -0.5])
    value, g, gp = toxicity.loss(h, w, p, 0.01)
    assert abs(value - plain(w, p)) < 1e-9
    for k in range(f + 2):
        d = np.zeros(f + 2)
        d[k] = 1e-6
        slope = (plain(w + d[:f], p + d[f:]) - plain(w - d[:f], p - d[f:])) / 2e-6
        assert abs(slope - np.concatenate([g, gp])[k]) < 1e-6
    z = np.zeros(f + 2)
    for _ in range(4000):  # plain descent
        _, g, gp = toxicity.loss(h, z[:f], z[f:], 0.01)
        z -= 0.5 * np.concatenate([g, gp])
    fw, ft = toxicity.fitted(h, ridge=0.01)
    fp = np.array([ft[0], np.log(ft[1] - ft[0])])
    assert toxicity.loss(h, fw, fp, 0.01)[0] < toxicity.loss(h, z[:f], z[f:], 0.01)[0] + 1e-3


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t.,aZé…×5'", max_size=20), st.lists(st.one_of(st.sampled_from(STRINGS), st.text(alphabet=" .a<|É", max_size=4)), max_size=6).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_word_tokenizer_is_the_librarys(words_library, texts):
    t = packing.loaded(tokenizer_path("word_bpe_49k.json"), 1)
    got = [np.frombuffer(x, "<u4").tolist() for x in t.packed(pa.array(texts, pa.string()))]
    assert got == [words_library.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    words, counts = words_of(pa.array(texts, pa.string()), lower=True)
    assert [w.decode() for w in words.to_pylist()] == [w for x in texts for w in "".join(c.lower() if c.isascii() else c for c in x or "").split()]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_patterns_hold_every_piece(h):
    p = packing.shortest_pack_first(h, 64)
    n = Counter()
    for x in p:
        assert sum(x.lengths) <= 64 and x.count > 0
        for k in x.lengths:
            n[k] += x.count
    assert n == Counter(h)


def test_packing(spark, words_library):
    bounded(spark)
    docs = table(spark, [*ODD, *(prose("en", n, n) for n in range(1, 400, 7))]).withColumn("start", F.lit("clash"))
    parts = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), length=256, with_ids=True)
    rows = packing.pack(parts, Scratch(spark), 256).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] == len(r["ids"]) // 4
    for d in docs.collect():
        ids = b"".join(r["ids"] for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]))
        assert np.frombuffer(ids, "<u4").tolist() == words_library.encode(d["text"] or "", add_special_tokens=False).ids + [1]
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    used = sum(r["length"] for r in rows)
    assert used / (256 * len(by_seq)) > 0.9 and sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer_path("word_bpe_49k.json")), Scratch(spark)).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li>Home</li><li>{i}</li></ul></nav><!-- x --><div class="ad">Buy {i}</div>{main}<div class="comments"><p>I like {i}</p></div><aside>Side</aside><form><p>Name</p></form><footer>&copy; all</footer></body></html>'


def test_pages(spark):
    bounded(spark)
    main = ["<article><h1>Head {i}</h1><p><b>One &amp; two\n {i}<br><p>Three&nbsp;é</article>".format(i=i) for i in range(6)]
    rows = [(i, f"http://host.example/{i}", PAGE.format(i=i, main=m)) for i, m in enumerate(main)]
    rows += [(100, None, None), (101, "odd", ""), (102, "http://one.example/", "<p>a</p>plain <i>text</i><p>b &lt; c"), (103, "http://one.example/x", "<article>cut &am"), (3, rows[3][1], rows[3][2])]
    rows += [(200 + i, f"https://two.example/{i}", f"<body><div class=banner>x</div><div>Same text on all pages</div><div>Story {i} goes here</div></body>") for i in range(5)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    want = {i: f"Head {i}\nOne & two {i}\nThree é" for i in range(6)} | {100: "", 101: "", 102: "a\nplain text\nb < c", 103: "cut &am"} | {200 + i: f"Story {i} goes here" for i in range(5)}
    for limit in (template.BROADCAST, 0):
        out = template.extract(df, Scratch(spark), broadcast=limit).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r["page_id"], r["text"], r["n_chars"]) == (r["page_id"], want[r["page_id"]], len(want[r["page_id"]]))


def extracted(spark, pages):
    df = spark.createDataFrame(pages, "url string, html string")
    return {(r["url"], r["html"]): r["text"] for r in template.extract(df, Scratch(spark)).collect()}


def test_copies_of_a_page_keep_their_body(spark):
    body = "<body><div>Notice of all</div><table><tr><td>Body of the copied page</td></tr></table></body>"
    pages = [(f"http://copies.example/{i}", body) for i in range(6)]
    pages += [(f"http://copies.example/o{i}", f"<body><div>Notice of all</div><p>Own {i}</p><p>And {i}</p></body>") for i in range(5)]
    got = extracted(spark, pages)
    assert {got[p] for p in pages[:6]} == {"Body of the copied page"} and got[pages[6]] == "Own 0\nAnd 0"


def test_a_text_that_follows_no_tag_is_data(spark):
    pages = [(f"http://often.example/{i}", f"<body><div>Notice of all</div><p>{'Shared quote' if i < 6 else 'Other'} </p><p>Own {i}</p></body>") for i in range(8)]
    assert extracted(spark, pages)[pages[0]] == "Shared quote\nOwn 0"


def path(labels):
    at = 0
    for x in labels.split("/"):
        at = template.key_of(at, x)
    return at


def test_misplaced_tags_make_no_template():
    classes = {(kind, path(x)): c for x, c in (("body", 1), ("body/i", 2), ("body/i/u", 2)) for kind in (template.TAG, template.END)}
    for html, valid in (("<body><i><u>a</u></i></body>", {1, 2}), ("<body><i><u>a</i></u></body>", {1, 2}), ("<body><i><u>a</u></i><i></i><u></u></body>", {1})):
        assert template._valid(template.Page(html), classes) == valid, html
    assert template.Page("<i><u>a</i></u>").whole == [True, False]


def test_a_plain_deduction_gives_the_same_texts(spark):
    """Occurrence vectors as tuples over all pages of a host, classes as sets, everything in memory."""
    r = random.Random(9)
    pages = []
    for h in range(4):
        lines = [f"Line {h} {k}" for k in range(12)]
        for i in range((3, 9, 14, 6)[h]):
            body = [f"<div>{x}</div>" for x in lines if r.random() < (1, 1, 0.6, 0.9)[h]] + [f"<p>Own {h} {i} {k}</p>" for k in range(r.randint(1, 4))]
            r.shuffle(body)
            html = "<body><span>Top</span><article><b>Read on</b>" + "".join(body) + "<i>More</i></article>" + "</div>" * (r.random() < 0.2) + "<u>End</u></body>"
            pages += [(f"http://h{h}.example/{i}", html)] * r.choice((1, 1, 1, 3))
    got = extracted(spark, pages)
    changed = 0
    for h in range(4):
        own = sorted({x for u, x in pages if f"//h{h}." in u})
        counts = [Counter((k, t) for k, t, _ in template.Page(x).tokens) for x in own]
        classes = {}
        for token in set().union(*counts):
            v = tuple(c[token] for c in counts)
            on = sum(map(bool, v))
            if len(own) >= template.PAGES and on > 1 and on >= template.SHARE * len(own):
                classes.setdefault(v, set()).add(token)
        deduced = {t: n for n, c in enumerate(classes.values()) if any(k == template.TAG for k, _ in c) for t in c}
        for u, x in pages:
            if f"//h{h}." in u:
                assert got[u, x] == template.main_text(x, deduced)
                changed += got[u, x] != template.main_text(x)
    assert changed > 10


def test_tags_that_are_never_closed_take_time_in_proportion():
    import time
    import tracemalloc

    took = {}
    for n in (30_000, 240_000):
        for one in ("<b>x", "<div class=ad>x", "<p><i>x"):
            start = time.perf_counter()
            page = template.Page(one * n)
            took[n, one] = time.perf_counter() - start
            assert len(page.whole) == n * (1 + (one[1] == "p"))
    assert all(took[240_000, x] < 30 * took[30_000, x] + 1 for _, x in took)
    tracemalloc.start()
    template.main_text("<b>x" * 250_000)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_the_template_counts_inside_articles_and_text_outside_stays(spark):
    pages = [(f"http://parts.example/{i}", f"<body><div>Lead {i}</div><article><p>Own {i}</p><div>Read more</div></article><div>Tail {i}</div></body>") for i in range(5)]
    assert extracted(spark, pages)[pages[2]] == "Lead 2\nOwn 2\nTail 2"


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body class="has-sidebar"><p>a</p></body>', "a"),
        ('<form id="aspnetForm"><div>Menu</div><article>a</article><input value="x"></form>', "Menu\na"),
        ('<div id="social-history"><p>a</p></div>', "a"),
        ('<body class="page has-sidebar"><main class="search-results"><p>a</p></main></body>', "a"),
        ('<body><article class="side-story"><p>a</p></article><form><p>Name</p></form></body>', "a"),
        ('<body class="single comments"><p>a</p></body>', "a"),
        ('<body><article class="post no-comments"><p>a</p></article></body>', "a"),
        ('<body><div class="side"><article>a</article></div></body>', "a"),
        ('<body><article>a</article><div class="comments"><article>I like it</article></div></body>', "a"),
        ('<body><div class="widget"><p>all of a page</p></div><p>b</p></body>', "all of a page\nb"),
        ('<body><article><div class="entry-header"><h1>a</h1></div><p class="notice">b</p><div class="related-work">c</div></article></body>', "a\nb\nc"),
        ('<body><article><p>a</p><div class="x ad">buy</div></article><div class="comments">a long comment of all</div><div class="notice">n</div></body>', "a"),
    ],
)
def test_chrome_by_name(html, text):
    assert template.main_text(html) == text


PASSAGE = "It was a passage of many words that somebody wrote once. Then others took all of it as it stood. They put it into texts of their own without a mark. So it came to be in many places at the same time and nobody knew."


def test_repeated_passages(spark):
    own = [prose("en", 30, i).capitalize() + "." for i in range(8)]
    texts = [PASSAGE, f"{own[0]} {PASSAGE} {own[1]}", f"{own[2]}\n{PASSAGE}\n{own[3]}", own[4], "Short line here.\n" + own[5], "Short line here.\n" + own[6], None, "", own[7] + "\n" + own[7]]
    df = table(spark, texts).withColumn("removed", F.lit(3)).withColumn("d", F.lit("x"))
    got = {r["doc_id"]: r for r in linededup.without_repeats(df, Scratch(spark)).collect()}
    assert got[0]["text"] == PASSAGE and got[1]["text"] == f"{own[0]} {own[1]}" and got[2]["text"] == f"{own[2]}\n{own[3]}"
    assert [got[i]["text"] for i in (3, 4, 5, 6, 7)] == texts[3:8] and got[8]["text"] == own[7]
    assert [s["kept_in"] for i in (1, 2, 8) for s in got[i]["removed"]] == [[0], [0], [8]]
    for i, r in got.items():
        if r["removed"]:
            t = texts[i]
            assert all(t[s["start"] : s["end"]].strip() in (PASSAGE, own[7]) for s in r["removed"])
    assert linededup.without_repeats(df.limit(0), Scratch(spark)).count() == 0
    twice = df.union(df)  # the same id and text: one document
    again = linededup.without_repeats(twice, Scratch(spark)).collect()
    assert len(again) == 2 * len(texts) and all(r["text"] == got[r["doc_id"]]["text"] for r in again)
    assert linededup.without_repeats(table(spark, [PASSAGE, PASSAGE]).withColumn("doc_id", F.when(F.col("doc_id") == 1, 1)), Scratch(spark)).filter("doc_id is null and text = ''").count() == 1


HEAD = "The head that all of these files have in front of their own lines."
FOOT = "And the foot that all of these files have behind their own lines."


def kept(spark, *texts):
    return [r["text"] for r in linededup.without_repeats(table(spark, texts), Scratch(spark)).orderBy("doc_id").collect()]


def test_own_short_lines_between_repeats_stay(spark):
    lists = ["\n".join(f"{a}{i}\t{i * 7}" for i in range(500)) for a in "xyz"]
    texts = [f"{HEAD}\n{x}\n{FOOT}" for x in lists] + [f"{HEAD} {FOOT}", f"{HEAD} Oh. {FOOT}"]
    got = kept(spark, *texts)
    assert got[:3] == texts[:3] and got[4] == texts[4]
    # of a run whose units all repeat, no word is lost from the table
    assert set(" ".join(got).split()) == set(" ".join(texts).split())


def test_repeated_short_lines_go(spark):
    verse = "\n".join(f"the {x} of\n{x[::-1]}" for x in "moon sun star sea hill wood road rain wind fire snow leaf stone".split())
    assert kept(spark, verse, f"Own line here now.\n{verse}\nYes.") == [verse, "Own line here now.\nYes."]


def test_passages_without_spaces_go(spark):
    r = random.Random(5)
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(n))
    paragraph = "".join(han(r.randint(8, 30)) + "。" for _ in range(10))[:191] + "。"
    own = [han(20) + "。" for _ in range(4)]
    assert kept(spark, paragraph, f"{own[0]}\n{paragraph}\n{own[1]}", f"{own[2]}{paragraph}{own[3]}") == [paragraph, f"{own[0]}\n{own[1]}", own[2] + own[3]]


def test_short_repeats_are_listed_and_the_largest_id_is_no_null(spark):
    big = 2**63 - 1
    line = "A line of some twenty words that is in each of these texts and yet is too short to go by itself."
    df = spark.createDataFrame([(big, PASSAGE), (None, PASSAGE + "\nOwn none."), (4, f"{line}\nOwn four."), (5, f"Own five.\n{line}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.without_repeats(df, Scratch(spark)).collect()}
    assert got[big]["text"] == PASSAGE and got[None]["text"] == "Own none." and got[None]["removed"][0]["kept_in"] == [big]
    assert [(s["start"], s["end"], s["kept_in"]) for s in got[5]["repeated"]] == [(10, 10 + len(line), [4])] and not got[4]["repeated"]
    every = {r["doc_id"]: r["text"] for r in linededup.without_repeats(df, Scratch(spark), least=1).collect()}
    assert every == {big: PASSAGE, None: "Own none.", 4: f"{line}\nOwn four.", 5: "Own five."}


def test_words_between_any_white_space_count(spark):
    for space in ("\t", "\u00a0"):
        assert kept(spark, PASSAGE.replace(" ", space), PASSAGE.replace(" ", space) + "\nOwn.") == [PASSAGE.replace(" ", space), "Own."]
    assert [n for _, _, n in linededup.units("one\ttwo\u00a0three  four\n" + "字" * 45 + "\n" + "a" * 45)] == [4, 22, 4]


def test_repeats_travel_packed_and_are_those_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BUCKET", 60, raising=False)  # several buckets, whose answers meet in each slice
    r = random.Random(8)
    lines = [prose("en", r.randint(1, 14), i).capitalize() + "." for i in range(70)]
    rows = [(r.choice([None, i, i, i, i // 2]), r.choice(["\n", " "]).join(r.choices(lines, k=r.randint(1, 40)))) for i in range(120)]
    rows += [rows[3], rows[4], (None, None), (7, ""), (8, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    hashes = {x["text"]: x["h"] for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    places = {}
    for i, t in {x for x in rows if x[1]}:
        for (lo, _, _), parts in zip(found := linededup.units(t), linededup.hashed(t, found), strict=True):
            for part in parts:
                places.setdefault(part, set()).add((i is None, i or 0, hashes[t], lo))
    want = []
    for i, t in rows:
        found, runs = linededup.units(t or ""), []
        for k, ((lo, hi, n), parts) in enumerate(zip(found, linededup.hashed(t or "", found), strict=True)):
            for part in parts:
                if (first := min(places[part])) != (i is None, i or 0, hashes[t], lo):
                    runs.append({"k": k, "lo": lo, "hi": hi, "words": n, "of": None if first[0] else first[1]})
        every = linededup.all_spans(runs, t)
        gone, stay = ([(lo, hi, of) for lo, hi, of, n in every if (n >= linededup.RUN) == long] for long in (True, False))
        left = t
        for lo, hi, _ in reversed(gone):
            left = left[:lo] + left[hi:]
        want.append((i, left.rstrip() if gone else t, gone, stay))
    written = []

    class Counted(Scratch):
        def save(self, df, name):
            written.append((out := super().save(df, name)).count())
            return out

    got = [(x["doc_id"], x["text"], *([tuple(s) for s in x[c]] for c in ("removed", "repeated"))) for x in linededup.without_repeats(df, Counted(spark)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(bool(x[2]) for x in want) > 50 and any(x[3] for x in want)
    assert written and max(written) <= len(rows)  # no table has a row for each unit


def test_buckets_compare_whole_digests():
    """Digests that agree in one half are others; the earliest place answers, nulls last."""
    key = lambda *k: np.array([k], linededup.KEY)
    a = np.concatenate([key(5, 1, 9, 0, 0, False), key(5, 2, 9, 0, 4, False), key(6, 0, 0, 3, 8, True)])
    b = np.concatenate([key(5, 2, 4, 0, 7, False), key(5, 3, 4, 0, 1, False), key(6, 0, 2**63 - 1, 0, 2, False)])
    got = linededup._answered(pa.table({"b": [0, 0], "s": ["a", "b"], "at": pa.array([10, 20], pa.int32()), "keys": [a.tobytes(), b.tobytes()]}))
    assert got["s"].to_pylist() == ["a"] and np.frombuffer(got["replies"][0].as_py(), linededup.REPLY).tolist() == [(11, 4, False), (12, 2**63 - 1, False)]
