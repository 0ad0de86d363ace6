"""Operator 9: main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags (name, class and id, with the path they stand under) and its texts. Over the pages of one
host, tokens with the same occurrence vector (how often they are on each page) form an equivalence class; vectors are
compared by a sum of hashes of (page, count), so they are grouped by an ordinary aggregation however many pages a host
has. Copies of a page (same host and html) are one page here. A class is part of the host's template if it is on enough
of its pages and has a start tag: a text whose occurrences follow no tag's is data, on however many pages it is. A class
is valid on a page if its tokens come there in one order, each round of them inside one gap of the classes around it,
and one of its elements at least is closed; tags are taken as they are written, without repair. Texts of valid classes
go, unless an element around them is never closed in order (elements whose end tag HTML leaves out are); what stands in
the slots between template tags is data, and all of it that is not chrome by name is the main text, inside an article
element and outside. Elements that are never main text by their meaning
(head, script, style, nav, header, footer, aside, form, ...; adverts, notices, sidebars and comments by a whole class, id
or role) are closed slots even if a page is the only one of its host. No name closes html, body, main, article or an
element that holds the page's article or, on a page without one, most of its text; inside an article fewer names do.

Defined results: a null or empty html gives an empty text. Character references are decoded, white space within a block
is one space, blocks are joined by a line feed in page order. Hosts with fewer than PAGES pages have no template texts;
a null or odd url is a host of its own (the empty one). Rows repeat as they come; further columns stay, and those named as results are
replaced.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsketch.llm.common import Scratch, batches_of

PAGES = 4  # pages a host needs for a template
VECTOR = 1 << 44  # occurrence vectors are compared modulo this
SHARE = 0.5  # of a host's pages that have a template's class
BROADCAST = 32 << 20  # bytes of template texts that may be sent to every executor; beyond, a join

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*\Z", re.S)
MARK = re.compile(r"([a-zA-Z_:@-][\w:.@-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACES = re.compile(r"\s+")
# Element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED = frozenset("head script style noscript template iframe noframes nav header footer aside menu dialog button select option input textarea svg canvas object embed audio video title xmp".split())
# an item ends where the next begins, unless one of these lists is nearer
ITEMS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
# elements that may end without an end tag
OPTIONAL = frozenset("html head body p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption rb rp rt rtc".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
# Classes, ids and roles that name chrome, as a whole; those of OUTSIDE do so only outside articles
CHROME = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions cookie cookies consent gdpr popup modal newsletter subscribe sidebar nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus share sharing social login signup complementary contentinfo hidden".split()
)
OUTSIDE = frozenset("banner notice notices alert alerts side menu menus header replies reply respond related recommended widget search skip".split())
NEVER = frozenset("html body main article".split())  # never chrome by name
ARTICLE = frozenset(("article", "main"))


TAG, TEXT, NUMBER, END = range(4)  # kinds of tokens; NUMBER is that of a host's pages


NOTHING = ("", 0, False, False, False, -1)  # around the first element


def key_of(above: int, label: str) -> int:
    """A path or a text under a path as a number: that of what is above it, hashed with its own label."""
    return xxhash.xxh3_64_intdigest(above.to_bytes(8, "little") + label.encode("utf-8", "surrogatepass")) >> 1


class Nest:
    """Open elements; the innermost of a name is found at once, however deep they nest."""

    def __init__(self):
        self.items: list[tuple] = []  # the name comes first
        self.where: dict[str, list[int]] = {}

    def push(self, item: tuple) -> None:
        self.where.setdefault(item[0], []).append(len(self.items))
        self.items.append(item)

    def cut(self, k: int) -> list[tuple]:
        """Closes the elements from the k-th on."""
        gone = self.items[k:]
        del self.items[k:]
        for x in gone:
            self.where[x[0]].pop()
        return gone

    def innermost(self, name: str) -> int:
        at = self.where.get(name)
        return at[-1] if at else -1


class Page:
    """One page as blocks of text, each with the element it stands in, and the tags around them.

    Time and memory are in proportion to the page, also where elements are never closed.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[int, int, int]] = []  # kind, key and element in page order: tags as written, and texts
        self.blocks: list[tuple[str, bool, int]] = []  # text, closed, element
        self.above: list[int] = []  # the element around each element, as tags are written
        self.whole: list[bool] = []  # whether it is closed in order
        self.named: list[int] = []  # the element around each block that is chrome by name, or -1
        self.around: dict[int, int] = {}  # such an element -> the next one around it, or -1
        self.hold: set[int] = set()  # those of them that hold an article
        self.forms: set[int] = set()  # those of them that are forms
        self.has_article = False  # outside them
        self.read(source)
        self.decide()

    def read(self, s: str) -> None:
        stack = Nest()  # name, path, whether it or anything above it is closed, an article, a block, and the chrome by name around it
        inner_blocks: list[int] = []  # places of blocks in the stack
        text: list[str] = []
        raw = Nest()  # name, path and number of the elements that no tag has closed
        tokens, find, token = self.tokens, s.find, TOKEN.match

        def top() -> tuple:
            return stack.items[-1] if stack.items else NOTHING

        def flush() -> None:
            if text:
                t = "".join(text)
                text.clear()
                if "&" in t:
                    t = html.unescape(t)
                t = " ".join(t.split())
                if t:
                    _, path, closed, article, _, named = top()
                    tokens.append((TEXT, key_of(path, "\0" + t), len(self.blocks)))
                    self.named.append(named)
                    self.has_article |= article and not closed and named < 0
                    self.blocks.append((t, closed, raw.items[-1][2] if raw.items else -1))

        def shut(k: int) -> None:
            stack.cut(k)
            while inner_blocks and inner_blocks[-1] >= k:
                inner_blocks.pop()

        def ended(name: str) -> None:  # an end tag as written
            k = raw.innermost(name)
            if k < 0:
                tokens.append((END, key_of(0, name), -1))
                return
            first, *rest = raw.cut(k)
            tokens.append((END, first[1], first[2]))
            unclosed(rest)

        def unclosed(items: list[tuple]) -> None:
            for name, _, i in items:
                if name not in OPTIONAL:
                    self.whole[i] = False

        def left_out(name: str) -> None:  # the end tag of an element that may go without
            k = len(raw.items) - 1
            while k >= 0 and raw.items[k][0] in OPTIONAL and raw.items[k][0] != name:
                k -= 1
            if k >= 0 and raw.items[k][0] == name:
                raw.cut(k)

        at, n, end_of_tags, last_start = 0, len(s), s.rfind(">"), s.rfind("<")
        while at < n:
            i = find("<", at)
            m = token(s, i) if i >= 0 else None
            while m is None and i >= 0:  # no tag: a plain sign
                i = find("<", i + 1) if i < end_of_tags else last_start if last_start > i else -1  # behind the last > only the last < may begin one
                m = token(s, i) if i >= 0 else None
            if m is None:
                text.append(s[at:])
                break
            if i > at:
                text.append(s[at:i])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:  # an end tag
                k = stack.innermost(name)
                if k < 0:
                    ended(name)
                    continue
                inner = bool(inner_blocks) and inner_blocks[-1] >= k
                if inner or top()[2]:
                    flush()
                ended(name)
                if name in BLOCK or not inner:
                    shut(k)
                continue
            if name in VOID:
                if name == "br":
                    text.append(" ")
                elif name == "hr":
                    flush()
                continue
            block, closed, label, given, chrome = name in BLOCK, name in CLOSED, name, m[3], name == "form"
            in_article = top()[3]
            if name == "header" and in_article:  # an article's own heading
                closed = False
            if given and not given.isspace():
                marks = {x.lower(): (v or "").strip("\"'") for x, v in MARK.findall(given)}
                names = {x for k in ("class", "id", "role") for x in marks.get(k, "").lower().split()}
                closed = closed or "hidden" in marks or marks.get("aria-hidden") == "true"
                chrome = chrome or name not in NEVER and not (names.isdisjoint(CHROME) and (in_article or names.isdisjoint(OUTSIDE)))
                if marks.get("class"):
                    label += "." + ".".join(marks["class"].split())
                if marks.get("id"):
                    label += "#" + marks["id"]
            if block or closed or chrome:
                flush()
            if name in CLOSES_P and (k := stack.innermost("p")) >= 0:
                shut(k)
                left_out("p")
            if name in ITEMS and (k := stack.innermost(name)) >= 0 and k > max(stack.innermost(x) for x in ITEMS[name]):
                shut(k)
                left_out(name)
            above, number = top(), len(self.whole)
            path, named = key_of(above[1], label), above[5]
            if name in ARTICLE and not above[2] and named >= 0:
                self.hold.add(named)
            if chrome:
                self.around[number] = named
                named = number
                if name == "form":
                    self.forms.add(number)
            if block:
                inner_blocks.append(len(stack.items))
            stack.push((name, path, closed or above[2], in_article or name in ARTICLE, block, named))
            tokens.append((TAG, path, number))
            self.above.append(raw.items[-1][2] if raw.items else -1)
            raw.push((name, path, number))
            self.whole.append(True)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(s, at)
                at = end.end() if end else n
                if end:
                    ended(name)
                shut(len(stack.items) - 1)
            elif given and given.rstrip().endswith("/"):
                raw.cut(len(raw.items) - 1)
                shut(len(stack.items) - 1)
        flush()
        unclosed(raw.cut(0))

    def decide(self) -> None:
        """Closes blocks in chrome by name; on a page without an article elsewhere, not what holds one or, without any, most text.

        A form is open only if it holds an article.
        """
        if self.around:
            size = dict.fromkeys(self.around, 0)
            every = 0
            for (t, closed, _), named in zip(self.blocks, self.named, strict=True):
                if not closed:
                    every += len(t)
                    if named >= 0:
                        size[named] += len(t)
            for i in reversed(size):  # from the inside
                if (j := self.around[i]) >= 0:
                    size[j] += size[i]
                    if i in self.hold:
                        self.hold.add(j)
            opened = set() if self.has_article else self.hold or {i for i, n in size.items() if 2 * n > every} - self.forms
            shut = {-1: False}
            for i, j in self.around.items():  # from the outside
                shut[i] = shut[j] or i not in opened
            self.blocks = [(t, closed or shut[named], i) for (t, closed, i), named in zip(self.blocks, self.named, strict=True)]
        self.tokens = [x for x in self.tokens if x[0] != TEXT or not self.blocks[x[2]][1]]

    def sound(self) -> list[bool]:
        """Whether each element and all around it are closed in order."""
        out: list[bool] = []
        for whole, above in zip(self.whole, self.above, strict=True):
            out.append(whole and (above < 0 or out[above]))
        return out


def host_column(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _occurrences(copied: np.ndarray | None):
    """(host, kind, token, copy, vector, pages, n) summed over the pages of a partition.

    copied: the sorted hashes of pages that have copies, None if they are too many to send. Their rows carry the hash as
    copy, so that they count once for a host; the rows of all other pages have 0 and are added up here.
    """
    h64 = xxhash.xxh3_64_intdigest

    def run(batches):
        total: dict[tuple, list[int]] = {}

        def out():
            columns = list(zip(*total, strict=True))
            v = np.array([x[0] % VECTOR for x in total.values()], np.int64)
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(v), *[pa.array([x[i] for x in total.values()], pa.int64()) for i in (1, 2)]], names=["host", "kind", "token", "copy", "vector", "pages", "n"])

        for whole in batches:
            for batch in batches_of(whole, 1):
                for host, source, number in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    copy = 0
                    if copied is None or (len(copied) and copied[min(int(np.searchsorted(copied, number)), len(copied) - 1)] == number):
                        copy = number
                        if (host, NUMBER, 0, copy) in total:
                            continue
                    counts: dict[tuple[int, int], int] = {}
                    for kind, token, _ in Page(source or "").tokens:
                        counts[kind, token] = counts.get((kind, token), 0) + 1
                    counts[NUMBER, 0] = 1
                    for (kind, token), c in counts.items():
                        x = total.setdefault((host, kind, token, copy), [0, 0, 0])
                        if copy:
                            x[:] = h64(f"{number} {c}") % VECTOR, 1, c
                        else:
                            x[0] += h64(f"{number} {c}") % VECTOR
                            x[1] += 1
                            x[2] += c
                    if len(total) > 200_000:
                        yield out()
                        total.clear()
        if total:
            yield out()

    return run


def templates(pages: DataFrame, scratch: Scratch, url: str = "url", source: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """host, class_id (its occurrence vector), kind, token of every template token of every host.

    Only classes with a start tag on at least SHARE of a host's pages are kept, so a host's rows are bounded by the tokens of a page.
    """
    host = host_column(url)
    rows = pages.select(host.alias("host"), F.col(source).alias("html"), F.xxhash64(host, F.coalesce(F.col(source), F.lit(""))).alias("number"))
    copies = scratch.save(rows.groupBy("number").count().filter("count > 1").select("number"), "copies")
    copied = None
    if copies.count() * 8 <= broadcast:  # the bound of what is sent, checked
        copied = np.sort(np.array([r[0] for r in copies.toLocalIterator()], np.int64))
    got = rows.mapInArrow(_occurrences(copied), "host string, kind int, token long, copy long, vector long, pages long, n long")
    if copied is None or len(copied):  # a copy's row once; those of copy 0 added up
        each = [F.when(F.col("copy") == 0, F.sum(c)).otherwise(F.max(c)).alias(c) for c in ("vector", "pages", "n")]
        got = got.groupBy("host", "kind", "token", "copy").agg(*each)
    sums = scratch.save(got.groupBy("host", "kind", "token").agg((F.sum("vector") % VECTOR).alias("vector"), F.sum("pages").alias("pages"), F.sum("n").alias("n")), "sums")
    hosts = sums.filter(f"kind = {NUMBER}").select("host", F.col("pages").alias("of"))
    often = sums.filter(f"kind <> {NUMBER} and pages > 1").join(hosts, "host").filter((F.col("of") >= PAGES) & (F.col("pages") >= SHARE * F.col("of")))
    tags = F.sum((F.col("kind") == TAG).cast("int")).over(Window.partitionBy("host", "vector"))
    return often.withColumn("tags", tags).filter("tags > 0").select("host", F.col("vector").alias("class_id"), "kind", "token", "pages", "n", "of")


def _valid(page: Page, template: dict[tuple[int, int], int]) -> set[int]:
    """The classes that are valid on this page."""
    placed: list[tuple[int, tuple[int, int]]] = []  # class and token, in page order
    rounds: dict[int, list[tuple[int, int]]] = {}
    tagged: set[int] = set()
    for kind, token, i in page.tokens:
        c = template.get((kind, token))
        if c is None or (kind != TEXT and (i < 0 or not page.whole[i])):
            continue
        if kind == TAG:
            tagged.add(c)
        placed.append((c, (kind, token)))
        rounds.setdefault(c, []).append((kind, token))
    length: dict[int, int] = {}
    for c, seq in rounds.items():
        k = len(set(seq))
        if c in tagged and len(seq) % k == 0 and all(x == seq[i % k] for i, x in enumerate(seq)):
            length[c] = k
    open_: list[list[int]] = []  # class and tokens still to come of each round that is not over
    bad: set[int] = set()
    for c, _ in placed:
        if c not in length or c in bad:
            continue
        at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == c), -1)
        if at < 0:
            open_.append([c, length[c]])
            at = len(open_) - 1
        bad.update(x for x, _ in open_[at + 1 :])  # begun inside a gap of c and not over at its end
        del open_[at + 1 :]
        open_[at][1] -= 1
        if not open_[at][1]:
            open_.pop()
    return set(length) - bad


def main_text(source: str | None, template: dict[tuple[int, int], int] | None = None) -> str:
    """The text in the slots of a page; template: (kind, token) -> class."""
    page = Page(source or "")
    same: set[int] = set()  # blocks that are the template's
    if template:
        valid, sound = _valid(page, template), page.sound()
        for kind, token, i in page.tokens:
            if kind == TEXT and template.get((kind, token)) in valid and ((e := page.blocks[i][2]) < 0 or sound[e]):
                same.add(i)
    slots = [(t, i in same) for i, (t, closed, _) in enumerate(page.blocks) if not closed]
    main = [t for t, of_template in slots if not of_template]
    return "\n".join(main or [t for t, _ in slots])  # a page is not all template


class Templates:
    """The templates of all hosts in arrays, ENTRY bytes each and the hosts' names; one of them at a time as a dictionary."""

    ENTRY = 17

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("host")
        hosts = rows["host"].combine_chunks().dictionary_encode()  # in order of their first row
        starts = np.searchsorted(np.asarray(hosts.indices), np.arange(len(hosts.dictionary) + 1)).tolist()
        self.at = {h: (starts[i], starts[i + 1]) for i, h in enumerate(hosts.dictionary.to_pylist())}
        self.kind, self.token, self.class_id = (rows[c].to_numpy().astype(t) for c, t in (("kind", np.int8), ("token", np.int64), ("class_id", np.int64)))
        self.last: tuple[str | None, dict[tuple[int, int], int]] = (None, {})

    def of(self, host: str) -> dict[tuple[int, int], int]:
        if host != self.last[0]:
            lo, hi = self.at.get(host, (0, 0))
            keys = zip(self.kind[lo:hi].tolist(), self.token[lo:hi].tolist(), strict=True)
            self.last = host, dict(zip(keys, self.class_id[lo:hi].tolist(), strict=True))
        return self.last[1]


def extract(pages: DataFrame, scratch: Scratch, url: str = "url", source: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """pages with text string and n_chars long."""
    found = scratch.save(templates(pages, scratch, url, source, broadcast), "templates")
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names, s = [x.name for x in schema], rest.index(source)

    def done(batch, texts):
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
    if size[0] * Templates.ENTRY + size[1] <= broadcast:  # the bound of what is sent, checked
        sent = scratch.spark.sparkContext.broadcast(Templates(found.select("host", "kind", "token", "class_id").toArrow()))

        def run(batches):
            for whole in batches:
                for batch in batches_of(whole, s):
                    yield done(batch, [main_text(x, sent.value.of(y)) for x, y in zip(batch.column(s).to_pylist(), batch.column(len(rest)).to_pylist(), strict=True)])

        return pages.select(*rest, host_column(url).alias("_host")).mapInArrow(run, schema)

    of_host = found.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("kind", "token", "class_id")).alias("_template"))
    of_host = scratch.save(of_host, "of_host")

    def joined(batches):
        for whole in batches:
            for batch in batches_of(whole, s):
                t = [{(x["kind"], x["token"]): x["class_id"] for x in y or ()} for y in batch.column(len(rest)).to_pylist()]
                yield done(batch, [main_text(x, y) for x, y in zip(batch.column(s).to_pylist(), t, strict=True)])

    return pages.select(*rest, host_column(url).alias("_host")).join(of_host, "_host", "left").select(*rest, "_template").mapInArrow(joined, schema)
