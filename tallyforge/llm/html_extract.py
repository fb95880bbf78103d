"""HTML extraction by template deduction.

Pages of a host share a template. Its tokens are elements that hold others, each told apart by its path: the names (tag, class,
id and role, digits as one) of all elements around it, and among nameless siblings its number; and text nodes, by path and text. A token's occurrence
vector says how often it stands in each page; the sum of a hash of (page, count) over all pages stands for the vector, so
equal vectors have equal sums, and sums are built map-side and merged, however large a host is. Tokens of one host with
one vector are an equivalence class; a class is valid if it stands in at least a VALID share of the host's pages. Valid classes nest by the elements their
tokens stand in: all of a class that stands in one element of another class fills one of that one's slots. Texts in
valid classes are the template's own, the rest of the text fills the slots. In this tree the article's element is looked for: from the root, on to the
child class's element that holds at least DOMINANT of the slots' text, or at once to an <article> or <main> that does.
Extraction walks each page once and keeps what fills the slots of that element. An element that says the same in FIXED of its pages, while others in the article vary, is the template's own: its
text goes where it is the template's, and stays in a page where it is another. (A heading or a paragraph that always says the same stays: only elements that hold others are of the template.) Elements with
a word that may mark a menu, a notice or the like (``DOUBTFUL``) go if they are the template's own, and stay if what they hold varies, as slots do; the word alone decides where there is no template: an element of few
pages, or a host with less than ``FEW``. Forms, navigation, adverts, sidebars, footers and reader comments go by tag or word (``MARKS``), whatever they hold.

A host's template is bounded by what stands in most of its pages; what doesn't is filtered before anything is grouped by host.
Pages meet templates in a join on the host, which Spark broadcasts while templates are small and splits where one host is hot.

Defined cases: null html counts as empty, and an empty or text-free page gives an empty text; a page without a host, or
without the element that the others have, is read with <article>, <main>, or else the whole body; one page alone is its own template; broken
markup is read as far as it goes: an unclosed tag ends with its parent, a paragraph with the next block, an unknown end is dropped; a lone "<" is text.
Rows that repeat are extracted alike. Of elements with equal text the one of the smaller path hash is taken. Other columns than key, url and html are dropped, also where they are named as outputs.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: A class is valid if it stands in this share of a host's pages; the article's element holds this share of the slots' text.
VALID, DOMINANT = 0.5, 0.5
#: A text is the template's own in the article if it stands in this share of the pages that its element stands in, on a host with so many pages.
FIXED, FEW = 0.9, 3
#: Characters of html whose tokens are summed before they are handed on.
SLAB = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Elements that hold others; the rest only break blocks, or don't even that.
CONTAINERS = frozenset("html head body nav aside footer header form main article section div ul ol dl table thead tbody tr td th li dt dd blockquote figure figcaption dialog menu fieldset button select label details".split())
BLOCKS = CONTAINERS - {"label", "button", "select"} | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address summary option legend caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ITEMS = frozenset("li td tr th dt dd".split())
#: Elements, and words of class, id or role, that mark what isn't the article.
ASIDE = frozenset("head nav aside footer form dialog menu button select fieldset".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsored nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies newsletter comment comments disqus replies login toolbar".split()
)
#: Words that do so only for what the template repeats, or where there is none.
DOUBTFUL = frozenset(
    "sponsor promo promotion banner menu consent notice notices alert popup modal subscribe subscription discussion share sharing social related recommended".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")


def name_of(tag: str, attributes: str) -> tuple[str, frozenset[str]]:
    """An element's name, and the words of its class, id and role."""
    if "=" not in attributes:
        return tag, frozenset()
    found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()) for m in _ATTR.finditer(attributes)]
    words = frozenset(w for _, v in found for w in _SPLIT.split(v) if w)
    return " ".join([tag, *sorted(f"{k}={_DIGITS.sub('0', v)}" for k, v in found)]), words


class Element:
    """An open element: its path; whether it holds others, has a path of its own, is itself marked as not the article (by a word: 3, a doubtful one: 2, by its tag: 1), stands in such a one, and stands in the article's element."""

    __slots__ = ("tag", "path", "parent", "depth", "holds", "own", "mark", "out", "inside", "seen")

    def __init__(self, tag: str, path: int, parent: Element | None, depth: int, holds: bool, mark: int, inside: bool):
        self.tag, self.path, self.parent, self.depth, self.holds, self.mark, self.inside = tag, path, parent, depth, holds, mark, inside
        self.own = holds or mark == 2 or parent is not None and path != parent.path
        self.out = mark > 0 or parent is not None and parent.out
        self.seen: dict[str, int] = {}


def read(page: str, main: int | None = None, spared: frozenset[int] = frozenset(), wanted: str | None = None) -> Iterator[tuple[str, str, Element]]:
    """("open", name, element), ("text", text, its element) and ("break", "", element) in order; contents of scripts and the like are left out.

    The article's element is the one of path ``main``, or any ``wanted`` one ("": the page); ``spared`` are the paths around it, which marks don't rule out.
    """
    root = Element("", 0, None, 0, True, 0, wanted == "")
    stack, holders = [root], [root]  # all that is tracked; those that hold others

    def drop(tag: str, everywhere: bool) -> None:
        """Closes the last open element of this tag, and all in it; unless it is to be sought ``everywhere``, only in the last one that holds others."""
        for i in range(len(stack) - 1, 0 if everywhere else holders[-1].depth, -1):
            if stack[i].tag == tag:
                del stack[i:]
                while holders[-1].depth >= i:
                    holders.pop()
                return

    for m in _TOKEN.finditer(page):
        if (text := m[6]) is not None or (text := m[2]) is not None:
            yield "text", text, stack[-1]
            continue
        if (tag := m[4]) is None:
            continue
        tag = tag.lower()
        holds = tag in CONTAINERS
        if tag in BLOCKS:
            yield "break", "", stack[-1]
        if m[3]:
            drop(tag, holds)
            continue
        if tag in BLOCKS:
            drop("p", False)
            if tag in ITEMS and holders[-1].tag == tag:
                drop(tag, True)
        elif tag == "br":
            yield "text", " ", stack[-1]
        if tag in VOID:
            continue
        parent = stack[-1]
        name, words = name_of(tag, m[5])
        path = parent.path
        if holds:
            if name == tag:  # nameless siblings are numbered
                seen = holders[-1].seen
                seen[tag] = number = seen.get(tag, 0) + 1
                name = f"{tag} {number}" if number > 1 else tag
        doubtful = not words.isdisjoint(DOUBTFUL)
        if holds or doubtful:
            path = xxhash.xxh3_64_intdigest(f"{path}/{name}") >> 1
        is_main = holds and not parent.out and (path == main or tag == wanted)
        if is_main or tag in ("html", "body"):
            mark = 0
        elif words & MARKS and path not in spared:
            mark = 3
        elif doubtful and path not in spared:
            mark = 2
        else:
            mark = int(tag in ASIDE or tag == "header" and (not parent.inside or wanted == ""))
        if holds or doubtful or mark or parent.out or tag == "p":
            inside = parent.inside or is_main or main is None and wanted is None and tag in ("article", "main")
            element = Element(tag, path, parent, len(stack), holds, mark, inside)
            stack.append(element)
            if holds:
                holders.append(element)
            if element.own:
                yield "open", name, element


def tokens(page: str) -> tuple[dict[int, list], dict[tuple[int, int], int]]:
    """By path: count, characters of text in it (but for what is in a marked part of it), the path around it, name and mark; and the characters of each text at each path."""
    found: dict[int, list] = {0: [1, 0, -1, "", 0]}
    texts: dict[tuple[int, int], int] = {}
    for kind, value, element in read(page):
        if kind == "open":
            if (x := found.get(element.path)) is None:
                x = found[element.path] = [0, 0, element.parent.path, value, element.mark]
            x[0] += 1
        elif kind == "text" and (size := len(value.strip())):
            at = element
            while not at.own and not at.mark:
                at = at.parent
            if not at.own:  # a marked paragraph or stretch of one
                continue
            key = element.path, xxhash.xxh3_64_intdigest(value.strip()) >> 1
            texts[key] = texts.get(key, 0) + size
            while at is not None:
                if at.own:
                    found[at.path][1] += size
                at = None if at.mark else at.parent
    return found, texts


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """host, path, text (a hash, null for elements), vector, pages, total, chars, around, name, mark: sums over all pages of (host, key, html)."""
    names = ["host", "path", "text", "vector", "pages", "total", "chars", "around", "name", "mark"]
    kinds = [pa.string(), *[pa.int64()] * 7, pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts, SLAB):
                sums: dict[tuple, list] = {}
                for host, key, page in zip(hosts[a:b], keys[a:b], texts[a:b], strict=True):
                    if not host:
                        continue
                    elements, said = tokens(page or "")
                    for path, (count, chars, around, name, mark) in elements.items():
                        x = sums.setdefault((host, path, None), [0, 0, 0, 0, around, name, mark])
                        x[0] += xxhash.xxh3_64_intdigest(f"{key},{count}") >> 24
                        x[1] += 1
                        x[2] += count
                        x[3] += chars
                    for (path, text), chars in said.items():
                        x = sums.setdefault((host, path, text), [0, 0, 0, 0, None, None, None])
                        x[1] += 1
                        x[3] += chars
                rows = [(*k, *x) for k, x in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=True)], names)

    parts = pages.mapInArrow(run, "host string, path long, text long, vector long, pages long, total long, chars long, around long, name string, mark int")
    vector = F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector")  # however many pages there are
    return parts.groupBy("host", "path", "text").agg(vector, *(F.sum(c).alias(c) for c in ("pages", "total", "chars")), *(F.min(c).alias(c) for c in ("around", "name", "mark")))


def classes_of(nodes: list[dict]) -> dict[int, int]:
    """The class of each path: equal vectors, in one slot of the class around them; the smallest path names a class."""
    by_path, out = {n["path"]: n for n in nodes}, {}

    def place(n: dict) -> tuple:
        """The vector, and the nearest element around that has another one."""
        at = by_path.get(n["around"])
        while at is not None and at["vector"] == n["vector"]:
            at = by_path.get(at["around"])
        return n["vector"], -1 if at is None else at["path"]

    first: dict[tuple, int] = {}
    for n in sorted(nodes, key=lambda n: n["path"]):
        out[n["path"]] = first.setdefault(place(n), n["path"])
    return out


def article(nodes: list[dict]) -> tuple[int | None, list[int]]:
    """The path of the article's element among the template's (path, around, name, mark, vector, slots, varies), and the paths that marks don't rule out: those around it, and doubtful ones that vary."""
    by_path = {n["path"]: n for n in nodes}
    held = sum(n["slots"] for n in nodes if n["mark"] or n["path"] == 0)
    varying = {n["path"] for n in nodes if n["mark"] == 2 and n["varies"]}
    spared = varying | {n["path"] for n in nodes if n["mark"] >= 2 and n["slots"] > DOMINANT * held}  # a word marks a wrapper of it all
    for p in spared:  # then what is in it counts around it too
        at = by_path.get(by_path[p]["around"])
        while at is not None:
            at["slots"] += by_path[p]["slots"]
            at = None if at["mark"] else by_path.get(at["around"])
    below: dict[int, list[dict]] = {}
    for n in nodes:
        if n["path"] and n["around"] in by_path and n["name"].split(" ")[0] in CONTAINERS and (not n["mark"] or n["path"] in spared):
            below.setdefault(n["around"], []).append(n)
    total = by_path[0]["slots"] if 0 in by_path else 0
    reached, todo = [], [0]
    while todo:
        at = todo.pop()
        reached.append(at)
        todo += [n["path"] for n in below.get(at, ())]
    best = max(((n["slots"], t == "article", -n["path"]) for p in reached if (n := by_path.get(p)) and (t := n["name"].split(" ")[0]) in ("article", "main") and n["slots"] >= DOMINANT * total > 0), default=None)
    member = classes_of(nodes)
    if best is not None:
        main = -best[2]
    else:
        main = 0
        while children := below.get(main):
            # the elements of one class in one slot go together: several of them are no single place for the article
            child = max(children, key=lambda n: (n["slots"], -n["path"]))
            if child["slots"] == 0 or child["slots"] < DOMINANT * total or any(n is not child and n["slots"] * 2 > child["slots"] and member[n["path"]] == member[child["path"]] for n in children):
                break
            main = child["path"]
    around, at = [], by_path.get(main, {}).get("around", -1)
    while at in by_path and at:
        around.append(at)
        at = by_path[at]["around"]
    return main or None, sorted({*around, *varying})


def templates(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """host, main (the path of the article's element), spared (paths that marks don't rule out), fixed (path and text of what is the template's own in elements that say nothing else)."""
    hosts = scratch.table(vectors.where("path = 0 AND text IS NULL").select("host", F.col("pages").alias("all")))
    valid = vectors.join(hosts, "host").where(F.col("pages") >= VALID * F.col("all"))
    own = valid.where("text IS NOT NULL AND pages > 1").groupBy("host", "path").agg(F.sum("chars").alias("own"), F.collect_list(F.struct("text", "chars", "pages")).alias("texts"))
    nodes = valid.where("text IS NULL").join(own, ["host", "path"], "left").select(
        "host", "path", "around", "name", "mark", F.concat_ws(",", F.col("vector").cast("string"), F.col("pages").cast("string"), F.col("total").cast("string")).alias("vector"), "chars", "pages", "all",
        F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("texts", F.array().cast("array<struct<text: long, chars: long, pages: long>>")).alias("texts"),
    )

    def deduce(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf.drop(columns="host").to_dict("records")
        by_path = {n["path"]: n for n in nodes}

        def all_around(n: dict) -> Iterator[dict]:
            """The element and those that its text counts for."""
            while n is not None:
                yield n
                n = None if n["mark"] else by_path.get(n["around"])

        for n in nodes:
            n["slots"], n["fixed"] = n["chars"], 0
            n["texts"] = [t for t in n["texts"] if t["pages"] >= FIXED * n["pages"]]
            n["same"] = sum(t["chars"] for t in n["texts"])
        for n in nodes:
            for at in all_around(n) if n["own"] else ():  # the template's own texts don't fill slots
                at["slots"] -= n["own"]
                at["fixed"] += n["same"]
        few = bool(pdf["all"].iloc[0] < FEW)
        for n in nodes:
            n["varies"] = not few and n["chars"] > 0 and n["fixed"] < FIXED * n["chars"]
        same = all(n["slots"] <= 0 for n in nodes)  # all pages say the same
        for n in nodes if same else ():
            n["slots"] = n["chars"]
        main, spared = article(nodes)
        inside = by_path.get(main or 0)
        fixed = [(n["path"], int(t["text"])) for n in nodes if n["path"] not in (0, main) and not n["mark"] and n["chars"] > 0 and not n["varies"] for t in n["texts"]]
        if few or same or inside is None or not inside["varies"]:  # without slots nothing tells what fills them
            fixed = []
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "main": pd.array([main], dtype="Int64"), "spared": [spared], "fixed": [[{"path": p, "text": t} for p, t in fixed]]})

    return nodes.groupBy("host").applyInPandas(deduce, "host string, main long, spared array<long>, fixed array<struct<path: long, text: long>>")


def extract(page: str, main: int | None, spared: frozenset[int], fixed: frozenset[tuple[int, int]] = frozenset()) -> str:
    """What fills the article's element, block by block, without the texts that are ``fixed`` at a path."""
    places = {p for p, _ in fixed}
    for path, tag in dict.fromkeys(((main, None), (None, "article"), (None, "main"), (None, ""))):
        if path is None and (tag is None or tag and f"<{tag}" not in page.lower()):
            continue
        blocks: list[str] = []
        now: list[str] = []
        found = tag == ""
        for kind, value, element in read(page, path, spared if path is not None else frozenset(), tag):
            if kind == "text":
                if element.inside and not element.out and not (element.path in places and (element.path, xxhash.xxh3_64_intdigest(value.strip()) >> 1) in fixed):
                    now.append(value)
            elif kind == "open":
                found = found or element.inside and not element.out
            elif now:
                blocks.append(" ".join(_html.unescape("".join(now)).split()))
                now.clear()
        if now:
            blocks.append(" ".join(_html.unescape("".join(now)).split()))
        if found:
            return "\n".join(filter(None, blocks))
    return ""


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text of every row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "pages")
    source = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), F.coalesce(F.col(html), F.lit("")).alias("__html"), host_of(F.col(url)).alias("host"))
    vectors = occurrence_vectors(source.select("host", F.concat_ws(",", F.col("__key").cast("string"), "__url").alias("key"), "__html"))
    found = scratch.table(templates(scratch.table(vectors), scratch))
    kind = dict(source.dtypes)["__key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, main, spared, fixed = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            for a, b in slices(page):
                out = [extract(p, m, frozenset(s or ()), frozenset((x["path"], x["text"]) for x in f or ())) for p, m, s, f in zip(page[a:b], main[a:b], spared[a:b], fixed[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.string())], [key, url, "text"])

    return source.join(found, "host", "left").select("__key", "__url", "__html", "main", "spared", "fixed").mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string")
