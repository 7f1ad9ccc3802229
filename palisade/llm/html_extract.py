"""Main text of web pages: article blocks by structure, the rest by a host suffix array.

A tolerant scanner cuts a page into blocks and drops menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, by element, role and class (an
article's own class only tells whether it is a reader's comment on another one).  End tags may
be left out: an element ends where HTML lets it, and with what is around it.  Blocks inside
an article (or main) element are the page's text.

A page without one has only loose blocks, and nothing in its markup tells its text from its
template.  Those pages go by host: their token streams are concatenated (each page ends in a
token of its own), suffixes are sorted by prefix doubling, and substrings of ``LONG`` tokens
or more that stand on ``PAGES`` distinct pages or more are boilerplate; covered tokens go and
the unique runs stay.  Sorting ends at ``LONG`` tokens, as longer ones cover nothing more: each
of their windows of ``LONG`` tokens stands on as many pages.  A host's pages are dealt by hash into shards of about ``SHARD`` pages,
so a host with a third of all pages is many tasks.  Each shard counts the pages of its own
substrings, Spark adds the counts up over the host by a 64-bit hash, and every shard drops
what the whole host repeats, so the result doesn't depend on the shards.

White space inside a block becomes one space, blocks are joined by one newline, character
references are decoded.  Defined results: null, empty and text-free pages give an empty
string; an unclosed element ends with the one around it, and an unclosed form drops nothing;
rows with equal html are one page of their host, whatever their ids, so copies of a page make
no boilerplate of it; null and equal page_ids on different html are different pages; a null
url is a host of its own; very long pages are read whole; empty tables give none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernel import WORD_BASE, Words, mix, slices
from palisade.session import materialise

LONG = 8
PAGES = 3
SHARD = 2000

ARTICLE = {"article", "main"}
DROPPED = {
    "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object",
    "button", "select", "textarea", "dialog", "menu", "head", "title", "audio", "video", "map",
}
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img", "br",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words of a class or id that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies"
    r"|disqus|footer|gdpr|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|notice|notices|paywall|popup|promo|promoted|promotion|recommended"
    r"|related|respond|share|sharing|sidebar|sidebars|signup|social|sponsor|sponsored|subscribe|toolbar|widget|widgets)(?:$|[\s_-])"
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
CELLS, PARTS = {"td", "th"}, {"tbody", "thead", "tfoot", "caption", "colgroup"}
#: Elements whose end tag may be left out, and the start tags that end them.
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": CELLS | {"tr"} | PARTS, "th": CELLS | {"tr"} | PARTS, "tr": {"tr"} | PARTS, **{part: PARTS for part in PARTS}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"},
}
ENDERS = set().union(*ENDED_BY.values())
#: What may stand in a head; anything else begins the body.
IN_HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}
#: A page's comments are often articles of their own inside the article.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|respond)(?:$|[\s_-])")


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("body", "html"):
        return False
    marks = MARKS if name not in ARTICLE else COMMENT if in_article else None
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and marks is not None and marks.search(value):
            return True
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "hidden" and value in ("", "hidden", "true"):
            return True
    return False


#: What becomes of an element's text: it stays, it goes unless its form turns out to have no end, it goes.
STAYS, IN_FORM, GOES = range(3)
#: How deep elements are told apart.
DEPTH = 512


class _Open:
    """An open element."""

    __slots__ = ("name", "state", "article", "mark")

    def __init__(self, name: str, state: int, article: bool, mark: int):
        self.name, self.state, self.article, self.mark = name, state, article, mark


def page_blocks(page: str) -> list[tuple[bool, str]]:
    """(in an article, text) of each block that is not dropped, in page order."""
    out: list[tuple[bool, str]] = []
    lost: list[tuple[int, bool, str]] = []  # blocks in open forms, with their place in ``out``
    parts: list[str] = []
    stack = [_Open("", STAYS, False, 0)]
    block = stack[0]  # the element that the open block's text stands in

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text and block.state == STAYS:
                out.append((block.article, text))
            elif text:
                lost.append((len(out), block.article, text))

    def close(to: int, ended: bool) -> None:
        """Close open elements down to a place of the stack; ``ended``: the lowest by its end tag."""
        while len(stack) > to:
            element = stack.pop()
            if element.name == "form" and element.state == IN_FORM and stack[-1].state == STAYS:
                if not (ended and len(stack) == to):
                    # A form that never ends is a few fields in the text, not all that follows.
                    for place, article, text in reversed(lost[element.mark :]):
                        out.insert(place, (article, text))
                del lost[element.mark :]

    def imply_ends(name: str) -> None:
        """Close what a start tag ends without an end tag."""
        if name not in IN_HEAD and (head := next((i for i, e in enumerate(stack[:3]) if e.name == "head"), 0)):
            close(head, False)
        if name not in ENDERS:
            return
        at = len(stack) - 1
        while at > 0:
            here = stack[at].name
            if name in ENDED_BY.get(here, ()):
                flush()
                close(at, False)
            elif here in CELLS or here in BLOCKS and here != "p":
                return
            at -= 1

    raw_end = at = 0
    for m in TAG.finditer(page):
        if m.start() < raw_end:
            continue
        if m.start() > at and stack[-1].state != GOES:
            parts.append(page[at : m.start()])
            block = stack[-1]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        empty = name in VOID or attributes.endswith("/")
        if name in RAW and not closing and not empty:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = raw_end = end.end() if end else len(page)
            if name not in INLINE:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            # Only its own end tag, or the body's, ends an article.
            fence = name not in ARTICLE and name not in ("body", "html")
            found = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    found = i
                    break
                if fence and stack[i].name in ARTICLE:
                    break
            if name not in INLINE:
                flush()
                if found:
                    close(found, True)
            elif found and all(e.name in INLINE for e in stack[found:]):
                close(found, True)
            continue
        imply_ends(name)
        if name not in INLINE:
            flush()
        if empty:
            continue
        top = stack[-1]
        unwanted = _unwanted(name, attributes, top.article)
        if name in ARTICLE and not unwanted and top.state == GOES:
            menu = next(i for i, e in enumerate(stack) if e.state == GOES)
            if stack[menu].name in ("nav", "header", "footer"):  # a menu that was never closed
                close(menu, False)
                top = stack[-1]
        state = top.state
        if name in ARTICLE and state == IN_FORM:
            state = STAYS  # a form around the whole page
        if unwanted:
            state = IN_FORM if name == "form" and state != GOES else GOES
        if len(stack) > DEPTH and state == top.state and name not in ARTICLE:
            continue  # as browsers do: what is nested deeper stands side by side
        stack.append(_Open(name, state, top.article or name in ARTICLE, len(lost)))
    if at < len(page) and stack[-1].state != GOES:
        parts.append(page[at:])
        block = stack[-1]
    flush()
    close(1, False)
    return out


def substrings(pages: list[list[int]], long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pages' concatenated tokens: the rank of the substring of ``long`` tokens at each place, how many pages hold each rank, and the pages' sizes."""
    sizes = np.array([len(p) for p in pages], np.int64)
    n = int(sizes.sum()) + len(pages)
    tokens, owner = np.empty(n, np.int64), np.repeat(np.arange(len(pages)), sizes + 1)
    at = 0
    for i, p in enumerate(pages):
        tokens[at : at + len(p)] = p
        tokens[at + len(p)] = -1 - i  # ends the page: no substring runs over it twice
        at += len(p) + 1
    # Suffix ranks by prefix doubling, as deep as ``long`` tokens: equal ranks, equal first tokens.
    _, rank = np.unique(tokens, return_inverse=True)
    depth = 1
    while depth < long:
        step = min(depth, long - depth)
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank * np.int64(n + 2) + after + 1, return_inverse=True)
        depth += step
    order = np.lexsort((owner, rank))  # the suffix array, pages in order among equals
    r, o = rank[order], owner[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (o[1:] != o[:-1])]) if n else np.zeros(0, bool)
    return rank, np.bincount(r[new], minlength=int(rank.max(initial=-1)) + 1), sizes


def cover(repeated: np.ndarray, sizes: np.ndarray, long: int = LONG) -> list[np.ndarray]:
    """For each page's tokens, which are covered by a substring at a place that is marked as repeated."""
    n = len(repeated)
    start = np.flatnonzero(repeated)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, np.minimum(start + long, n), -1)
    covered = np.cumsum(delta[:-1]) > 0
    bounds = np.cumsum(sizes + 1)
    return [covered[b - s - 1 : b - 1] for b, s in zip(bounds.tolist(), sizes.tolist())]


def repeated_tokens(pages: list[list[int]], long: int = LONG, least: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, which are covered by a substring of ``long`` tokens that ``least`` distinct pages hold."""
    rank, held, sizes = substrings(pages, long)
    return cover(held[rank] >= least, sizes, long)


def _chosen(names: list) -> tuple[list[int], list[int]]:
    """The first page of each name, for every page and once each."""
    first: dict = {}
    distinct = [first.setdefault(name, i) for i, name in enumerate(names)]
    return distinct, sorted(set(distinct))


def _streams(blocks: list[list[str]]) -> tuple[list[list[int]], list[str]]:
    ids: dict[str, int] = {}
    return [[ids.setdefault(w, len(ids)) for block in page for w in block.split(" ")] for page in blocks], list(ids)


def _windows(blocks: list[list[str]], names: list, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct substrings of ``long`` tokens and how many pages hold each; the place in them of each token's substring (-1: none), and sizes."""
    streams, words = _streams(blocks)
    _, chosen = _chosen(names)
    rank, held, sizes = substrings([streams[i] for i in chosen], long)
    named = Words(pa.array(words, pa.large_string()), np.ones(256, bool)).hashes if words else np.zeros(0, np.uint64)
    tokens = np.concatenate([np.array([*streams[i], -1], np.int64) for i in chosen])
    end = np.flatnonzero(tokens < 0)  # of each page
    whole = np.arange(len(tokens)) + long <= np.repeat(end, sizes + 1)
    _, at = np.unique(rank, return_index=True)  # one place of each rank, in order of rank
    at, held = at[whole[at]], held[whole[at]]
    h = np.zeros(len(at), np.uint64)
    for i in range(long):
        h = mix(h * np.uint64(WORD_BASE) + named[tokens[at + i]])
    of_rank = np.full(int(rank.max()) + 1, -1)
    of_rank[rank[at]] = np.arange(len(at))
    return h, held, np.where(whole, of_rank[rank], -1), sizes


def unique_runs(blocks: list[list[str]], long: int = LONG, least: int = PAGES, names: list | None = None, repeated: np.ndarray | None = None) -> list[str]:
    """The text of pages of one host that is no boilerplate.  Pages of one name are the same page, and count once.

    ``repeated``: hashes of what the host repeats, where the pages are but a shard of it.
    """
    names = list(range(len(blocks))) if names is None else names
    streams, _ = _streams(blocks)
    distinct, chosen = _chosen(names)
    if repeated is None:
        gone = repeated_tokens([streams[i] for i in chosen], long, least)
    else:
        h, _, which, sizes = _windows(blocks, names, long)
        gone = cover(np.append(np.isin(h, repeated), False)[which], sizes, long)
    covered = dict(zip(chosen, gone))
    out = []
    for i, page in enumerate(blocks):
        gone = covered[distinct[i]]
        kept, at = [], 0
        for block in page:
            words = block.split(" ")
            left = [w for w, g in zip(words, gone[at : at + len(words)].tolist()) if not g]
            at += len(words)
            if left:
                kept.append(" ".join(left))
        out.append("\n".join(kept))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", long: int = LONG, least: int = PAGES, shard: int = SHARD) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.selectExpr(f"`{html_col}` AS html", f"`{id_col}` AS page_id", f"`{url_col}` AS url")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts, loose, digests = [], [], []
            for page in part.column(0).to_pylist():
                found = page_blocks(page) if page else []
                inside = [t for a, t in found if a]
                texts.append("\n".join(inside) if inside or not found else None)
                loose.append(None if inside or not found else [t for _, t in found])
                digests.append(None if inside or not found else hashlib.sha256(page.encode()).digest()[:16])
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), pa.array(texts, pa.string()), pa.array(loose, pa.list_(pa.string())), pa.array(digests, pa.binary())],
                names=["page_id", "url", "text", "loose", "digest"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = materialise(rows.mapInArrow(parse, f"page_id {kind}, url string, text string, loose array<string>, digest binary"), "pages")
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    open_pages = parsed.where("text IS NULL").withColumn("host", host)
    # Pages are told apart by their html alone: ids may be null or repeated, and copies of a page are one page.
    distinct = open_pages.groupBy("host", "digest").agg(F.first("loose").alias("loose"))
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("m")).select(F.col("host").alias("h"), F.ceil(F.col("m") / shard).alias("shards"))
    dealt = distinct.join(sizes, F.col("host") == F.col("h")).withColumn("shard", F.expr("pmod(xxhash64(digest), shards)"))

    def count(table: pa.Table) -> pa.Table:
        """What a shard of a host repeats or holds once, with how many of its pages do."""
        h, held, _, _ = _windows(table.column("loose").to_pylist(), table.column("digest").to_pylist(), long)
        n = len(h)
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * n, pa.string()), "shard": pa.array(np.full(n, table.column("shard")[0].as_py()), pa.int64()),
                         "window": pa.array(h.view(np.int64)), "held": pa.array(held, pa.int64())})

    def clean_shard(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"host": table.column("host"), "digest": table.column("digest"), "text": pa.array([], pa.string())})
        repeated = found.column("window").to_numpy().view(np.uint64)
        texts = unique_runs(table.column("loose").to_pylist(), long, least, table.column("digest").to_pylist(), repeated)
        return table.select(["host", "digest"]).append_column("text", pa.array(texts, pa.string()))

    def clean(table: pa.Table) -> pa.Table:
        texts = unique_runs(table.column("loose").to_pylist(), long, least, table.column("digest").to_pylist())
        return table.select(["host", "digest"]).append_column("text", pa.array(texts, pa.string()))

    out, deal = "host string, digest binary, text string", ["digest", "loose", "host", "shard"]
    cleaned = dealt.where("shards = 1").select(*deal).groupBy("host", "shard").applyInArrow(clean, out)
    large = dealt.where("shards > 1").select(*deal)
    windows = materialise(large.groupBy("host", "shard").applyInArrow(count, "host string, shard long, window long, held long"), "windows")
    repeated = windows.groupBy("host", "window").agg(F.sum("held").alias("pages")).where(F.col("pages") >= least).select("host", "window")
    mine = windows.join(repeated, ["host", "window"]).select("host", "shard", "window")
    cleaned = cleaned.unionByName(large.groupBy("host", "shard").cogroup(mine.groupBy("host", "shard")).applyInArrow(clean_shard, out))
    cleaned = open_pages.select("page_id", "url", "host", "digest").join(cleaned, ["host", "digest"]).select("page_id", "url", "text")
    whole = parsed.where("text IS NOT NULL").select("page_id", "url", "text").unionByName(cleaned)
    return whole.withColumn("n_chars", F.length("text").cast("long"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
