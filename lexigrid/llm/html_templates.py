"""Text of web pages without their site's template: subtrees that recur across a host's pages are deleted."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import saved, small_batches

#: A subtree is template if so many distinct URLs of its host hold it, and so large a share of them.
MIN_PAGES = 10
MIN_SHARE = 0.002
#: Subtrees with less visible text recur by chance; they go only as parts of larger ones.
MIN_CHARS = 16
#: Template hashes that are broadcast at most (8 bytes each); above, they are joined to the pages.
BROADCAST_HASHES = 4_000_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template svg iframe".split())
_HIDDEN = frozenset("head script style noscript template svg iframe textarea title".split())
_BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends the open elements named here, up to the nearest that isn't.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Node:
    __slots__ = ("name", "attrs", "parts", "hash", "chars")

    def __init__(self, name: str, attrs: str) -> None:
        self.name, self.attrs, self.parts, self.hash, self.chars = name, attrs, [], 0, 0


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, and of comments and declarations with an empty name. Send the place
    to go on from, or nothing. Time is linear: what isn't found once isn't looked for again."""
    at, n = 0, len(page)
    quotes = True  # whether > within quotes is passed over; not any more once that found no end
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(mark, start + 4)
            at = n if end < 0 else end + len(mark)
            yield start, at, "", False, ""
            continue
        if page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", False, ""
            continue
        closing = page[at : at + 1] == "/"
        name = _NAME.match(page, at + closing)
        if not name:
            continue
        end = name.end()
        while quotes:
            m = _QUOTE_OR_END.search(page, end)
            if not m:
                quotes = False
            elif m[0] == ">":
                end = m.start()
                break
            elif (other := page.find(m[0], m.end())) < 0:
                quotes = False
            else:
                end = other + 1
        else:
            end = page.find(">", name.end())
            if end < 0:  # nor does any later tag end
                return
        at = end + 1
        at = (yield start, at, name[0].lower(), closing, page[name.end() : end]) or at


def parse(page: str) -> Node:
    """The page's tree; unclosed and misplaced tags are mended roughly as browsers do. No recursion, and time in proportion to
    the page: any depth and length is fine. A tag that nothing ends is text, as is all behind it."""
    root = Node("#page", "")
    stack, at, n = [root], 0, len(page)
    open_: Counter[str] = Counter()
    tokens, go = _tokens(page), None

    def text(a: int, b: int) -> None:
        if b > a and (t := page[a:b]).strip():
            stack[-1].parts.append(t)
        elif b > a:
            stack[-1].parts.append(" ")

    def close() -> str:
        name = stack.pop().name
        open_[name] -= 1
        return name

    while True:
        try:
            start, end, name, closing, attrs = tokens.send(go)
        except StopIteration:
            break
        go = None
        text(at, start)
        at = end
        if not name:
            continue
        if closing:
            if open_[name]:
                while close() != name:
                    pass
            continue
        if name in _ENDS_P and stack[-1].name == "p":
            close()
        if ends := _ENDS.get(name):
            while len(stack) > 1 and stack[-1].name in ends:
                close()
        node = Node(name, _SPACE.sub(" ", attrs.strip().rstrip("/")))
        stack[-1].parts.append(node)
        if name in _VOID or attrs.endswith("/"):
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            node.parts.append(page[at : stop.start() if stop else n])
            at = go = stop.end() if stop else n
            continue
        stack.append(node)
        open_[name] += 1
    text(at, n)
    return root


def _ordered(root: Node) -> list[Node]:
    """Every node, children after their parents."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in node.parts if not isinstance(p, str)]
    return out


def hashed(page: str, host: str) -> Node:
    """The tree, each node with a hash of host, name, attributes and content, and its number of visible characters."""
    root = parse(page)
    for node in reversed(_ordered(root)):
        h = xxhash.xxh64(f"{host}\0{node.name}\0{node.attrs}".encode("utf-8", "replace"))
        hidden = node.name in _HIDDEN
        for p in node.parts:
            if isinstance(p, str):
                t = _SPACE.sub(" ", p).strip()
                if t:
                    h.update(b"\1" + t.encode("utf-8", "replace"))
                    node.chars += 0 if hidden else len(t)
            else:
                h.update(b"\2" + p.hash.to_bytes(8, "little"))
                node.chars += 0 if hidden else p.chars
        node.hash = h.intdigest()
    return root


def subtree_hashes(page: str | None, host: str, min_chars: int = MIN_CHARS) -> set[int]:
    """Hashes of the page's distinct subtrees that can be template, as signed integers. html, body and head can't."""
    if not page or not host:
        return set()
    nodes = _ordered(hashed(page, host))
    return {x.hash - (1 << 64) if x.hash >> 63 else x.hash for x in nodes if x.chars >= min_chars and x.name not in ("#page", "html", "body", "head")}


def _render(root: Node, drop) -> tuple[str, int]:
    out, removed, todo = [], 0, [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if node.name in _HIDDEN:
            continue
        if drop is not None and node.chars and (node.hash - (1 << 64) if node.hash >> 63 else node.hash) in drop:
            removed += 1
            continue
        edge = "\n" if node.name in _BLOCK else ""
        # Line feeds of the source are blanks; those of blocks are marked by \x00 until blanks are joined.
        todo += ["\x00" if edge else "", *[_SPACE.sub(" ", p.replace("\x00", "")) if isinstance(p, str) else p for p in reversed(node.parts)], "\x00" if edge else ""]
    text = html.unescape("".join(out))
    lines = (" ".join(x.split()) for x in text.split("\x00"))
    return "\n".join(x for x in lines if x), removed


def page_text(page: str | None, host: str, drop) -> tuple[str, int]:
    """(text, subtrees deleted); drop: template hashes, ascending, or a set of them. A page that would lose all its text is a
    copy and stays whole."""
    if not page:
        return "", 0
    root = hashed(page, host)
    if isinstance(drop, np.ndarray):
        own = np.unique(np.array([x.hash for x in _ordered(root)], np.uint64).view(np.int64))
        drop = set(own[drop[np.searchsorted(drop, own).clip(max=len(drop) - 1)] == own].tolist()) if len(drop) else set()
    text, removed = _render(root, drop)
    if removed and not text:
        return _render(root, None)[0], 0
    return text, removed


def template_hashes(pages: DataFrame, min_pages: int = MIN_PAGES, min_chars: int = MIN_CHARS, min_share: float = MIN_SHARE) -> DataFrame:
    """(k): hashes, each of host and subtree, of what at least min_pages and min_share of a host's distinct URLs hold."""

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.fromiter(subtree_hashes(page, host, min_chars), np.int64) for page, host in zip(pdf["html"], pdf["host"])]
            sizes = [len(f) for f in found]
            yield pd.DataFrame({"s": np.repeat(pdf["s"].to_numpy(), sizes), "u": np.repeat(pdf["u"].to_numpy(), sizes), "k": np.concatenate([np.zeros(0, np.int64), *found])})

    @F.pandas_udf("string")
    def host(url: pd.Series) -> pd.Series:
        return url.map(host_of)

    # A URL is a page however often it was fetched; what follows # is a place in it.
    own = pages.where("url IS NOT NULL").select(host("url").alias("host"), F.xxhash64(F.substring_index("url", "#", 1)).alias("u"), "html").where("host != ''").withColumn("s", F.xxhash64("host"))
    held = own.select("s", "u", "host", "html").mapInPandas(hold, "s bigint, u bigint, k bigint").distinct()
    many = held.groupBy("s", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sites = own.select("s", "u").distinct().groupBy("s").agg(F.count("*").alias("pages"))
    return many.join(sites, "s").where(F.col("n") >= F.col("pages") * min_share).select("k")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_chars: int = MIN_CHARS, broadcast_hashes: int = BROADCAST_HASHES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, host, text, n_removed) for every row of pages: visible text, a line a block, without template subtrees.

    A subtree is an element with its name, attributes and content, comments and blanks aside. Every element with min_chars
    visible characters is hashed and counted per host; those that at least min_pages of the host's distinct URLs hold, and at
    least min_share of them, are deleted from all its pages, the outermost first.

    Nulls: a null html has an empty text; a null or malformed url has the host "" and no template. A page of template alone
    stays whole, as it is a copy of others. Repeated rows, and other fetches of a URL, count as one page and are all returned.
    Ties don't occur. An empty table gives an empty result. Broken markup is mended; pages of any length and depth are read
    whole, in time proportional to them. Other columns aren't read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    templates = saved(template_hashes(pages, min_pages, min_chars, min_share), "templates")
    schema = "page_id string, host string, text string, n_removed int"
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")

    def read(pdf: pd.DataFrame, drops) -> pd.DataFrame:
        hosts = [host_of(u) for u in pdf["url"]]
        done = [page_text(p, h, d if h else None) for p, h, d in zip(pdf["html"], hosts, drops)]
        return pd.DataFrame({"page_id": pdf["page_id"], "host": hosts, "text": [t for t, _ in done], "n_removed": [n for _, n in done]})

    if templates.count() <= broadcast_hashes:
        shared = spark.sparkContext.broadcast(np.unique(templates.toArrow()["k"].to_numpy()))

        def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield read(pdf, [shared.value] * len(pdf))

        out = rows.mapInPandas(every, schema)
    else:

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sets = [sorted(subtree_hashes(p, host_of(u), min_chars)) for u, p in zip(pdf["url"], pdf["html"])]
                yield pd.DataFrame({"t": pdf["t"], "k": sets}).explode("k").dropna().astype({"k": "int64"})

        def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield read(pdf, [set() if d is None else set(d) for d in pdf["drop"]])

        t = F.xxhash64("url", "html").alias("t")
        asked = rows.select(t, "url", "html").mapInPandas(ask, "t bigint, k bigint").distinct()
        found = asked.join(templates, "k").groupBy("t").agg(F.collect_list("k").alias("drop"))
        out = rows.select("*", t).join(found, "t", "left").mapInPandas(joined, schema)
    return out.select(F.col("page_id").cast("bigint").alias("page_id"), "host", "text", "n_removed")
