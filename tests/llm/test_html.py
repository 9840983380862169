import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import html_templates as H

SCHEMA = "page_id bigint, url string, html string, text string, k string, t string"
NAV = "<nav><ul><li><a href=/a>Home of the site</a></li><li>About all of us</li></ul></nav>"
FOOT = "<footer>Copyright by example, all rights</footer>"


def page(i, nav=NAV, foot=FOOT):
    return f"<html><head><title>T{i}</title><script>var a='</p>';</script></head><body>{nav}<!-- {i} --><article><h1>Title &amp; {i}</h1><p>Own text number {i} of this page<p>More <b>text</b> {i}</article>{foot}</body></html>"


def rows(pairs):
    return [(i, u, h, "own", "own", "own") for i, (u, h) in enumerate(pairs)]


def own_text(i):
    return f"Title & {i}\nOwn text number {i} of this page\nMore text {i}"


def site(n=12):
    return [(f"https://a.org/{i}", page(i)) for i in range(n)] + [(f"http://B.org:80/{i}?q", page(100 + i)) for i in range(3)]


class Reader(HTMLParser):
    """A tree of well-formed pages: [name, attributes, children]."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["", (), []]
        self.stack = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, tuple(attrs), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(" ".join(data.split()))


def chars(node):
    return len(node) if isinstance(node, str) else sum(map(chars, node[2]))


def below(node):
    yield node
    for x in node[2]:
        if not isinstance(x, str):
            yield from below(x)


def brute(pairs, min_pages, min_chars, share):
    """By another parser, subtrees compared as they are."""
    trees = [Reader(h).root for _, h in pairs]
    urls, holders = {}, {}
    for (u, _), tree in zip(pairs, trees):
        host = u.split("/")[2]
        urls.setdefault(host, set()).add(u)
        for x in below(tree):
            if x[0] not in ("", "html", "body", "head") and chars(x) >= min_chars:
                holders.setdefault((host, repr(x)), set()).add(u)
    bad = {k for k, v in holders.items() if len(v) >= min_pages and len(v) >= share * len(urls[k[0]])}

    def lines(node, host, gone):
        if (host, repr(node)) in bad:
            gone.append(node)
            return
        for x in node[2]:
            if isinstance(x, str):
                if x:
                    yield x
            else:
                yield from lines(x, host, gone)

    out = []
    for (u, _), tree in zip(pairs, trees):
        gone: list = []
        text = "\n".join(lines(tree, u.split("/")[2], gone))
        out.append((text, len(gone)))
    return out


def test_template_goes_content_stays(spark):
    df = spark.createDataFrame(rows(site()), SCHEMA)
    got = {r["page_id"]: r for r in H.extract(df).collect()}
    for i in range(12):
        assert got[i]["text"] == own_text(i) and got[i]["n_removed"] == 2 and got[i]["host"] == "a.org"
    assert got[12]["text"].startswith("Home of the site\nAbout all of us\nTitle & 100") and got[12]["host"] == "b.org" and got[12]["n_removed"] == 0


@pytest.mark.parametrize("share", [0.0, 0.6, 0.9])
def test_both_ways_and_brute_force_agree(spark, share):
    """Pages fetched several times, some with other content, count once."""
    rng = random.Random(3)
    bits = [f"<div class=c{i}><p>repeated block {i} here</p></div>" for i in range(6)]
    whole = lambda i: f"<html><body>{''.join(rng.sample(bits, 3))}<section><p>own text {i} here</p></section>{rng.choice(bits)}</body></html>"
    pairs = [(f"https://h{rng.randint(0, 2)}.net/{i // 2}", whole(i)) for i in range(90)]
    pairs += [pairs[0]] * 12 + [(pairs[1][0], whole(500)) for _ in range(12)]
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    want = sorted((i, *x) for i, x in enumerate(brute(pairs, 10, 16, share)))
    for limit in (H.BROADCAST_HASHES, 0):
        assert sorted((r["page_id"], r["text"], r["n_removed"]) for r in H.extract(df, broadcast_hashes=limit, min_share=share).collect()) == want
    assert any(n for _, _, n in want) == (share < 0.9)


def test_one_page_fetched_often_keeps_its_article(spark):
    df = spark.createDataFrame(rows([("https://a.org/x", page(1).replace("text number", f"visit number {i // 4} today"[:14])) for i in range(20)] + [(f"https://a.org/x#{i}", page(1)) for i in range(20)]), SCHEMA)
    assert all(r["n_removed"] == 0 and "Title & 1" in r["text"] for r in H.extract(df).collect())


@pytest.mark.parametrize("bad", ["<a ", "<div>", "</b>", "<a '\">' ", "<a \"> x \"", "<!-- ", "<![CDATA[", "<script>", "<p title='", "<? ", "&amp;", "<li><p>"])
def test_parser_is_linear(bad):
    start = time.time()
    H.page_text("<div>" * 100_000 + bad * 200_000 + "</b>" * 100_000, "h", None)
    assert time.time() - start < 12


def test_parser_mends():
    text = lambda h: H.page_text(h, "", None)[0]
    assert text("<p>one<p>two<br>three</b></div><li>x<li>y") == "one\ntwo\nthree\nx\ny"
    assert text("a < b <unclosed <i>c</i> &lt;d&gt; &#233;") .startswith("a < b")
    assert text("<script>if (a < b) { '<p>' }") == "" and text("x<!-- never closed") == "x" and text("<style>p{}</style>y<textarea>z") == "y"
    assert text("<div>" * 50_000 + "deep") == "deep"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert text("<a title='x>y'>link</a>\x00") == "link"
    assert text("word " * 200_000).count("word") == 200_000


def test_awkward(spark):
    copies = [(f"https://c.org/{i}", "<body><div>the whole page is a copy</div></body>") for i in range(12)]
    pairs = [(None, page(1)), ("not a url", page(2)), ("https://d.org", None), ("https://d.org", ""), *copies]
    df = spark.createDataFrame(rows(pairs) + [(None, "https://d.org", "<p>no id", "x", "x", "x")], SCHEMA)
    for limit in (H.BROADCAST_HASHES, 0):
        got = H.extract(df, broadcast_hashes=limit).orderBy(F.col("page_id").asc_nulls_last()).collect()
        assert [r["text"] for r in got][2:] == ["", "", *["the whole page is a copy"] * 12, "no id"]
        assert got[0]["host"] == got[1]["host"] == "" and got[0]["n_removed"] == 0 and got[-1]["page_id"] is None
    assert H.extract(df.limit(0)).count() == 0
