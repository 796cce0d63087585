"""URL filters against a plain walk of rules and alias edges."""

import random

from tidemark.llm.components import components
from tidemark.llm.common import Scratch
from tidemark.llm.url_filters import RULES, judge

SCHEMA = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en", "http://a.b.example.net/es/1", "https://net/fr/", "http://xnet/fr/", "http://example.com", "http://example.com?x=/en/", "a://b://c.net/es/", "http://ÀB.net/fr/é", "http://notexample.com/en/", "http://example.org/en/", "http://example.com:80/en/"]
    got = {r.page_id: r for r in judge(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA), RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = parts(u)
        r = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, r and r.name), u
        assert got[i].verdict == ("allow" if r is None or r.allow else "block"), u


def test_block_reaches_aliases_but_not_allowed_ones(spark):
    link = lambda u: f"<html><head><LINK href='{u}' rel=\"canonical\"></head>"
    rows = [
        (1, "http://m.site.org/a", link("http://x.net/es/a")),
        (2, "http://other.org/b", '<meta http-equiv="refresh" content="0; url=http://m.site.org/a">'),
        (3, "http://www.site.com/c", link("http://x.net/es/a")),
        (4, "http://clean.org/d", link("/e")),
        (5, "http://clean.org/e#frag", "<p>canonical"),
        (6, "http://x.net/es/a", None),
        (7, "http://m.site.org/a", None),
        (8, None, link("http://x.net/es/a")),
        (9, "http://far.org/", link("")),
    ]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow"}


def test_told_redirects_and_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", None, "x"), (1, "http://a.org/", None, "y"), (None, "http://b.org/", None, None)], SCHEMA + ", host string")
    told = spark.createDataFrame([("http://a.org/", "http://t.net/fr/"), (None, "http://b.org/"), ("http://b.org", "http://b.org/")], "u string, v string")
    assert sorted(str((r.page_id, r.verdict)) for r in judge(pages, RULES, redirects=told).collect()) == ["(1, 'block')", "(1, 'block')", "(None, 'allow')"]
    assert judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in judge(pages, []).collect()} == {"allow"}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3)]
    up = {}

    def find(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert got == {a: find(a) for a in up}


def test_long_tags_are_read(spark):
    bad, long = "http://a.net/es/1", "x" * 20_000
    rows = [(0, bad, None), (1, "http://b.org/1", f'<link data-x="{long}" rel="canonical" href="{bad}">'), (2, f"http://c.org/{long}", None)]
    rows += [(3, bad, f'<meta http-equiv="refresh" content="0; url=http://c.org/{long}">'), (4, "http://d.org/1", f'<link rel="canonical" href="{bad}" ' + "<link " * 20_000)]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "allow"}


def test_links_are_resolved(spark):
    from urllib.parse import urljoin

    from tidemark.llm.url_filters import alias_edges

    page = "http://Site.org/a/b/c.html?x=1#f"
    links = ["d", "./d", "../d", "../../d", "../../../d", "/x/./y/../z", "?q=1", "//o.net/p", "https://o.net/p/../q?u=/../v", "d/..", "d/.", "..", ".", "g;x=1/../y", "d?y=../z"]
    strange = ["", "#top", "mailto:a@b.org", "javascript:void(0)"]
    escaped = {"/p?a=1&amp;b=2": "/p?a=1&b=2", "/p?a=1&#38;b=2": "/p?a=1&b=2", "/&#x2603;&#X1F600;": "/\u2603\U0001f600", "/&amp;lt;": "/&lt;", "/&nbsp;&": "/&nbsp;&", "/&#xD800;&#0;": "/&"}
    rows = [(i, page, f'<link rel="canonical" href="{x}">') for i, x in enumerate([*links, *strange, *escaped])]
    want = {(i, urljoin("http://site.org/a/b/c.html?x=1", x).replace("/p/../q", "/q")) for i, x in enumerate(links)} | {(len(links) + len(strange) + i, "http://site.org" + x) for i, x in enumerate(escaped.values())}
    own = "http://site.org/a/b/c.html?x=1"
    # a query of its own tells the pages apart
    rows = [(i, u.replace("?x=1", f"?x={i}"), h) for i, u, h in rows]
    got = {r.u: r.v for r in alias_edges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {own.replace("?x=1", f"?x={i}"): v for i, v in want}


def test_tags_of_many_forms(spark):
    from tidemark.llm.url_filters import alias_edges

    html = [
        '<link rel="alternate Canonical" href="x">',
        "<base target=_top><BASE HREF='http://o.net/deep/'><base href='http://no.net/'><link href=x rel=canonical>",
        '<base href="/up/"><link rel="canonical" href="x">',
        '<meta http-equiv=" refresh" content="0;URL=\'x\'">',
        '<link rel="canonical-not" href="x"><link rel="stylesheet" href="canonical">',
    ]
    got = {r.u: r.v for r in alias_edges(spark.createDataFrame([(i, f"http://s.org/{i}/", h) for i, h in enumerate(html)], SCHEMA)).collect()}
    assert got == {"http://s.org/0/": "http://s.org/0/x", "http://s.org/1/": "http://o.net/deep/x", "http://s.org/2/": "http://s.org/up/x", "http://s.org/3/": "http://s.org/3/x"}
