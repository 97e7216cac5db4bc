import math
import random
import time
from collections import Counter, defaultdict

import pytest

from lexmill.llm import site_tree

CASES = [
    ("", ""),
    ("plain text", "plain text"),
    ("<html><body><nav>menu</nav><article><h1>T &amp; x</h1><p>a  b<p><b>c<br>d</article><footer>f</footer>", "T & x\na b\nc d"),
    ("<article><p>one<script>var t='</p>'</script> two</p><style>p{}</style><aside>no</aside></article>", "one two"),
    ("<div class='sidebar'>x</div><main><p>y&nbsp;&#233;&copy</p><form>q<input></form></main>", "y é©"),
    ("<article><p>keep</p><div class=\"comments\"><article><p>not me</p></article></div></article><div id=cookie-notice>no</div>", "keep"),
    ("<body><header>site</header><div class=content><p>text</p></div><div>else</div></body>", "text"),
    ("<article><header><h1>Title</h1></header><p>body <!-- gone --> here</p></article>", "Title\nbody here"),
    ("<p>a<!-- never closed", "a"),
    ("<article><ul><li>one<li>two</ul>tail</article>", "one\ntwo\ntail"),
    ("<article><p>1 < 2 and a<b</p></article>", "1 < 2 and a"),
    ("</div></p>stray", "stray"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_page_text(html, text):
    assert site_tree.Page(html).text(set()) == text


def test_repeated_branches_of_a_site_go(spark):
    rows = [(i, f"https://Site.example/{i}", f"<body><div class=box><p>same words</p></div><div class=part><p>own words {i}</p></div></body>", i, "t") for i in range(12)]
    rows += [(100 + i, "https://small.example/", "<body><div class=box><p>same words</p></div></body>", i, "t") for i in range(3)]
    rows += [(None, None, None, 1, None), (200, "no url", "", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in site_tree.extract(df).collect()}
    assert all(got[i][0] == f"own words {i}" for i in range(12))
    assert got[100][0] == "same words" and got[None] == ("", 0) and got[200] == ("", 0)
    assert site_tree.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [8, 1000])
def test_equal_pages_of_a_site_count_once(spark, copies):
    page = "<body><div class=box><p>menu words</p></div><{0}><h2>Title</h2><p>{1}</p></{0}></body>"
    rows = [(i, "https://copies.example/a", page.format("article", "same text")) for i in range(copies)]
    rows += [(2000 + i, "https://copies.example/b", page.format("article", f"own text {i}")) for i in range(3)]
    rows += [(3000 + i, "https://plain.example/", page.format("div", "same text")) for i in range(copies)]
    rows += [(5000 + i, "https://plain.example/c", page.format("div", f"own text {i}")) for i in range(3)]
    rows += [(6000 + i, "https://pairs.example/", page.format("div", f"own text {i // 2}")) for i in range(24)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == "Title\nsame text" and got[3000 + i] == "menu words\nTitle\nsame text" for i in range(copies))
    assert all(got[2000 + i] == f"Title\nown text {i}" and got[5000 + i] == f"menu words\nTitle\nown text {i}" for i in range(3))
    assert all(got[6000 + i] == f"own text {i // 2}" for i in range(24))  # twelve pages: what all of them have goes


def test_articles_keep_what_other_pages_have_too(spark):
    page = "<body><div class=box><p>same words</p></div><article><h2>Same title</h2><p>{}</p></article></body>"
    df = spark.createDataFrame([(i, "https://site.example/", page.format(f"own words {i}")) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert got == {i: f"Same title\nown words {i}" for i in range(12)}


def test_pages_of_the_driver_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = site_tree.extract(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all("©" not in r["text"].split("\n")[-1] and r["text"] for r in rows)


@pytest.mark.parametrize("html, text", [
    ("<div class='layout with-sidebar'><article><p>kept</p></article></div>", "kept"),
    ("<div id='page' class='has-sidebar'><main><p>kept</p></main></div>", "kept"),
    ("<article><p>a</p><div class='legal-text'><p>b</p></div></article>", "a\nb"),
    ("<article><div class='post-header'><h1>Title</h1></div><p>b</p></article>", "Title\nb"),
    ("<article><div class='header'><h1>Title</h1></div><p>b</p></article>", "Title\nb"),
    ("<article><p>text</p></article><article class='comment'><p>says a reader</p></article>", "text"),
    ("<div class=comments><article><p>says a reader</p></article></div><div>page text</div>", "page text"),
    ("<article class='comment'><p>says a reader</p></article><div>page text</div>", "page text"),
    ("<form id=all><nav>menu</nav><article><p>text</p></article></form>", "text"),
    ("<div class='sidebar'><article><p>wrapped</p></article></div>", "wrapped"),
    ("<div class='sidebar'><article><p>teaser</p></article></div><article><p>text</p></article>", "text"),
    ("<div class='cookie-notice'>ok?</div><div class='site-footer'>f</div><div class='sidebar-left'>s</div><div class='x'>text</div>", "text"),
    ("<div class='promo'><p>all there is</p></div>", "all there is"),
])
def test_names_are_whole_words_and_only_a_prior(html, text):
    assert site_tree.Page(html).text(set()) == text


def brute_importances(pages, min_pages):
    """Per host: every style node's pages and branch importance, from lists of distinct pages."""
    hosts = defaultdict(set)
    for host, html in pages:
        hosts[host].add(html)
    out = {}
    for host, htmls in hosts.items():
        seen, prior = defaultdict(lambda: ([], [])), {}
        for html in htmls:
            for path, p, content, shape in site_tree.Page(html).nodes():
                seen[path][0].append(content)
                seen[path][1].append(shape)
                prior[path] = max(p, prior.get(path, 0.0))
        own = {}
        for path, kinds in seen.items():
            m = len(kinds[0])
            entropy = [-sum(n / m * math.log(n / m) for n in Counter(k).values()) / math.log(m) if m > 1 else 1.0 for k in kinds]
            own[path] = prior[path] * (max(entropy) if m >= min_pages else 1.0)
        for path in seen:
            branch = max(v for q, v in own.items() if q[:len(path)] == path)
            out[host, path[-1]] = (path[-2] if len(path) > 1 else None, len(seen[path][0]), branch)
    return out


def repeated_branches(i, rng):
    """A page whose article holds the host's share box, a varying byline box, and its own words, without names that help."""
    own = " ".join(rng.choice("abcdefgh") * 3 for _ in range(12))
    return (f"<body><div class=k1><p>menu one</p><p>menu two</p></div><article><h2>Same title</h2><div class=q7><p>send this page to a friend</p>"
            f"<ul><li>one</li><li>two</li></ul></div><p>{own} {i}</p><div class=q8><p>written by {rng.choice('xyz')}{i}</p></div></article>"
            f"<div class=ads>buy {i}</div></body>")


def test_importance_decides_inside_articles_and_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "https://a.example/p", repeated_branches(i, rng)) for i in range(30)]
    rows += [(100 + i, "https://few.example/p", repeated_branches(i, rng)) for i in range(5)]
    rows += [(200 + i, "https://a.example/p", rows[i % 3][2]) for i in range(9)]
    rows += [(300 + i, "https://copy.example/p", f"<body><article><h1>T</h1><p>same for all</p></article><i>{i}</i></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {(r["host"], r["node"]): (r["above"], r["m"], r["importance"]) for r in site_tree.importances(df).collect()}
    want = brute_importances([(u.split("/")[2], h) for _, u, h in rows], 8)
    assert set(got) == set(want)
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)
    texts = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    for i, _, html in rows:
        body = html.split("<p>")
        if i < 30 or 200 <= i < 300:  # the tree takes the repeated box, and only that
            lines = texts[i].split("\n")
            assert lines[0] == "Same title" and len(lines) == 3 and lines[1] in html and lines[2].startswith("written by")
            assert texts[i] != site_tree.Page(html).text(set()) and "friend" not in texts[i] and "one" not in texts[i]
        elif i < 200:
            assert "send this page to a friend" in texts[i]
        else:
            assert texts[i] == "T\nsame for all"  # nothing else would be left
        assert body


def test_hosts_with_very_many_removed_nodes_meet_page_by_page(spark, monkeypatch):
    rng = random.Random(4)
    boxes = "".join(f"<div class=r{k}><p>box {k}</p></div>" for k in range(40))
    rows = [(i, "https://wide.example/", f"<body><article>{boxes}<p>own {i} {rng.random()}</p></article></body>") for i in range(20)]
    rows += [(100 + i, "https://a.example/p", repeated_branches(i, rng)) for i in range(12)] + [(500, None, "<article><p>x</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert all(want[i] == rows[i][2].split("<p>")[-1].split("<")[0] for i in range(20))
    monkeypatch.setattr(site_tree, "MOST_REMOVED", 10)
    assert {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()} == want


def test_a_very_long_page():
    html = "<body><nav>m</nav><article>" + "<p>some words of a paragraph</p>" * 60_000 + "</article></body>"
    start = time.perf_counter()
    assert site_tree.Page(html).text(set()).count("\n") == 59_999
    assert time.perf_counter() - start < 20
