import pytest
from pyspark.sql import functions as F

from sessionlens.llm import html_text as h
from sessionlens.llm.queries import op10_html

ARTICLE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home<li>About</ul></nav><div class='ad'>Buy</div><article><header><h1>Big &amp; news</h1></header><p><b>One\n two<br>three<p>Four&nbsp;five<div class='comments'><p>Comments<p>me too {0}</div></article><footer>&copy; x</footer></body></html>"


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in h.main_text(df, tasks=3).collect()}


def test_article_and_empty_pages(spark):
    got = texts(spark, [(1, "http://a/x/1", ARTICLE), (2, None, None), (3, "http://a/x/2", ""), (None, "::bad[", "<p>only")])
    assert got[1] == "Big & news\n\nOne two three\n\nFour five\n\nComments\n\nme too {0}"  # nothing to compare with
    assert got[2] == got[3] == "" and got[None] == "only"
    assert texts(spark, []) == {}


def test_comments_in_articles_go_by_their_shared_heading(spark):
    rows = [(i, f"http://a/x/{i}", ARTICLE.replace("{0}", f"says {i}").replace("Four", f"Four {i}").replace("One", f"One {i}").replace("Big", f"Big {i}")) for i in range(5)]
    got = texts(spark, rows)
    assert all(got[i] == f"Big {i} & news\n\nOne {i} two three\n\nFour {i} five" for i in range(5))


def test_frames_of_pages_without_an_article(spark):
    page = (
        "<body><div class=top>Site</div><div role=navigation>Menu {0}</div><div class=promo>Buy {0} now</div><div class='box'><p>Letters<p>Reader {0}</div>"
        "<div class=text><h2 id=share-price>Price {0}</h2><p>{0} is a long line of text<div class=comments-off>Note {0}, of which more than one line follows<p>last {0}</div></div><div>Imprint</div></body>"
    ).format
    rows = [(i, f"http://b/{i}", page(f"w{i}")) for i in range(6)]
    got = texts(spark, [*rows, (50, "http://c/1", page("alone"))])
    assert all(got[i] == f"Price w{i}\n\nw{i} is a long line of text\n\nNote w{i}, of which more than one line follows\n\nlast w{i}" for i in range(6))
    assert got[50].startswith("Site\n\nBuy alone now") and "Menu" not in got[50]


def test_decisions_follow_a_plain_pairing(spark):
    import random

    r = random.Random(3)
    word = lambda k: "".join(r.choice("ab") for _ in range(k))
    rows = []
    for i in range(120):
        lines = "".join(f"<{t}><p>{r.choice([t, t, t, word(2)])}</p><p>{word(r.choice([1, 9]))}</p></{t.split()[0]}>" for t in ["div", "div id=x", "section", "section class=y", "ul"] if r.random() < 0.8)
        rows.append((i, f"http://{r.choice('mn')}/{word(3)}", r.choice(["", "<article>"]) + lines))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS k1", "'x' AS text", "2 AS seq", "'h' AS host")
    keys = {k["page_id"]: (k["k1"], k["k2"]) for k in h.keyed_pages(df, "page_id", "url", "html").collect()}
    order = sorted(rows, key=lambda x: (*h.url_key(x[1]), *keys[x[0]]))
    got = {x["page_id"]: x["text"] for x in h.main_text(df, tasks=4).collect()}
    changed = 0
    for at, (i, url, page) in enumerate(order):
        near = [order[k] for k in range(max(0, at - 2), at + 3) if k != at and k < len(order) and h.url_key(order[k][1])[0] == h.url_key(url)[0]]
        own, says = [(b, t) for _, b, t in h.page_lines(page)], []
        hits = [longest(own, [(b, t) for _, b, t in h.page_lines(p)]) for _, _, p in near]
        for n, (b, _) in enumerate(own):
            homes = sum(b in [x for _, x, _ in h.page_lines(p)] for _, _, p in near)
            says.append((2 * sum(n in x for x in hits) > len(near)) + 2 * (2 * homes > len(near)))
        want = h.chosen(h.page_lines(page), bytes(says))
        changed += want != [t for _, _, t in h.page_lines(page)]
        assert got[i] == "\n\n".join(want)
    assert changed > 10


def longest(a, b):
    """Places in `a` of the longest common subsequence that the operator picks; another test holds its length against all subsequences."""
    names = {x: n for n, x in enumerate(dict.fromkeys([*a, *b]))}
    return {i for i, x in enumerate(h.shared_lines([names[x] for x in a], [names[x] for x in b])) if x}


def test_shared_lines_of_nearest_pages_go(spark):
    page = "<div>Site name</div><div>{0} one</div><div>{0} two</div><div>Imprint</div>".format
    rows = [(i, f"http://host/{'ab'[i % 2]}/{i}", page(f"p{i}")) for i in range(20)]
    got = texts(spark, [*rows, (99, "http://other/1", page("alone"))])
    assert all(got[i] == f"p{i} one\n\np{i} two" for i in range(20))
    assert got[99].startswith("Site name")


def test_copies_of_a_page_stay_whole(spark):
    rows = [(i, "http://host/same", "<div>all</div><div>of it</div>") for i in range(5)] + [(7, "http://host/same", "<div>all</div><div>of it</div>")] * 3
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), tasks=2).collect()
    assert len(got) == 8 and {r["text"] for r in got} == {"all\n\nof it"}


@pytest.mark.parametrize("cells", [1, 6, 1 << 20])
def test_alignment_is_longest(cells):
    import itertools
    import random

    import numpy as np

    r = random.Random(cells)
    for _ in range(60):
        a, b = ([r.randrange(4) for _ in range(r.randrange(7))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) if any(is_sub([a[i] for i in c], b) for c in itertools.combinations(range(len(a)), n)))
        got = h.aligned(np.array(a, np.uint64), np.array(b, np.uint64), cells)
        assert len(got) == best and is_sub([a[i] for i in got], b)
        assert h.shared_lines(a, b).sum() == best


def is_sub(x, y):
    it = iter(y)
    return all(v in it for v in x)


def test_query_matches_articles(spark):
    import html
    import re

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op10_html(spark, sf).withColumn("n", F.length("text")).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n"] == r["n_chars"]


def test_open_quotes_take_linear_time():
    """A quote that never closes ends with its tag, and a page full of them is read once."""
    import time

    from sessionlens.llm.html_text import page_lines

    assert [x[2] for x in page_lines('<p>one</p><a href="x>two</a><p>three</p>')] == ["one", "two", "three"]
    assert [x[2] for x in page_lines('<p title="a > b">one</p><p>2 < 3 <b')] == ["one", "2 < 3 <b"]
    for piece in ('<a "', "<a '\"", '<p class="', "<a <b", "<!", "< ", '<a x="1">'):
        began = time.time()
        page_lines(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 8, piece
