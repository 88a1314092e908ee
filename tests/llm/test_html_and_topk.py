import numpy as np
import pytest
from pyspark.sql import functions as F

from shizuku.llm import html_main, topk
from shizuku.llm.html_pages import LABELLED


def say(n, k):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.mark.parametrize("page", [None, "", "<p>", "<script>var x = 1;</script>", "<nav><a>a</a></nav>", "</p></p>", "<!-- never closed"])
def test_pages_without_main_text(page):
    assert html_main.main_text(page) == ""


def test_labelled_pages_are_found():
    exact = found = 0
    for page, wanted in LABELLED:
        got = html_main.main_text(page)
        found += sum(w in got for w in wanted)
        exact += all(any(w in block for w in wanted) for block in got.split("\n\n"))
    assert found >= 0.995 * sum(len(w) for _, w in LABELLED)
    assert exact >= 0.85 * len(LABELLED)


def test_weights_hold_on_pages_that_took_no_part(monkeypatch):
    html_main.weights.cache_clear()
    monkeypatch.setattr(html_main, "LABELLED", [x for k, x in enumerate(LABELLED) if k % 3])
    try:
        texts = [(html_main.main_text(page), wanted) for page, wanted in LABELLED[::3]]
    finally:
        html_main.weights.cache_clear()
    assert sum(w in got for got, wanted in texts for w in wanted) >= 0.98 * sum(len(w) for _, w in texts)


ROWS = "<table>" + "".join(f"<tr><td>cell{i}</td><td>{i}</td></tr>" for i in range(80)) + "</table>"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>link{i} on</a></li>" for i in range(30)) + "</ul>"


@pytest.mark.parametrize(
    ("part", "stays"),
    [
        (ROWS, True), (LINKS, True), ("<figure><img src=a><img src=b></figure>" * 40 + "<p>after</p>", True), ('<section id="related-work"><p>other studies</p></section>', True),
        ('<p class="notice-period">ends in May</p>', True), ('<h2 id="search-methods">how we looked</h2>', True), ("<p title='it's'>quoted</p>", True), ("<header><p>by line</p></header>", True),
        (f'<div class="ad">{say(200, 9)}</div>', False), ('<div class="ad-banner">' + f"<p>{say(20, 9)}</p>" * 30 + "</div>", False), ('<div class="notice">we moved</div>', False), ("<aside><p>see also</p></aside>", False),
        ("<form><label>your name</label></form>", False), ('<section id="comments"><p>first one</p></section>', False), ('<div class="related-posts"><a href=x>more posts</a></div>', False), ("<script>if (a < b) go('</p>')</script>", False),
        ('<p hidden>out of sight</p>', False), ('<p style="display: none">out of sight</p>', False), ("<nav><a href=x>elsewhere</a></nav>", False), ("<footer>all rights</footer>", False),
    ],
)
def test_parts_within_an_article(part, stays):
    page = f"<html><body><nav><ul><li><a href=/a>menu</a></li></ul></nav><article><h1>{say(5, 0)}</h1><p>{say(30, 1)}</p>{part}<p>{say(30, 2)}</p></article><footer>end</footer>"
    got = html_main.main_text(page).split("\n\n")
    assert got[:2] == [say(5, 0), say(30, 1)] and got[-1] == say(30, 2)
    inner = " ".join(html_main.SPACE.sub(" ", "".join(v for k, v, *_ in html_main.tokens(part.replace(">", "> ")) if k == "text")).split())
    assert " ".join(got[2:-1]) == (inner if stays else "")


@pytest.mark.parametrize("bit", ["<a", '<p title="', "<b>", "< ", "<!-- ", "<ul><li>", "<script>", "<a b=", "</x", "&amp", "<div><p>"])
def test_broken_markup_takes_linear_time(bit):
    import time

    html_main.weights()
    began = time.time()
    html_main.main_text(bit * 20_000)
    small = time.time() - began
    began = time.time()
    html_main.main_text(bit * 200_000 + "</i>" * 200_000)
    assert time.time() - began < 40 * small + 5


def test_broken_markup_keeps_what_it_can():
    art = f"<article><p>{say(20, 1)}</p>"
    assert html_main.main_text(art + "<p class='x") == say(20, 1)
    assert html_main.main_text(art + "<!-- open") == say(20, 1)
    assert html_main.main_text(art + "1 < 2 &amp; <3") == f"{say(20, 1)}\n\n1 < 2 & <3"
    assert html_main.main_text('<p title="never closed>' + say(20, 1)) == say(20, 1)


def test_region_has_the_highest_sum():
    """Against all pairs of tokens, on pages without parts whose loss is bounded."""
    import math
    import random

    rng = random.Random(5)
    w = html_main.weights()
    for _ in range(30):
        bits = [rng.choice(["<p>", "<li>", "<td>", "<br>", "<ul>", "<h2>"]) + " ".join(f"v{rng.randrange(9)}" for _ in range(rng.randrange(6))) + rng.choice(["", "<a href=x>l k</a>"]) for _ in range(25)]
        page = "".join(bits)
        gains, made = [], []
        got = list(html_main.tokens(page, made))
        for kind, value, e, _ in got:
            if kind == "text":
                e.words, e.linked = e.words + len(value.split()), e.linked + len(value.split()) * e.link
        for e in reversed(made[1:]):
            e.parent.words, e.parent.linked, e.parent.heads = e.parent.words + e.words, e.parent.linked + e.linked, e.parent.heads + e.heads
        runs, run = [], 0
        for kind, value, e, _ in got:
            s = html_main.scored(e, False, made[0])
            run += kind == "text" and e.links() is None and bool(value.split())
            runs.append((id(e.links()), run) if e.links() else None)
            assert e.part is None
            gains.append(w.get(f"tag <{value}>", -0.5) * math.exp(-max(s, 0.0)) if kind == "tag" else len(value.split()) * (s - html_main.LINK if e.link else s))
        loss = {r: -sum(g for g, x in zip(gains, runs, strict=True) if x == r and g < 0) for r in runs if r}
        gains = [g * html_main.LINKS / loss[r] if r and g < 0 and loss[r] > html_main.LINKS else g for g, r in zip(gains, runs, strict=True)]
        best = max(sum(gains[i:j]) for i in range(len(gains)) for j in range(i, len(gains) + 1))
        assert html_main.regions(page)[1] == pytest.approx(max(best, 0.0))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_cutting_out_the_article(spark, sf):
    """Brute force for the form that the table's pages have: the article element by regular expressions."""
    import html
    import re

    import duckdb

    from shizuku.llm import queries

    def plain(page):
        inner = re.sub(r"<br[^>]*>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|i|em|a|span)\b[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|div)\b[^>]*>", inner)]
        return "\n\n".join(x for x in blocks if x)

    rows = duckdb.sql(f"SELECT page_id, url, html FROM '/root/testdata/sf{sf}/pages.parquet'").fetchall()
    want = sorted((i, u, plain(h), len(plain(h))) for i, u, h in rows)
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in queries.op1_html_main_text(spark, f"/root/testdata/sf{sf}").collect()) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf{sf}/pages.parquet'")
    assert sorted(db.execute(queries.OP1_SQL).fetchall()) == want


def test_parts_of_a_page():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><div id="main"><h1>{say(5, 0)}</h1><p>{say(20, 1)} A&amp;B &lt;x&gt; caf&eacute;
      two   spaces<div class="advert">Buy {say(12, 9)}</div><p>{say(12, 2)}<br>next</p></div>
    <section id="comments"><p>{say(30, 7)}</p></section><footer>{say(6, 8)}</footer>"""
    assert html_main.main_text(page) == "\n\n".join([say(5, 0), f"{say(20, 1)} A&B <x> café two spaces", f"{say(12, 2)} next"])


def test_very_long_page():
    page = "<article>" + "".join(f"<p>{say(20, i)}</p>" for i in range(3000)) + "</article>"
    assert html_main.main_text(page).count("\n\n") == 2999


def test_column_keeps_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, f"<p>{say(9, 1)}</p>")], "text long, html string")
    out = rows.select("text", html_main.extract_column(F.col("html")).alias("main")).collect()
    assert sorted((r.text, r.main) for r in out) == [(1, ""), (1, ""), (2, say(9, 1))]


def brute(vectors, queries, k):
    out = {}
    for q, e in queries:
        scores = sorted(((-int(np.floor(64 * np.array(e)) @ np.floor(64 * np.array(x))), v) for v, x in vectors if v != q))[:k]
        out[q] = [(v, -s) for s, v in scores]
    return out


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1 if i % 3 else 0)]) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 7 = 0"), k=5, block=64, query_block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(exact, [r for r in exact if r[0] % 7 == 0], 5)


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id < 6"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 4096), (0, 2, 7, 4096), (0, 3, 7, 4096), (5, 1, 0, 0), (5, 2, 6, 0), (5, 3, 7, 0)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_wide_values_are_exact():
    q, p = np.array([[2**40, -3]]), np.array([[2**20, 5], [7, 2**30]])
    assert topk.accumulate(q, p).tolist() == [[2**60 - 21, 5 * 2**40 - 3 * 2**30]]
    assert topk.accumulate(np.array([[2**31, 2**31]]), np.array([[2**31], [-(2**31)]])).tolist() == [[0]]
    with pytest.raises(ValueError, match="64 bits"):
        topk.accumulate(np.array([[2**32]]), np.array([[2**32]]))


LONG, SHORT = " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i}" for i in range(30))
WRAPPED = [
    f'<form id="aspnetForm"><nav><a href=x>homelink</a></nav><div><h1>Title</h1><p>{LONG}</p></div><div class="footer">copy right</div></form>',
    f'<form id="aspnetForm"><nav><a href=x>homelink</a></nav><article><h1>Title</h1><p>{LONG}</p></article></form>', f'<div class="sidebar-layout"><div class="content-with-sidebar"><h1>Title</h1><p>{LONG}</p></div></div>',
    f'<div id="search"><article><h1>Title</h1><p>{LONG}</p></article></div>', f'<div class="header-wrapper"><main><h1>Title</h1><p>{LONG}</p></main></div><div class="footer">copy right</div>',
]


@pytest.mark.parametrize("k", range(len(WRAPPED)))
def test_what_wraps_the_page_is_no_frame(k):
    assert html_main.main_text(f"<html><body>{WRAPPED[k]}</body></html>") == f"Title\n\n{LONG}"


@pytest.mark.parametrize("comments", [f'<div class="comments"><p>{LONG} {LONG}</p></div>', f'<div class="comments"><article><p>{LONG}</p></article><article><p>{LONG}</p></article></div>'])
def test_comments_longer_than_the_article_go(comments):
    assert html_main.main_text(f'<body><h1>Title</h1><div class="text"><p>{SHORT}</p></div>{comments}</body>') == f"Title\n\n{SHORT}"


@pytest.mark.parametrize("n", [5, 10, 25, 60, 200])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_lists_of_links_between_texts_stay(tag, n):
    for item in ('<li><a href="/{i}">link{i} text</a></li>', '<div><a href="/{i}">link{i} text</a></div>', '<p><a href="/{i}">link{i} text</a></p>'):
        items = "".join(item.format(i=i) for i in range(n))
        items = f"<ul>{items}</ul>" if item.startswith("<li") else items
        page = f"<body><nav><ul><li><a href=q>navlink</a></li></ul></nav><{tag}><h1>Title</h1><p>{SHORT}</p>{items}<p>{LONG}</p></{tag}><footer>copyfoot</footer></body>"
        assert html_main.main_text(page) == "\n\n".join(["Title", SHORT, *(f"link{i} text" for i in range(n)), LONG])


def test_letters_that_change_length_in_lower_case():
    page = f"<article><p>\u0130-dot start {SHORT}</p><script>var x = '</scr\u0131pt>';</SCRIPT><p>after {LONG}</p><style>a</style><p>\u0130\u0130 end</p></article>"
    assert html_main.main_text(page) == f"\u0130-dot start {SHORT}\n\nafter {LONG}\n\n\u0130\u0130 end"
