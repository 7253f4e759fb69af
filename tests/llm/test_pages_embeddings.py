"""Pages and embeddings against plain counterparts."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import embeddings, pages

SF = "/root/testdata/sf0.001"


def test_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in df.collect()}
    for limit in (100_000, 0):
        got = pages.extract_pages(df, broadcast_hosts=limit).collect()
        assert len(got) == len(source)
        for r in got:
            body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
            body = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", body, flags=re.S))
            assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", body)).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        (None, ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><header>Top</header><main><h1>T</h1><p>One <i>t</i>wo<br>three<p>four</main><footer>f</footer>", "T One two three four"),
        ("<div class='post'><p>Long enough text of a post.</p><form>no<input></form><div class=\"comments-12\"><p>A much longer comment than the whole post itself is.</p></div></div>", "Long enough text of a post."),
        ("<article><p>a&nbsp;b&lt;c&gt; &#233;</p><script>x='</p>'</script><style>p{}</style><ul><li>one<li>two</ul></article>", "a b<c> é one two"),
        ("<article><p>unclosed <b>bold<p>next</article><aside>side</aside>", "unclosed bold next"),
    ],
)
def test_extraction(source, text):
    page = pages.Page(source or "")
    assert page.extract(page.best()[0]) == text


LONG_TEXT = "A sentence of the article that goes on for a while. " * 20
WRAPPED = ["content with-sidebar", "post no-sidebar", "has-menu", "post' id='search", "page-header", "layout-sidebar-right", "searchResults", "social", "alert"]


@pytest.mark.parametrize("name", WRAPPED)
def test_named_wrappers_keep_their_article(name):
    page = pages.Page(f"<body><nav>Menu</nav><div class='{name}'><h1>T</h1><p>{LONG_TEXT}</p></div><div class='foot'>tiny line</div></body>")
    assert page.extract(page.best()[0]) == "T " + LONG_TEXT.strip()


@pytest.mark.parametrize("name", ["sidebar", "left-sidebar", "sidebarLeft", "main-nav", "ad", "ad-slot-3", "comments", "post-comments", "comment_list", "cookie-banner", "share", "page-footer", "newsletter-box", "tags"])
def test_named_junk_goes(name):
    page = pages.Page(f"<body><article><p>The article is short, but it is all.</p><div class='{name}'><p>{LONG_TEXT}</p></div></article><div id='{name}'>{LONG_TEXT}</div></body>")
    assert page.extract(page.best()[0]) == "The article is short, but it is all."


def test_a_form_around_the_page_is_no_form():
    page = pages.Page(f"<body><form id=all><div><h1>T</h1><p>{LONG_TEXT}</p></div><form class=login>Name <input></form></form></body>")
    assert page.extract(page.best()[0]).startswith("T A sentence")


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a "', "<a '>' ", "<!--", "<!", "</script", "<script>", "<b>", "<div>", "<i><div><b></i>", "</i>", "<ul><p>", "<li>", "&amp", "<a href='x'>", "<b></p>", "<table><tr><td>", "<p><b>x"])
def test_malformed_pages_take_linear_time(unit):
    import time

    took = []
    for n in (100_000, 1_000_000):
        source = "<p>start</p>" + unit * (n // len(unit)) + "\"'"
        began = time.process_time()
        page = pages.Page(source)
        page.extract(page.best()[0])
        page.find(page.path(page.best()[0]))
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 0.5


def test_votes_by_force(spark):
    """Votes and their sums by host and path, over hosts with several layouts."""
    r = np.random.default_rng(5)
    made = [f"<body><div class='{c}{i}'><p>{'word ' * int(n)}</p></div><div class=x>short</div></body>" for i, (c, n) in enumerate(zip(r.choice(list("abc"), 60), r.integers(5, 60, 60)))]
    rows = [(i, f"http://h{i % 4}.org/{i}", m) for i, m in enumerate(made)]
    want = {}
    for _, url, m in rows:
        page = pages.Page(m)
        node, score = page.best()
        own = want.setdefault((url.split("/")[2], page.path(node)), [0, 0.0])
        own[0] += 1
        own[1] += score
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {(v.host, v.path): [v.votes, v.score] for v in pages.votes(df).collect()} == want
    first = {}
    for (host, path), (n, score) in sorted(want.items(), key=lambda x: (-x[1][0], -x[1][1], x[0][1])):
        first.setdefault(host, []).append(path)
    got = {x.page_id: x.text for x in pages.extract_pages(df).collect()}
    for i, url, m in rows:
        page = pages.Page(m)
        nodes = next(n for p in first[url.split("/")[2]] if (n := page.find(p)))
        assert got[i] == page.extract(*nodes)


A, B = "The first half of the story is a long one, with many words in it.", "The second half is shorter, but belongs to it."
SPLIT = [
    f"<body><nav>Menu</nav><div class='post'><section><p>{A}</p></section><section><p>{B}</p></section></div><footer>f</footer></body>",
    f"<body><nav>Menu</nav><div class='post'><section><div><p>{A}</p></div></section><section><div><p>{B}</p></div></section></div><footer>f</footer></body>",
    f"<body><article class='part'><p>{A}</p></article><aside>x</aside><article class='part'><p>{B}</p></article></body>",
    f"<body><table><tr><td><p>{A}</p></td><td><p>{B}</p></td></tr></table></body>",
]


@pytest.mark.parametrize("source", SPLIT)
def test_split_bodies_are_whole(spark, source):
    rows = [(i, f"http://h.org/{i}", source) for i in range(3)]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"{A} {B}"}


def test_consensus_wins_over_a_page(spark):
    good = "<body><div class='body-{n}'><p>The story of the day is told here, in some words.</p></div><div class='box'><p>{x}</p></div></body>"
    rows = [(i, f"http://User@H.org:80/{i}", good.format(n=i, x="short")) for i in range(5)] + [(9, "https://h.org/9", good.format(n=9, x="one page has a long box " * 9))]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"The story of the day is told here, in some words."}


def cosine_by_force(rows, cosine):
    ids, links = [i for i, _ in rows], [0] * len(rows)
    label = list(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for (_, v), o in zip(rows, ok)]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(zip(ids, links, label), key=str)


@pytest.mark.parametrize(("size", "dims", "seed"), [(16, 8, 1), (1024, 24, 2), (8, 3, 3)])
def test_vectors_by_force(spark, size, dims, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((20, dims))
    rows = [(i, (centres[i % 20] + r.standard_normal(dims) * 0.12).tolist()) for i in range(260)]
    rows += [(300 + i, rows[i % 4][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(((x.vec_id, x.n_links, x.component_id) for x in embeddings.near_duplicate_vectors(df, 0.95, size).collect()), key=str)
    assert got == cosine_by_force(rows, 0.95)


def test_double_vectors_stay_double(spark):
    """A pair that single precision would move over the threshold, components beyond its range, and clashing columns."""
    angle = np.arccos(0.95)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], -i) for i, a in enumerate([0.0, angle - 1e-10, 2 * angle + 1e-9])]
    rows += [(3, [1e200, 1e199], 0), (4, [1e-200, 1e-201], 0), (5, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long").withColumns({c: spark_lit for c, spark_lit in (("d1", F.lit("x")), ("n", F.lit(None)), ("component_id", F.lit(7)))})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (0, 2), 3: (3, 0), 4: (3, 0), 5: (0, 5)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [1e30, 1e25])]
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    linked = {1: 4, 2: 4, 10: 4, 11: 4}
    want = sorted(((i, linked.get(i, 0), 1 if i in linked else i, i is None or i not in linked or i == 1) for i, _ in rows), key=str)
    assert got == want


def test_real_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = df.toPandas()
    x = np.stack(p.embedding.values).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cosine in (0.95, 0.4):
        want = dict(zip(p.vec_id, (x @ x.T >= cosine).sum(1) - 1))
        assert {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(df, cosine, 64).collect()} == want
