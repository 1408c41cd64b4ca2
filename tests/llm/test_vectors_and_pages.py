"""Vector operators against brute force, and main text of hand-made pages."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from sourcelore.llm import html, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n int, role int, list string"


def vecs_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, 2, "x") for i, v, y in rows], SCHEMA)


def clustered(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d))
    return (centre[rng.integers(0, 12, n)] + rng.normal(scale=rng.choice([0.02, 0.1, 0.6], n)[:, None], size=(n, d))).astype(np.float32)


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [], 1), (906, [1.0] * 16, None)]


def brute_links(rows, bound=0.98):
    x, ok = [], []
    for i, v, y in rows:
        good = v is not None and len(v) and y is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))
        ok.append(bool(good))
        x.append(np.array(v, np.float32).astype(float) if good else None)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                link[a, b] = link[b, a] = (x[a] * x[b]).sum() / np.sqrt((x[a] ** 2).sum() * (x[b] ** 2).sum()) >= bound
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(link[todo.pop()]):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(rows[b][0] for b in seen)
        out.append((rows[a][0], int(link[a].sum()), least, rows[a][0] == least))
    return sorted(out)


def test_vector_duplicates_equal_brute_force(spark):
    x = clustered(400)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(500 + i, (x[5] * (1 + i % 3)).tolist(), 2) for i in range(60)] + ODD + [(7, x[7].tolist(), 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    got = vectors.near_duplicates(vecs_of(spark, rows), per_cell=20).collect()
    assert sorted(map(tuple, got)) == brute_links(rows)
    assert sum(r.n_links for r in got) > 500


def test_crowded_cells_are_dealt_out_and_lose_nothing(spark, monkeypatch):
    whole = vectors.tiles
    monkeypatch.setattr(vectors, "tiles", lambda rows, keys, sizes: whole(rows, keys, 16, 40, sizes))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(clustered(300, seed=3))]
    for per_cell in (1000, 12):
        assert sorted(map(tuple, vectors.near_duplicates(vecs_of(spark, rows), per_cell=per_cell).collect())) == brute_links(rows)


@pytest.mark.parametrize("scale", [0.02, 0.1, 0.3])
def test_cells_lose_no_neighbour(scale):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5)) * scale
    home, open_ = vectors.cells(x, x[rng.choice(400, 30, False)], 0.1)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, j in zip(*np.nonzero(far <= 0.1)):
        assert open_[i, home[j]]
    assert open_.mean() < 1 or scale < 0.1


def test_vectors_of_doubles_link_as_they_are(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    x[30:] = x[:30] + rng.normal(scale=0.21, size=(30, 6))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(table).collect()}
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    assert got == {i: int((unit @ unit[i] >= 0.98).sum()) - 1 for i in range(60)} and sum(got.values()) > 10


def test_nearest_recall_order_and_ties(spark):
    x = clustered(3000, seed=2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000 + i, x[40].tolist(), 1) for i in range(30)] + [(i + 9000, v, y) for i, v, y in ODD[:6]] + [(None, [1.0] * 16, 1)]
    got = {}
    for r in vectors.nearest(vecs_of(spark, rows), F.col("vec_id") % 20 == 0, k=20, list_size=64, ratio=0.3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, v, _ in rows[:3030]])
    every = np.array([v for _, v, _ in rows[:3030]], np.float32).astype(float)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        score = (every * every[ids == q][0]).sum(1)
        assert all(f[2] == score[ids == f[1]][0] for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        score[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit += len(want & {f[1] for f in found})
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    assert hit / (20 * len(got)) > 0.95
    few = vectors.nearest(vecs_of(spark, rows[:5]), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 4


@pytest.mark.parametrize("n,list_size", [(2_000, 256), (20_000, 256), (20_000, 8)])
def test_nearest_recall_without_structure(spark, tmp_path, n, list_size):
    x = np.random.default_rng(4).normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    got = {}
    for r in vectors.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % (n // 60) == 0, k=20, list_size=list_size).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hit += len(found & set(np.argsort(-score)[:20].tolist()))
    assert len(got) >= 60 and hit / (20 * len(got)) > 0.95


def test_empty_vector_tables(spark):
    empty = vecs_of(spark, ODD[:1]).limit(0)
    assert vectors.near_duplicates(empty).count() == 0
    assert vectors.nearest(empty, F.col("vec_id") == 0).count() == 0


PAGES = {
    "<p>Only &amp; text &lt;b&gt; with a great many words in it, so that it is kept as the text": "Only & text <b> with a great many words in it, so that it is kept as the text",
    "<nav><a>Home</a></nav><article><h1>A  title</h1><p>One\n two<br>three<p>Four <b>five</b>six<script>x='</p>'</script></article><footer>f</footer>": "A title\nOne two three\nFour fivesix",
    "<article><p>Kept &eacute;&#233;&#xe9; &unknown; a < b</p><!-- <p>no</p> --><aside>no no</aside><form><p>no</p><button>b</button></form><p>End": "Kept ééé &unknown; a < b\nEnd",
    "<article><p>Cut off in a ta": "Cut off in a ta",
    "<article><p>Cut off in a tag</p><a href='x": "Cut off in a tag",
    "<article><p>Text</p></article><div id='comments'><article><p>A reader's own words that are many, many, many more than nine words</p></article></div>": "Text",
    "<article><p title=it's>one two three</p><p class=a'b>more</p></article>": "one two three\nmore",
    "<article><p data-x=\"a > b\">one two</p><img alt='>' src=x><p>three</article>": "one two\nthree",
    "<article><p>Before the war.</p><div class='story-comments-free'><p>A free story.</p></div><div class=related-work><p>Some other people wrote of it.</p></div></article>": "Before the war.\nA free story.\nSome other people wrote of it.",
    "<div><a>Home</a> <a>News</a></div><div><h1>The flood</h1><p>The river rose during the night and by the morning the lower fields were under water, as farmers had feared</p><p>Short one.</p>"
    "<p>After some days the water went back and people came home to find the damage that had been done to the town</p></div><div>Subscribe to our newsletter today and get ten percent off your first order</div><footer>c</footer>":
    "The flood\nThe river rose during the night and by the morning the lower fields were under water, as farmers had feared\nShort one.\nAfter some days the water went back and people came home to find the damage that had been done to the town",
    "<form id=aspnetForm><nav>Menu</nav><article><header class=entry-header><h1>Title</h1></header><p>Its text.</p><form><p>Your name</p></form></article></form>": "Title\nIts text.",
    "<body class='has-sidebar no-comments'><main><p>Its text.</p><div class='adBanner'>Buy</div></main></body>": "Its text.",
    "<article>" + "<div>" * 5000 + "<aside><div>no</div></aside><nav>no</nav><p>Deep</p>" + "</div>" * 5000 + "<p>End</p></article><p>no": "Deep\nEnd",
    "": "",
    "<html><head><title>t</title></head><body></body></html>": "",
    "<!-- open comment <p>text": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page, html.tree()) == PAGES[page]


def test_tree_generalises_by_neighbours():
    node = html.tree()
    used = lambda n: set() if len(n) == 1 else {html.FEATURES[n[0]]} | used(n[2]) | used(n[3])
    assert {"link_density", "words_before", "words_after", "density_before", "density_after"} <= used(node)
    x, y = html.labelled(200, first=10_000)  # pages that it has not seen
    plain = x[:, html.FEATURES.index("place_on_page")] < 1
    right = html.decide(node, x) == y.astype(bool)
    assert right[plain].mean() > 0.96 and right[~plain].mean() > 0.98 and 0.3 < plain.mean() < 0.7
    assert (html.decide(node, html.labelled()[0]) == html.labelled()[1].astype(bool)).mean() > 0.98


def test_trees_equal_a_plain_search():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    y = (x[:, 1] + x[:, 2] > 3).astype(int)
    f, t = html.grow(x, y, least=1)[:2]

    def cost(f, t):
        return sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (x[:, f] <= t, x[:, f] > t))

    assert cost(f, t) == pytest.approx(min(cost(g, u + 0.5) for g in range(3) for u in range(3)))
    assert (html.decide(html.grow(x, y, least=1), x) == y.astype(bool)).all()


def test_extract_keeps_rows_and_other_columns(spark):
    rows = [(1, "u", None, "z"), (2, "u", "<article><p>a</p></article>", "z"), (2, "u", "<article><p>a</p></article>", "z"), (3, None, "x" * 200_000, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, len(r.text)) for r in got)[:3] == [(1, 0), (2, 1), (2, 1)] and len(got) == 4
    assert html.extract(spark.createDataFrame(rows[:0], "page_id long, url string, html string, text string")).count() == 0


def test_pages_against_their_articles(spark, sf_dir):
    import html as entities
    import re

    for r in html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        body = r.html[r.html.find("<article>") :].split("</article>")[0]
        lines = [" ".join(entities.unescape(s).split()) for s in re.sub(r"<[^>]*>?", "", re.sub(r"<(/?)(p|h1|br|article)>", "\n", body)).split("\n")]
        assert r.text == "\n".join(s for s in lines if s)


@pytest.mark.parametrize("k", [1, 3, 64, 1000])
def test_lists_are_found_by_the_graph_at_every_size(monkeypatch, k):
    rng = np.random.default_rng(k)
    index = vectors.Lists(rng.normal(size=(k, 24)))
    searches = []
    search = vectors.Lists.search
    monkeypatch.setattr(vectors.Lists, "search", lambda *a: searches.append(1) or search(*a))
    hit = want = 0
    for x in rng.normal(size=(40, 24)):
        far = np.sqrt(((index.centroids - x) ** 2).sum(1))
        true = set(np.argsort(far, kind="stable")[:16].tolist()) | set(np.flatnonzero(far <= 1.1 * far.min()).tolist())
        found = index.near(x, 16, 0.1)
        assert len(found) == len(set(found)) == len([s for i, s in enumerate(found) if i < 16 or far[s] <= 1.1 * far[found[0]]])
        hit, want = hit + len(true & set(found)), want + len(true)
    assert len(searches) >= 40 and hit >= 0.97 * want


_STORY = "<p>" + "The river was high this morning and the farmers had to move their carts over the old bridge near the town. " * 2 + "</p>"


@pytest.mark.parametrize(
    ("inside", "after", "absent"),
    [
        ("", "".join(f"<a href='/{i}'><h3>Some other story {i}</h3><p>Read what happened in town {i} this week</p></a>" for i in range(4)), "other story"),
        ("<section class='user-comments'><p>Anna: I think this is a very good story about the river.</p></section>", "", "Anna"),
        ("<div class='ad-slot'>Buy the new boat now, only this week in all good stores near you</div>", "", "boat"),
        (f"<div class='{'x' * 70} sponsored'>Buy the new boat now, only this week in all good stores near you</div>", "", "boat"),
        ("<p hidden>secret words that nobody sees here</p>", "", "secret"),
        ("<div style='color: red; display: none'><p>secret words that nobody sees</p></div>", "", "secret"),
    ],
)
def test_what_is_not_the_article_goes(inside, after, absent):
    page = f"<body><div><a href='/'>Home</a> <a href='/a'>About us</a></div><article><h1>A long night by the river</h1>{_STORY * 4}{inside}</article><div>{after}</div></body>"
    text = html.main_text(page, html.tree())
    assert absent not in text and text.count("The river was high") == 8


def test_links_of_a_text_stay_its_own():
    of = lambda page: [b[1][:2] for b in html.blocks(page)]
    assert of("<p>one <a href='/'>two</a> three</p><p>four</p>") == [(3, 1), (1, 0)]
    assert of("<a href='/'><h3>one two</h3><p>three</p></a><p>four</p>") == [(2, 2), (1, 1), (1, 0)]
    assert of("<div><a href='/'>one<p>two</p></div><p>three</p>") == [(1, 1), (1, 0), (1, 0)]  # never closed, with words of its own
    assert of("<div><a href='/'><p>one</p></div><p>two</p>") == [(1, 1), (1, 0)]  # never closed, around blocks: ends with the div
    assert of("<a name='top'><p>one two</p>") == [(2, 0)]
