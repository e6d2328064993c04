"""Pages and vectors, and the pipeline."""

import html
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import permutation_index as ix
from loomgraph.llm import site_tree as st


def text_of(page, noise=frozenset()):
    root = st.parse(page)
    st.number(root)
    return st.main_text(root, noise)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header class="site"><a href="/">Logo</a></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 line<br>goes on.<p>Second&nbsp;&mdash; one<div class="ad">Buy</div><ul><li>a<li>b</ul><form>Sign</form><aside>Side</aside></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></main><div class="sidebar">x</div><footer>&copy; y</footer></body></html>"""


def test_article_only():
    assert text_of(PAGE) == "Title & more\nFirst bold line goes on.\nSecond — one\na\nb"


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("<p>a</div>b</p>c", "ab\nc"), ("<b><p>x</b>y</p>", "x\ny"), ("a<!-- no -->b", "ab"), ("<script>x</script>y", "y"), ("<p>1 < 2 &lt; 3", "1 < 2 < 3"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<P CLASS=ad>x</P><P>y", "y"), ("<div hidden>x</div>y", "y"), ("<textarea><p>q</textarea>z", "z"), ("<p title='a>b'>t</p>", "t"), ("<p", ""), ("<pre>a\n  b</pre>", "a b"), ("&amp;lt; &#x41;&#66;", "&lt; AB"),
    ],
)
def test_parsing(page, want):
    assert text_of(page) == want


def test_deep_pages_do_not_recurse():
    assert text_of("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><header>" + "<div>" * 50_000 + "<h1>t</h1>x", "t\nx"), ("<article>" + "<div class='share-price'>" * 30_000 + "x", "x"), ("<div class='sidebar'>" * 30_000 + "<article>x", "x"),
        ("<p>" + "<div>" * 30_000 + "x", "x"), ("<b>" * 30_000 + "</i>" * 30_000 + "x", "x"), ("<table><tr><td>" * 10_000 + "x", "x"), ("<head>" + "<noscript>" * 10_000 + "</noscript>" * 10_000 + "<p>x", "x"),
    ],
)
def test_deep_pages_take_linear_time(page, want):
    import time

    began = time.time()
    assert text_of(page) == want
    assert time.time() - began < 3


@pytest.mark.parametrize("attribute", ["class='legal'", "class='social history'", "class='share-price-analysis'", "id='toc-free notice'", "class='review-of-reviews-past'"])
def test_names_that_may_be_topics_stay_in_articles(attribute):
    assert text_of(f"<main><article><h1>T</h1><div {attribute}><p>Prose.</p></div><p>End</p></article></main>") == "T\nProse.\nEnd"


@pytest.mark.parametrize("attribute", ["class='ad'", "class='ad-slot top'", "class='newsletter'", "class='cookie-notice'", "id='comments'", "class='commentList'", "class='sidebar-left'", "role='navigation'"])
def test_names_that_are_roles_go_from_articles(attribute):
    assert text_of(f"<article><h1>T</h1><div {attribute}><p>Prose.</p></div><p>End</p></article>") == "T\nEnd"


def test_an_article_named_for_its_topic_is_one():
    assert text_of("<main><article class='film-reviews'><h1>F</h1><p>Text</p></article></main>") == "F\nText"


def slow_tree(pages):
    """Pages, presentation and content importance by node, with dictionaries."""
    style, feature, parent = {}, {}, {}
    for page in set(pages):
        root = st.parse(page)
        seen = set()
        for n in st.number(root):
            parent[n.path] = n.parent.path if n.parent is not None else 0
            kids = tuple(c.tag for c in n.children if isinstance(c, st.Node) and c.tag not in ("br", "script", "style"))
            own = " ".join("".join(c if isinstance(c, str) else " " for c in n.children).split())
            seen |= {(n.path, "s", kids)} | ({(n.path, "f", own)} if own and n.tag not in st.NO_TEXT else set())
        for node, kind, value in seen:
            of = (style if kind == "s" else feature).setdefault(node, Counter())
            of[value] += 1
    out = {}
    for node, c in style.items():
        m, f = sum(c.values()), feature.get(node, Counter())
        log = lambda k: np.log(k) / np.log(m)  # noqa: B023, E731
        spread = -sum(k / m * log(k / m) for k in c.values()) if m > 1 else 1.0
        content = None if not f else 1.0 if m == 1 else max(0.0, 1 - sum(k * log(k) for k in f.values()) / sum(f.values()))
        out[node] = (parent[node], m, spread, content)
    return out


def test_style_tree_is_that_of_dictionaries(spark):
    real = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(25).collect()]
    made = [f"<body><div class='a'><p>same</p></div><div class='b'>{'<p>x</p>' * (i % 3)}<i>{i % 4}</i></div></body>" for i in range(12)]
    pages = real + made + [made[0]] * 5
    rows = spark.createDataFrame([(i, "http://h.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["node"]: (r["parent"], r["pages"], r["presentation"], r["content"]) for r in st.style_tree(rows).collect()}
    want = slow_tree(pages)
    assert set(got) == set(want)
    for node, (parent, m, spread, content) in want.items():
        assert got[node][:2] == (parent, m) and abs(got[node][2] - spread) < 1e-6
        assert (got[node][3] is None) == (content is None) and (content is None or abs(got[node][3] - content) < 1e-6)


def test_the_tree_decides_what_a_name_leaves_open(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    box = lambda i: f"<div class='social'><p>{'our pages' if i % 2 else 'follow us'}</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<body><article><h1>title {i}</h1><p>story {word(i)}</p>{box(i)}</article></body>") for i in range(30)]
    rows += [(100 + i, f"http://o.example/{i}", f"<body><article><h1>title {i}</h1><div class='social'><p>on society {word(i)}</p></div></article></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in st.extract(df).collect()}
    assert all(got[i] == f"title {i}\nstory {word(i)}" and got[100 + i] == f"title {i}\non society {word(i)}" for i in range(30))
    off = {r["page_id"]: r["text"] for r in st.extract(df, least_pages=1000).collect()}
    assert "us" in off[0] and off[100] == got[100]


def test_repeated_branches_go_where_nothing_marks_them(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='box{i}'><p>promise of the house</p></div><div class='story'><p>story {i} of many words {i * 7}</p><p>and its end {i}</p></div></body>") for i in range(30)]
    rows += [(100, "http://one.example/", "<body><div class='box'><p>promise of the house</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} of many words {i * 7}\nand its end {i}" for i in range(30))
    assert got[100] == "promise of the house"


def test_copies_of_an_article_are_kept(spark):
    rows = [(i, "http://h.example/x", "<body><nav>m</nav><article><p>the same words</p></article></body>") for i in range(40)]
    got = st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"the same words"}


def test_repeated_branches_go_from_articles(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    notice, plain = "<div class='kasten'><p>send us your mail</p></div>", "<p class='hint'>all our days</p>"
    rows = [(i, f"http://h.example/{i}", f"<body><article><h1>title {i}</h1><p>story {word(i)}</p>{notice}<div class='part'><p>end {i}</p></div>{plain}</article></body>") for i in range(30)]
    # copies of one page, and few pages of their own beside them
    copy = "<body><article><h1>one</h1><div class='body'><p>the same words</p></div></article></body>"
    rows += [(100 + i, "http://c.example/x", copy) for i in range(40)]
    rows += [(200 + i, f"http://c.example/{i}", copy.replace("one", f"other {i}").replace("the same", f"own {i}")) for i in range(10)]
    # the same text under different titles
    rows += [(300 + i, f"http://t.example/{i}", copy.replace("one", f"title {i}")) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"title {i}\nstory {word(i)}\nend {i}" for i in range(30))
    assert all(got[100 + i] == "one\nthe same words" for i in range(40))
    assert all(got[200 + i] == f"other {i}\nown {i} words" for i in range(10))
    assert all(got[300 + i] == f"title {i}\nthe same words" for i in range(20))


def test_hard_pages(spark):
    schema = "page_id long, url string, html string, host string, text string, noise string"
    rows = [(1, None, None, "a", "b", "c"), (None, "nonsense", "<p>x", "a", "b", "c"), (2, "http://h/", "", "a", "b", "c"), (2, "http://h/", "", "a", "b", "c"), (3, "HTTP://H/", "<p>" + "long words " * 50_000, "a", "b", "c")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r["page_id"] or 0, r["text"][:5], r["n_chars"]) for r in st.extract(df).collect()))
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0), (3, "long ", 11 * 50_000 - 1)]
    assert st.extract(df.limit(0)).collect() == []


def test_real_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in st.extract(pages).collect()}
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


def test_importance():
    nodes = [(1, 0, 10, 0.0, None, False), (2, 1, 10, 0.0, 0.0, False), (3, 1, 10, 0.9, 1.0, False), (4, 1, 10, 0.0, None, False), (5, 4, 10, 0.0, 0.0, True)]
    worth = st.importance(nodes)
    assert worth[2] == 0 and worth[3] == 1 and 0 < worth[1] < 1 and worth[5] == 1
    sure = lambda found: [n for n in found if n >= 0]
    assert sure(st.noisy(nodes, 8, 0.25)) == [2] and st.noisy(nodes, 20, 0.25) == []
    assert ~3 not in st.noisy(nodes, 8, 0.25) and ~1 in st.noisy(nodes, 8, 0.25)


def test_rare_children_protect_their_parent(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, "http://h.example/x", f"<body><div class='wrap'><div class='lead'>the same line</div><div class='post{word(i)}'>text {i}</div></div></body>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" for i in range(40)}


# -- vectors ------------------------------------------------------------------


def exact(vectors, query, k=10):
    q = dict(vectors)[query]
    d = [(float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in vectors if i != query]
    return sorted(d)[:k]


def ranked(got):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    return {q: sorted(rs, key=lambda r: r["rank"]) for q, rs in by.items()}


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = [(r["vec_id"], [float(np.float32(x)) for x in r["embedding"]]) for r in rows.collect()]
    hit = total = 0
    for q, mine in ranked(ix.search(rows, rows.filter("vec_id % 100 = 0")).collect()).items():
        want = exact(own, q)
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        dist = {i: d for d, i in exact(own, q, len(own))}
        assert all(abs(r["score"] - dist[r["vec_id"]]) < 1e-12 for r in mine)
        hit += len({i for _, i in want} & {r["vec_id"] for r in mine})
        total += 10
    assert hit / total >= 0.9


@pytest.mark.parametrize("n", [2_000, 40_000])
def test_recall_holds_while_a_smaller_share_is_ranked_again(spark, n, monkeypatch):
    """Vectors without any structure, which is the hardest case."""
    monkeypatch.setattr(ix, "SEGMENT", 8192)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[8] = x[100]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ranked(ix.search(rows, rows.filter("vec_id % 500 = 100")).collect())
    assert sorted(got) == list(range(100, n, 500))
    hit = 0
    for q, mine in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = 9
        hit += len(set(np.lexsort((np.arange(n), d))[:10].tolist()) & {r["vec_id"] for r in mine})
    assert hit / (10 * len(got)) >= 0.92
    assert [r["vec_id"] for r in got[100]][:2] == [7, 8]


def test_many_copies_of_a_vector_are_found(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.5] if i % 3 else [float(i), 1.0]) for i in range(3000)], "vec_id long, embedding array<double>")
    got = ranked(ix.search(rows, rows.filter("vec_id in (100, 200)")).collect())
    assert all([r["vec_id"] for r in rs] == [i for i in range(20) if i % 3 and i != q][:10] and rs[-1]["score"] == 0 for q, rs in got.items())


def test_hard_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [nan, 1.0], "x"), (4, [None, 1.0], "x"), (5, [1.0, 0.0], "x"), (6, [0.0, 1.0], "x"), (7, [1.0, 2.0, 3.0], "x"), (100, [0.0, 2.0], "x"), (100, [0.0, 2.0], "x"), (None, [1.0, 1.0], "x"), (8, [float("inf"), 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ix.search(df, df.filter("vec_id % 100 = 0")).collect()]
    r2, r5 = 2**0.5, 5**0.5
    assert sorted(got) == [(0, 1, 5, 0.0), (0, 2, 6, r2), (0, 3, 100, r5), (0, 4, 100, r5), (100, 1, 6, 1.0), (100, 2, 0, r5), (100, 3, 5, r5)]
    assert ix.search(df.limit(0), df.limit(0)).collect() == []


def test_footrule():
    rng = np.random.default_rng(0)
    x, pivots, prefix = rng.normal(size=(50, 4)), rng.normal(size=(12, 4)), 5
    order = ix.prefixes(x, pivots, prefix)
    place = np.full((50, 12), prefix)
    for i, o in enumerate(order):
        assert o.tolist() == np.argsort(((pivots - x[i]) ** 2).sum(1), kind="stable")[:prefix].tolist()
        place[i, o] = np.arange(prefix)
    gain = ix.gains(order[0], *ix.inverted(order, 12), 50)
    assert np.array_equal(prefix * (prefix + 1) - gain, np.abs(place - place[0]).sum(1))
    near = ix.least(gain, 7)
    assert len(near) >= 7 and gain[near].min() > np.delete(gain, near).max()


# -- the pipeline -------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, sf)
        assert kept.columns == docs.columns, name
        ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
        assert not ids - Counter(r["doc_id"] for r in before.select("doc_id").collect())
    last = cp.run(spark, sf).collect()
    assert Counter({r["doc_id"] for r in last}) == Counter(ids)
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_queries_have_their_columns(spark, sf):
    from loomgraph.llm.queries import QUERIES

    want = {
        "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2": "page_id url text n_chars", "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op4": "doc_id size text_crc32 law shard slot grown_shard", "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6": "doc_id n_bytes n_tokens ids_crc32 text_crc32", "op7": "query_id rank vec_id score", "op8": "doc_id fingerprint component_id",
        "op9": "doc_id n_bytes n_tokens over_limit", "op10": "doc_id held_out lang_pred score",
    }
    for name, q in QUERIES.items():
        df = q(spark, sf)
        assert set(want[name.split("_")[0]].split()) <= set(df.columns)
        assert df.count() > 0 or name.startswith("op7")
