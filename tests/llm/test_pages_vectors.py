"""HTML text, embeddings, and the pipeline as a whole."""

import collections
import itertools

import numpy as np
from pyspark.sql import types as T

from utilnet.llm import html, vectors


def test_layout():
    page = """<title>no</title><style>.x, #y{display:none} .z{color:red}</style><body><h1>Head  line</h1>one <b>two</b>
three<p>para<br>next<div hidden>gone</div><div class=x>gone</div><i id=y>gone</i><ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=9><li>n<li>m</ol>
<table><caption>Cap<tr><th>Name<th>Value<tr><td>long name<td>1<br>2<tr><td colspan=2>a wide cell over both<tr><td>x<td>y</table>
<pre>  keep
    this</pre>a<blockquote>said</blockquote><span style="visibility:hidden">no<i style="visibility:visible">yes</i></span> end&amp;&copy;</p></p>tail
<script>var a="</p>"</script><details><summary>S</summary>hid</details><dl><dt>t<dd>d</dl>"""
    assert html.render(page) == """Head line

one two three

para
next

- a
- b
  - c
- d

 9. n
10. m

Cap
Name       Value
long name  1
           2
a wide cell over both
x          y

  keep
    this

a

    said

yes end&©

tail
S

t
    d""".replace(" 9. n", "9. n")


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "<div>" * 50_000 + "deep"), (3, "u", "<div>" * 50_000 + "deep"),
            (4, "u", "<table><tr><td>" * 300 + "cell"), (5, "u", "a</td></li></p>b<table><td>lone"), (6, "u", "&#0;&bogus;<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS text")
    got = html.extract(pages).collect()
    assert collections.Counter((r.page_id, r.url) for r in got) == collections.Counter((i, u) for i, u, _ in rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == "" and text[3] == "deep" and "cell" in text[4] and "lone" in text[5]
    assert html.extract(pages.limit(0)).count() == 0


def test_only_sheets_of_the_screen_hide_and_later_rules_show():
    page = "<style{}>{}</style><p class='nav x' id=i>menu</p><table><tr><td>cell</table><div class=box><p class=nav>deep</p></div>"
    def seen(css, media=""):
        return html.render(page.format(media, css)).split()
    every = ["menu", "cell", "deep"]
    assert seen("@media print { .nav {display:none} table{display:none} }") == every
    assert seen("@media (max-width: 600px) { .nav {display:none} } @supports (display:grid) { @media all { p{display:none} } }") == every
    assert seen(".nav{display:none}", " media=print") == every
    assert seen("/* .nav{display:none} */ p::after{content:'} .nav{display:none}'}") == every
    assert seen(".nav{display:none} .nav{display:block}") == every and seen("p{display:none} #i{color:red} p{display:inline}") == every
    assert seen(".nav{display:none} p{display:block}") == ["cell"] and seen("p{display:none} #i{display:block}") == ["menu", "cell"]
    assert seen("p{display:none!important} #i{display:block}") == ["cell"]
    assert seen("@media screen{.nav{display:none}} @import 'x'; .box>.nav{display:block}") == ["cell", "deep"]
    assert seen("div .nav{display:none") == ["menu", "cell"] and seen(".y .nav, table > .nav{display:none}") == every
    assert html.render("<noscript><style>p{display:none}</style></noscript><p style='display:none;display:block'>a</p>") == "a"
    assert html.render("<p class=a>x</p><p class=b>y</p><style media='screen, print'>.a{display:none}</style>") == "y"


def test_drawings_formulas_and_fallbacks_are_read():
    assert html.render("<svg><title>t</title><defs/><path d='M0'/><desc>d</desc><g> raw <text>Jan</text><text><tspan x=1>Feb</tspan>"
                       "<tspan x=2>Mar</tspan></text></g><style>q{}</style></svg><p>after</p>").split() == ["Jan", "Feb", "Mar", "after"]
    assert html.render("a <math><mfrac><mi>x</mi><mn>2</mn></mfrac><mo>+</mo><mspace/><mi>y</mi></math> b") == "a x 2+y b"
    assert html.render("<object data=x.swf><p>no player</p></object>") == "no player"


def cosine(a, b):
    a, b = a / abs(a).max(), b / abs(b).max()
    return (a @ b) / np.sqrt((a @ a) * (b @ b))


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []

    def add(v):
        rows.append((len(rows) * 7 % 1009, v))

    for _ in range(15):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            add((centre + rng.normal(size=16) * rng.choice([.05, .2, .3])).tolist())
    for _ in range(100):
        add(rng.normal(size=16).tolist())
    for _ in range(5):
        add([1.0] * 16)
        add([2.0] * 16)
    for v in (None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8, [], [float("inf")] * 16, [1e300] * 16, [3.0]):
        add(v)
    table = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    table = table.selectExpr("*", "'x' AS node", "1 AS copies", "2 AS label")
    good = [(i, np.array(v)) for i, v in rows if v and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    linked = collections.defaultdict(set)
    for x, (i, a) in enumerate(good):
        for j, b in good[:x]:
            if len(a) == len(b) and cosine(a, b) >= 0.95:
                linked[i].add(j)
                linked[j].add(i)
    low = {}
    for i, _ in sorted(rows, key=lambda r: r[0]):
        todo = [] if i in low else [i]
        low.setdefault(i, i)
        while todo:
            for j in linked[todo.pop()]:
                if j not in low:
                    low[j] = low[i]
                    todo.append(j)
    monkeypatch.setattr(vectors, "TILE", 40)
    got = sorted(tuple(r) for r in vectors.near_duplicates(table).collect())
    assert got == sorted((i, len(linked[i]), low[i], low[i] == i) for i, _ in rows)
    assert vectors.near_duplicates(table.limit(0)).count() == 0
    nobody = table.selectExpr("CAST(NULL AS LONG) AS vec_id", "embedding").limit(30)
    assert vectors.near_duplicates(nobody).filter("component_id IS NULL AND kept").count() == 30


def test_vectors_at_cell_and_budget_edges(spark, monkeypatch):
    """Pairs whose gap on an axis is just within or just over a subspace's budget, beside the edges of its cells."""
    rng = np.random.default_rng(11)
    dim, blocks = 16, vectors.BLOCKS
    budget = (2 - 2 * vectors.THRESHOLD) / blocks
    sides = [2 * np.sqrt(budget), 2 * (np.sqrt(budget) + 1e-5), 2 * (np.sqrt(budget + vectors.SLACK) + vectors.ROUNDING)]
    rows = []
    extra = (-1e-5, 0, 2e-6, 6e-6, 9.9e-6, 1.2e-5)
    beside = (-2e-5, -5e-6, -1e-9, 1e-9, 5e-6, 2e-5)
    for axis, side, more, off, up in itertools.product((0, 1, blocks), sides, extra, beside, (True, False)):
        gap = np.sqrt(budget + more)
        edge = side * rng.integers(-1, 2) + off
        low, high = (edge, edge + gap) if up else (edge - gap, edge)
        rest = rng.normal(size=dim)
        rest[axis] = 0
        for value in (low, high):
            v = rest / np.linalg.norm(rest) * np.sqrt(1 - value * value)
            v[axis] = value
            rows.append((len(rows), v.tolist()))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= vectors.THRESHOLD).sum(axis=1) - 1
    monkeypatch.setattr(vectors, "_axes", lambda found, size: (np.zeros(size), np.eye(size)))
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == links.tolist()
    assert links.sum() >= len(rows)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline
    words = "der die das und nicht ein eine mit von zu".split(), "the and of to in is that for with was".split()
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(rng.choice(words[k % 2]) + str(rng.integers(99)) for _ in range(80)), ("de", "en")[k % 2], "s", 1) for k in range(40)]
    rows += [(50, rows[3][1], "en", "s", 1), (51, "12345 !!", "en", "s", 1), (52, None, None, None, None), (None, rows[4][1], "de", "s", 1),
             (53, rows[5][1] + " x " + rows[7][1], "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs.selectExpr("*", "1 AS row_key", "'x' AS spans")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "tokens":
            assert now.columns == corpus_pipeline.COLUMNS
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left.append({r.doc_id for r in now.collect()})
    every = set(range(40))
    assert left[0] == every | {50, 53, None} and left[1] == every | {53} and left[2] == left[1]
    assert left[3] == left[1] - {9}
    assert now.count() == len(left[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left[3])
