"""As-of joins, sketches, pages as trees, external search and single writes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markup
from lodestone.operators import asof, evaluation
from lodestone.sources import search_source, sink

FOUND = "module_for_tests"


@pytest.mark.parametrize("width", [1.0, 7.0, 1e9])
def test_last_mark_before(spark, width):
    rng = random.Random(1)
    marks = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-30, 60)]), rng.choice([None, "x", "y", "z"]), n) for n in range(60)] + [("hot", k, f"h{k}", k) for k in range(0, 300, 3)]
    points = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randint(-40, 90)]), f"p{n}") for n in range(80)] + [("hot", k, f"q{k}") for k in range(0, 320)]
    m = spark.createDataFrame(marks, "k string, at int, v string, n int")
    p = spark.createDataFrame(points, "k string, at int, name string")
    want = []
    for k, at, name in points:
        known = [(a, n, v) for key, a, v, n in marks if key == k and a is not None and at is not None and a <= at]
        want.append((k, at, name, max(known, key=lambda x: x[:2])[2] if known else None))
    got = asof.as_of(p, m, ["k"], "at", ["v"], width, ties=["n"]).select("k", "at", "name", "v").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert asof.as_of(p, m.limit(0), ["k"], "at", ["v"], width).where("v IS NOT NULL").count() == 0
    assert asof.as_of(p.limit(0), m, ["k"], "at", ["v"], width).count() == 0


def test_sketches_merge(spark):
    rng, k = random.Random(2), 400
    values = [("a", rng.randrange(4), rng.gauss(0, 1) ** 3) for _ in range(40_000)] + [("b", 0, 5.0)] * 50 + [("c", 1, None), ("d", 1, float("nan")), ("d", 2, 1.0)]
    df = spark.createDataFrame(values, "g string, part int, ms double")
    parts = evaluation.latency_sketch(df, ["g", "part"], k=k)
    got = {r.g: r for r in evaluation.sketch_percentiles(evaluation.merged_sketches(parts, ["g"]), {"p05": 0.05, "p50": 0.5, "p99": 0.99}).collect()}
    assert got.keys() == {"a", "b", "d"} and got["b"].p50 == 5.0 and (got["d"].calls, got["d"].p99) == (1, 1.0)
    own = sorted(v for g, _, v in values if g == "a")
    for share, name in ((0.05, "p05"), (0.5, "p50"), (0.99, "p99")):
        rank = sum(v <= got["a"][name] for v in own) / len(own)
        assert abs(rank - share) <= 2 * evaluation.rank_error(k)


PAGES = [
    ("<p>one<p>two", "one\ntwo"),
    ("<title> A &amp; B\n c</title><h2>He<b>ad</b></h2>text <i>more</b></i> end", "## Head\n\ntext more end"),
    ("<body><nav>no</nav><main><div>a<div>b</div>c</div></main><main>d</main></body>", "a\nb\nc\nd"),
    ("<article>x<script>var t='</p><p>';</script>y<style>p{}</style></article> rest", "xy"),
    ("<ul><li>1<ul><li>1.1<li>1.2</ul><li>2</ul>", "1\n1.1\n1.2\n2"),
    ("a < b and 3<4 <!-- <p> not --> <br>c<hr/>d", "a < b and 3<4\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "ab\nc"),
    ("<noscript><p>none</noscript><h1>T</h1>x</div></p></nothing>y<script>never ends", "# T\n\nxy"),
    ("<div><p>in<table><tr><td><p>cell</table>out</div>", "in\ncell\nout"),
    ("", ""),
    (None, ""),
    ("plain &lt;text&gt;", "plain <text>"),
]


def test_pages_as_trees(spark):
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAGES)], "id int, html string")
    got = {r.id: (r.t, r.title) for r in df.select("id", markup.main_markdown(F.col("html")).alias("t"), markup.title(F.col("html")).alias("title")).collect()}
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (_, t) in enumerate(PAGES)}
    assert got[1][1] == "A & B c" and got[0][1] == ""


def test_long_pages():
    n = 100_000
    assert markup.page_text("<div>" * n + "x" + "</div>" * n).strip() == "x"
    assert markup.page_text("<p>x" * n).count("x") == n
    assert markup.page_text("<" * n + "x") == "\n" + "<" * n + "x" or markup.page_text("<" * n + "x").endswith("<x")


def test_search_source(spark):
    search_source.register(spark)
    reader = lambda **o: spark.read.format("lodestone_search").options(client="lodestone.plans.joins:answer", queries=json.dumps([[1, "what"], [2, "seven.."], [3, "why so"]]), **o).load()
    rows = reader(top_k="2").collect()
    assert sorted((r.qid, r.rank, r.error) for r in rows if r.rank) == [(1, 1, None), (1, 2, None), (3, 1, None), (3, 2, None)]
    assert [(r.qid, r.error) for r in rows if not r.rank] == [(2, "down")]
    assert [(r.qid, r.rank) for r in reader().where("qid = 3 AND rank < 2").collect()] == [(3, 1)]
    r = search_source.SearchReader({"client": "x:y", "queries": "[[1, \"a\"], [2, \"b\"]]"})
    left = list(r.pushFilters([search_source.EqualTo(("qid",), 2), search_source.LessThan(("rank",), 3), search_source.EqualTo(("text",), "t")]))
    assert r.asked == [(2, "b")] and r.top_k == 2 and len(left) == 2


def test_chunks_are_worked_out_once(spark, tmp_path):
    path, log = str(tmp_path / "chunks"), tmp_path / "calls"

    def rows(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("x" * len(b))
            yield b

    schema = "chunk_text string, chunk_tokens int, doc_title string, doc_url string, doc_section string, chunk_index int, embedding array<float>"
    df = spark.createDataFrame([("t", 1, "d", "u", None, k, [0.5, 0.5]) for k in range(6)], schema)
    assert sink.write_chunks(df.mapInPandas(rows, schema), path, 2) == (6, 6)
    assert len(log.read_text()) == 6
    before = sink.read_chunks(spark, path)
    with pytest.raises(ValueError):
        sink.write_chunks(df.limit(2), path, 3)
    assert sink.count_rows(spark, path) == 6
    assert sink.write_chunks(df.limit(2), path, 2) == (2, 2) and before.count() == 6 and sink.count_rows(spark, path) == 2
    assert sink.write_chunks(df, path, 2, replace=False) == (6, 6) and sink.count_rows(spark, path) == 8
