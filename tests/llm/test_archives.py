"""WARC files: what is written is read back, whatever payloads hold; and the pipeline from end to end."""

import random

import duckdb

import corpus_pipeline
from lodestone.llm import warc
from lodestone.llm.common import Scratch, table


def test_magic_inside_payloads(spark, tmp_path):
    rng = random.Random(2)
    whole = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = []
    for i in range(80):
        html = "é" * rng.randint(0, 300) + (whole if i % 5 == 0 else "") + (warc.MAGIC if i % 11 == 0 else "") + "z" * rng.randint(0, 50)
        rows.append((i, None if i % 9 == 0 else f"http://x/{i}\n", None if i % 7 == 0 else html if i % 3 else "same"))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # records across splits
    try:
        got = {tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall())


def test_pipeline(spark):
    """Each stage's decisions against what they must be on its own input."""
    base = "/root/testdata/sf0.001"
    scratch, docs, seen = Scratch(spark, "test"), table(spark, base, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        docs = scratch.settle(stage(spark, docs, base), f"s{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    # near copies: one document of each class
    from tests.llm.test_texts import classes

    assert set(seen[2]) == {d for d, (_, c) in classes(list(seen[1].items())).items() if d == c}
    # leaks: nothing that is left holds an item whole
    items = [r.text for r in table(spark, base, "benchmark").collect()]
    assert not any(i in t for i in items for d, t in seen[4].items() if t)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.default_model())
    coded = {r.doc_id: r.ids for r in docs.collect()}
    assert coded == {d: library.encode(t or "", add_eos=True) for d, t in seen[4].items()}


def test_no_pages_and_odd_ones(spark, tmp_path):
    rows = [(None, "http://x", "same"), (1, None, "same"), (1, None, "same"), (2, "u", None), (3, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS payload", "'clash' AS digest", "'clash' AS id")
    for name, one in (("odd", df), ("none", df.limit(0))):
        one.write.parquet(str(tmp_path / name / "pages.parquet"))
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op7_warc(spark, str(tmp_path / name)).collect()), key=str)
        want = [(1, 4, "response", None), (1, 4, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None), (None, 4, "response", None)]
        assert got == (sorted(want, key=str) if name == "odd" else [])


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Rows without text or id, repeats, and no rows at all."""
    labels = [(k, k % 2, 0) for k in range(12)]
    good, bad = "Plain words of a quiet text, one after the other. ", "#### {{}} !!! "
    rows = [(k, (good if k % 2 else bad) * 3 + f"number {k}", "en", "s", 1) for k in range(12)]
    rows += [(None, good * 3 + "nameless", "en", "s", 1), (20, None, None, None, None), (21, good * 3 + "twice", "en", "s", 1), (21, good * 3 + "twice", "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("none", [])):
        base = str(tmp_path / name)
        spark.createDataFrame(some, kinds).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([(1, "nothing that stands in any of them at all")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, base).collect()]
        assert got.count(21) == (1 if some else 0) and got.count(None) == (1 if some else 0)
        assert not {0, 2, 4, 6, 8, 10} & set(got) and len(got) == len(set(got))
