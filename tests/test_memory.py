"""What a task holds in memory stays bounded, whatever the sizes of its batches."""

import base64
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import bpe
from lodestone.index import clusters, shared, trigrams
from lodestone.operators import graph, search
from lodestone.streaming import mirror


def peak_mb(work) -> tuple[float, list]:
    tracemalloc.start()
    try:
        out = list(work())
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def vectors(n: int, d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, d))


def listed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def test_scores_of_a_batch_are_cut():
    rows, asked = vectors(10_000, 8, 1), vectors(1_024, 8, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), listed(rows)], names=["id", "v"])
    run = search._block_scores(SimpleNamespace(value=(np.arange(1_024) + 20_000, asked)), 5, unit=False)
    peak, out = peak_mb(lambda: run(iter([batch])))
    assert peak < 60
    q, i = (np.concatenate([b.column(c).to_numpy() for b in out]) for c in range(2))
    best = np.argsort(-(asked @ rows.T), axis=1)[:, :5]
    found = set(zip(q.tolist(), i.tolist(), strict=True))
    assert all((n + 20_000, r) in found for n in range(1_024) for r in best[n].tolist())


def test_a_mirror_is_not_broadcast(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", i, float(i)) for i in range(20)], "k string, n long, v double")
    table = mirror.mirror(spark, str(tmp_path / "mirror"))
    mirror.apply(table, mirror.changes(rows.where("n < 15"), "k", "n", ["v"]))
    late = mirror.changes(rows.where("n >= 10").withColumn("n", F.when(F.col("n") < 12, 5).otherwise(F.col("n"))), "k", "n", ["v"])
    news = mirror.news(table, late)
    assert "Broadcast" not in news._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.key for r in news.collect()) == [f"u{i}" for i in range(15, 20)]


@pytest.mark.parametrize("kept", [0, 3, 200_000])
def test_pieces_are_encoded_where_they_are_read(spark, tmp_path, monkeypatch, kept):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % n for n, t in enumerate([*(bytes([x]) for x in range(256)), b"ab", b" ab", b"aba"])))
    lists = [["ab", " ab", "abab"], None, [], ["é", "ab"], ["aba"]] * 200
    monkeypatch.setattr(bpe, "FEW_PIECES", kept)
    known = bpe.ranks(str(path))
    got = bpe.Pieces(known).encoded(pa.array(lists, pa.list_(pa.string())).slice(1)).to_pylist()
    assert got == [[i for p in x or [] for i in bpe.merged(p.encode(), known)] for x in lists[1:]]
    if kept == 3:
        docs = spark.createDataFrame([(n, "ab ab" * n) for n in range(5)] + [(9, None)], "doc_id long, text string")
        plan = bpe.windows(docs, str(path), 4, 1)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in plan.collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("few", [0, 100_000])
def test_a_level_is_written_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(graph, "shared_folder", lambda *_: str(tmp_path))
    monkeypatch.setattr(graph, "if_few", lambda df: shared.if_few(df, few))
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("b", "c", "x"), ("b", "a", "x"), ("c", "d", "x"), (None, "d", "x")], "source string, target string, kind string")
    found = graph.traverse(edges, spark.createDataFrame([("a",), (None,)], "seed string"), 2)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["seen"]


def test_visits_of_a_batch_are_cut():
    cells = [{"centre": m, "cell": c, "n": 20, "lo": c / 10, "hi": c / 10 + 0.1} for m in range(100) for c in range(8, 16)]
    unit = vectors(100, 8, 1)
    bounds = clusters.Bounds(unit / np.linalg.norm(unit, axis=1)[:, None], cells)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3_000)), listed(vectors(3_000, 8, 2)), pa.array(np.full(3_000, 2.0))], names=["qid", "q", "limit"])
    run = clusters._visited(bounds, 5, 8, True)
    peak, out = peak_mb(lambda: (len(b) and b.column(3).flatten().to_pylist() and b.num_rows for b in run(iter([batch]))))
    assert peak < 60 and max(out) <= clusters.GIVEN_ROWS
    first = clusters._visited(bounds, 5, 8, False)
    met = sum(len(b.column(3).flatten()) for f in (run, first) for b in f(iter([batch])))
    assert met == 3_000 * len(cells)  # with the widest limit each cell is visited, and once


def test_runs_of_a_batch_are_cut():
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 1_000, 1_500))) for _ in range(1_500)] + ["", "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], names=["place", "text"])
    peak, sizes = peak_mb(lambda: (b.num_rows for b in trigrams._rows_of_runs(iter([batch]))))
    assert peak < 60 and len(sizes) > 1
    rows: dict = {}
    for b in trigrams._rows_of_runs(iter([batch])):
        for run, block, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows[run, block] = rows.get((run, block), 0) | bits & (1 << 64) - 1
    for n in (0, 70, 1_499):
        assert all(rows[run, n >> 6] >> (n & 63) & 1 for run in trigrams.runs_of(texts[n]).tolist())
    assert sum(bits.bit_count() for bits in rows.values()) == sum(len(trigrams.runs_of(t)) for t in texts)
