"""The passes over sorted rows give the same whatever the batches they come in."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import jaccard_join, substring_dedup, suffix_dedup


def batches(rows, kinds, names, size):
    for start in range(0, len(rows), size):
        part = rows[start : start + size]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], k) for j, k in enumerate(kinds)], names=names)


def out_rows(it):
    return [tuple(r.values()) for b in it for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("seed", range(6))
def test_passes(size, seed):
    rng = random.Random(seed)
    i64, i32 = pa.int64(), pa.int32()

    rows = sorted((rng.randint(0, 12), rng.randint(0, 5)) for _ in range(60))
    kept = sorted(set(rows))
    want = [r for r in kept if sum(r[0] == q[0] for q in kept) > 1]
    assert out_rows(jaccard_join._shared(batches(rows, [i64, i64], ["gram", "node"], size))) == want

    rows = sorted((rng.randint(0, 12), rng.randint(0, 3), rng.randint(0, 4)) for _ in range(60))
    kept = sorted(set(rows))
    want = [r for r in kept if sum(r[0] == q[0] for q in kept) > 1]
    assert out_rows(suffix_dedup._repeated(batches(rows, [i64, i64, i32], ["hash", "doc", "first"], size))) == want

    want = sorted((d, p) for k, d, p in rows if len({q[1] for q in rows if q[0] == k}) > 1)
    assert sorted(out_rows(substring_dedup._in_several(batches(rows, [i64, i64, i32], ["key", "doc", "pos"], size)))) == want

    got = out_rows(substring_dedup._sources(batches(rows, [i64, i64, i32], ["key", "doc", "pos"], size)))
    edges, later = set(), set()
    for k in {r[0] for r in kept}:
        places = [(d, p) for q, d, p in kept if q == k]
        source = places[0]
        if len({d for d, _ in places}) > 1:
            x = lambda shift: int(np.bitwise_xor.reduce(substring_dedup._place(np.array([d for d, _ in places]), np.array([p + shift for _, p in places]))).view(np.int64))
            edges.add((*source, len(places), x(0), x(-1)))
            later |= {(*source, d, p) for d, p in places if d != source[0]}
    assert {r[:5] for r in got if r[2] is not None} == edges
    assert {(r[0], r[1], d, p) for r in got if r[5] for d, p in zip(r[5], r[6], strict=True)} == later

    rows = sorted((rng.randint(0, 6), rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 9), rng.randint(0, 4), 2) for _ in range(50))
    kept = sorted(set(rows))
    got = out_rows(suffix_dedup._sorted_out(batches(rows, [i64, i64, i64, i64, i32, i32], ["rank", "stretch", "half", "doc", "first", "n"], size)))
    want = sorted((d, f, n, 0) for r, s, h, d, f, n in kept if sum((r, s, h) == q[:3] for q in kept) > 1)
    for r in {q[0] for q in kept}:
        kinds = sorted({q[1:3] for q in kept if q[0] == r})
        if len(kinds) > 1:
            want += [(*next(q for q in kept if q[:3] == (r, *s))[3:], 1) for s in kinds]
    assert sorted(got) == sorted(want)


def test_hot_rows_of_one_document_are_spread():
    """A line that fills a document gives thousands of rows of one rank; those that are dealt out go to as many tasks as there are."""
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the same words " * 2000, "the same words " * 50])], names=["doc", "text"])
    leads = pa.Table.from_batches(suffix_dedup._leads(400, 16, 72, True)(iter([texts])))
    again = pa.Table.from_batches(suffix_dedup._salted(True)(iter(leads.select(["rank", "doc", "idx", "place"]).to_batches())))
    single = pa.array([[{"first": 0, "n": 2000}]], pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))
    strings = pa.Table.from_batches(suffix_dedup._strings(400, True)(iter([pa.RecordBatch.from_arrays([*(c.slice(0, 1) for c in texts.columns), single], names=["doc", "text", "held"])])))
    for rows, key in ((leads, "rank"), (again, "rank"), (strings, "hash")):
        dealt = [(r[key], r["salt"]) for r in rows.to_pylist() if r["salt"]]
        assert len(dealt) > 1000 and max(Counter(dealt).values()) <= 64
        assert 0 < rows.num_rows - len(dealt) <= 40
