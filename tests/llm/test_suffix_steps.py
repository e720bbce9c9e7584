"""What the steps of the removal of repeated byte strings pass on, and that results stay those of brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import common, suffix_dedup

LENGTH = 400


def removed(rows):
    """Removed bytes of each row by brute force; rows that repeat an id are one place each time they agree."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    places = collections.defaultdict(set)
    for d, r in raw:
        for i in range(len(r) - LENGTH + 1):
            places[r[i : i + LENGTH]].add((d, i))
    out = []
    for d, r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - LENGTH + 1):
            if len(places[r[i : i + LENGTH]]) > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        out.append((d, sum(gone)))
    return sorted(out)


def passages(shared, most, n, seed):
    """Texts around passages of ``most`` letters out of ``shared``, each at some place of its own."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    pool = [text(most) for _ in range(shared)]
    return [(i, text(rng.randint(200, 600)) + rng.choice(pool) + text(rng.randint(200, 600))) for i in range(n)]


@pytest.fixture
def settled(monkeypatch):
    """Rows and executed plan of each table that an operator writes."""
    seen, settle = {}, common.Scratch.settle

    def spy(self, df, name, *more):
        with common.held_conf(df.sparkSession, {common.AUTO_BROADCAST: "-1"}):
            plan = df._jdf.queryExecution().executedPlan().toString()
        out = settle(self, df, name, *more)
        seen[name] = (out.collect(), plan)
        return out

    monkeypatch.setattr(common.Scratch, "settle", spy)
    return seen


def test_passages_too_short_for_a_string_are_not_compared_by_strings(spark, settled):
    rows = passages(3, 300, 40, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(df).collect()) == removed(rows) == [(d, 0) for d, _ in rows]
    assert any(r for n, (r, _) in settled.items() if n.startswith("rank_"))  # ranks repeat,
    assert not settled["stretches"][0]  # cores do not


def test_ranks_are_sorted_by_one_number_and_doubled_without_a_join(spark, settled):
    rows = passages(3, 700, 30, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(df).collect()) == removed(rows)
    ranks = {n: plan for n, (_, plan) in settled.items() if n.startswith("rank_")}
    assert {"rank_0", "rank_8"} <= set(ranks) and "rank_4" not in ranks
    for plan in [*ranks.values(), settled["strings"][1].split("Join")[0]]:
        assert "Join" not in plan and all("," not in line.split("Sort [")[1].split("]")[0] for line in plan.splitlines() if "Sort [" in line)


@pytest.mark.parametrize("most", [380, 401, 455, 700])
def test_repeated_ids(spark, most):
    rng = random.Random(most)
    rows = passages(3, most, 25, 3)
    rows += [(d, t) for d, t in rows[:10]] + [(100, "ab" * 500), (101, "the same words " * 90), (102, "the same words " * 60), (103, rows[3][1] * 2)]
    rng.shuffle(rows)
    for some in (rows, list(dict(rows).items())):
        df = spark.createDataFrame(some, "doc_id long, text string")
        assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(df).collect()) == removed(some)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("seed", range(4))
def test_halves_of_one_hash_need_no_order(size, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.randint(0, 12), rng.randint(0, 4), rng.randint(0, 9), rng.randint(0, 9)) for _ in range(50)}, key=lambda r: (r[0], rng.random()))
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    names, kinds = ["hash", "half", "doc", "first"], [pa.int64()] * 3 + [pa.int32()]
    given = (pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*p, strict=True), kinds, strict=True)], names=names) for p in parts)
    got = [tuple(r.values()) for b in suffix_dedup._same_strings(given) for r in b.to_pylist()]
    assert sorted(got) == sorted(r for r in rows if sum(r[:2] == q[:2] for q in rows) > 1)


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_doubling_is_the_same_in_any_batches(size):
    rng = random.Random(size)
    rows = [(rng.randint(0, 5), d, i, (rng.randint(0, 1) * 80) << 8 | rng.choice([4, 5, 7, 8, 9])) for d in range(6) for i in rng.sample(range(200), 150)]
    copies = [(d * 10 + b, r, d, i, place, b) for r, d, i, place in rows for b in {i >> 6, max(i - 4, 0) >> 6}]
    copies.sort(key=lambda r: (r[0], rng.random()))
    parts = [copies[i : i + size] for i in range(0, len(copies), size)]
    names, kinds = ["part", "rank", "doc", "idx", "place", "block"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    given = (pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*p, strict=True), kinds, strict=True)], names=names) for p in parts)
    got = {(r["doc"], r["idx"]): r for b in suffix_dedup._doubled(4, False)(given) for r in b.to_pylist()}
    rank, want = {(d, i): r for r, d, i, _ in rows}, {}
    for r, d, i, place in rows:
        over = place & 255 < 8
        then = rank.get((d, i + ((place & 255) - 4 if over else 4)))
        if then is not None and (place >> 8 or not over):
            want[d, i] = (r, then, place & 255 if over else -4)
    assert set(got) == set(want) and all(got[k]["done"] == (want[k][2] > 0) for k in got)
    assert len({(got[k]["rank"], want[k]) for k in got}) == len(set(want.values())) == len({r["rank"] for r in got.values()})
    assert np.all([got[k]["place"] == next(r[3] for r in rows if r[1:3] == k) for k in got])


@pytest.mark.parametrize("offset", [4, 64])
def test_leads_of_one_document_are_dealt_by_blocks(spark, offset):
    """No task needs all leads of a document, and each meets those that it may ask for, once."""
    df = spark.range(2000).selectExpr("id AS rank", "id % 2 AS doc", "CAST(id div 2 AS int) AS idx", "5L AS place")
    found = suffix_dedup.dealt_by_blocks(df, offset).collect()
    groups = collections.defaultdict(list)
    for r in found:
        groups[r.part].append((r.doc, r.idx, r.block))
    assert max(map(len, groups.values())) <= 3 * max(64, offset) and len(found) < 2000 * 1.55
    span = max(64, 2 * offset)
    for rows in groups.values():
        assert len({(d, b) for d, _, b in rows}) == 1 and len(set(rows)) == len(rows)
        (d, _, b), there = rows[0], {i for _, i, _ in rows}
        assert there == set(range(b * span, min((b + 1) * span + offset, 1000)))
    assert len(groups) == 2 * -(-1000 // span)
