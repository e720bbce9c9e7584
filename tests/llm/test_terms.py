"""Fingerprints, divergence of sources and collocations against brute force."""

import collections
import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, divergence, queries, winnowing

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
SCHEMA_NAMES = ["doc_id", "text", "lang", "source"]


def words(rng, n, kinds):
    return " ".join(f"{rng.choice('aAbBcé')}{rng.choice('xyz')}{int(rng.random() ** 3 * kinds)}{rng.choice(['', '', '', ',', '.', chr(10), '  ', chr(9)])}" for _ in range(n))


def corpus(seed, n=120, langs=("en", "de", None)):
    rng = random.Random(seed)
    rows = [(i * 3 - 50, words(rng, rng.choice([0, 1, 3, 30, 200]), 12), rng.choice(langs), rng.choice(["s1", "s2", "s2", "s3", None])) for i in range(n)]
    rows += [(9001, None, "en", "only"), (9002, "", "empty", "a"), (9003, "  \n", "empty", "b"), (9004, "!? 12", "xx", None), (9005, "one two one two " * 300, "en", "s1")]
    return [*rows, *rows[:7]]  # repeated rows


# --- fingerprints


def winnowed(text, gram, window, hashes):
    """Positions by the definition; ``hashes`` names runs by the operator's hash of them alone."""
    runs = [text[i : i + gram] for i in range(len(text) - gram + 1)] or ([text] if text else [])
    h = [hashes(r) for r in runs]
    out = []
    for i in range(max(len(h) - window + 1, 1) if h else 0):
        part = h[i : i + window]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1] != at:
            out.append(at)
    return [(h[i], i) for i in out]


@pytest.mark.parametrize(("gram", "window", "strip"), [(3, 4, 7), (5, 1, 16), (1, 6, 1000), (16, 32, 50)])
def test_winnowing(gram, window, strip):
    rng = random.Random(gram)
    one, winnower = winnowing.Winnower(gram, 1, 1 << 20), winnowing.Winnower(gram, window, strip)
    named = {}

    def hashes(run):
        if run not in named:
            named[run] = int(one.of([run])[0][0][0])
        return named[run]

    texts = ["", "a", "ab", "a" * 90, "abcabcabc" * 9, "é😀x" * 20, *("".join(rng.choice("ab c") for _ in range(rng.randint(1, 150))) for _ in range(60))]
    for text, (h, p) in zip(texts, winnower.of(texts), strict=True):
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == winnowed(text, gram, window, hashes)


def test_winnowing_guarantee():
    rng, (gram, window) = random.Random(7), (5, 6)
    winnower = winnowing.Winnower(gram, window, 64)
    for _ in range(50):
        shared = "".join(rng.choice("abcd") for _ in range(gram + window - 1))
        left, right = ("".join(rng.choice("efgh") for _ in range(rng.randint(0, 99))) for _ in range(2))
        (a, p), (b, q) = winnower.of([left + shared + left, right + shared])
        met = {(int(i) - len(left), int(j) - len(right)) for h, i in zip(a, p, strict=True) for g, j in zip(b, q, strict=True) if h == g}
        assert any(i == j and 0 <= i < window for i, j in met)


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest(), t, t[: len(t) - n] + after[:n], after)
    return out


@pytest.mark.parametrize("bucket_bytes", [300, 1 << 20])
def test_edited_likeness(spark, bucket_bytes):
    rows = corpus(3)[:125] + [(None, "no name at all", "en", "s")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("fingerprint", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = {r.doc_id: r for r in winnowing.edited_likeness(df, bucket_bytes=bucket_bytes).collect()}
    winnower, want = winnowing.Winnower(), edited(rows)
    assert got.keys() == want.keys()
    for i, (n, sha, text, changed, after) in want.items():
        a, b, c = (found[0] for found in winnower.of([text, changed, after]))
        alike = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if len(x) or len(y) else 1.0
        assert (got[i].n_chars, got[i].edited_sha256) == (n, sha)
        assert got[i].near_edited == pytest.approx(alike(a, b)) and got[i].near_next == pytest.approx(alike(a, c))
        assert got[i].fingerprint == winnowing.written(*winnower.of([text])[0]) and got[i].edited_fingerprint == winnowing.written(*winnower.of([changed])[0])


def test_edited_likeness_of_odd_tables(spark):
    df = spark.createDataFrame([(5, "the only row of this table, of some length")], "doc_id long, text string")
    (r,) = winnowing.edited_likeness(df).collect()
    assert r.near_next == 1.0 and r.n_chars == 42
    assert winnowing.edited_likeness(df.limit(0)).count() == 0
    # an id that fills several ranges, and rows without an id
    rows = [(7, words(random.Random(i), 20, 5)) for i in range(60)] + [(None, words(random.Random(i), 20, 5)) for i in range(60)] + [(i, "x y z" * i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, whole = (sorted(map(str, winnowing.edited_likeness(df, bucket_bytes=n).collect())) for n in (200, 1 << 20))
    assert len(whole) == len(rows) and small == whole


def test_fingerprints_of_a_column(spark):
    df = spark.createDataFrame([(1, "some words that both texts have, and more"), (2, "before it: some words that both texts have"), (3, None), (4, "")], "doc_id long, text string")
    found = winnowing.fingerprints(df.withColumn("fingerprint", F.lit(1)), gram=4, window=5)
    assert {r.doc_id: len(r.fingerprint) > 0 for r in found.collect()} == {1: True, 2: True, 3: False, 4: False}
    met = winnowing.shared_places(found.where("doc_id = 1"), found.where("doc_id = 2")).collect()
    assert any(r.right_position - r.left_position == 11 for r in met)


# --- divergence of sources


def distances(rows, min_docs, top):
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: B023, E731
        p, q = share(own), share(sum((c for (x, _), c in groups.items() if x == lang), collections.Counter()))
        pairs = [(-sum(abs(p[t] - o[t]) for t in kept), s) for (x, s), c in groups.items() if x == lang and s != source for o in [share(c)]]
        terms = [(q[t] - p[t], t) for t in kept if own[t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def batches(rows, *names, size=30):
    table = pa.table({n: pa.array([(r[SCHEMA_NAMES.index(n)] or "") for r in rows], pa.string()) for n in names})
    return table.to_batches(max_chunksize=size)


def test_terms_of_small_pieces(monkeypatch):
    rows = corpus(4)

    def sums():
        out, names = collections.Counter(), {}
        for b in divergence.count_terms(iter(batches(rows, "lang", "source", "text"))):
            for lang, source, term, n, n_docs, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name is None:
                    out[lang, source, term, "n"] += n
                    out[lang, source, term, "docs"] += n_docs
                else:
                    assert names.setdefault(term, name) == name
        return {(a, b, names.get(t), k): n for (a, b, t, k), n in out.items()}

    whole = sums()
    monkeypatch.setattr(divergence, "PIECE", 200)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert sums() == whole
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert sums() == whole


@pytest.mark.parametrize("min_docs", [2, 30, 10_000])
def test_divergence(spark, min_docs):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(0))
    got = divergence.divergence(df, min_docs=min_docs, top=9)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == distances(rows, min_docs, 9)
    assert divergence.divergence(df.limit(0)).count() == 0


# --- collocations


def mined(rows, longest, least, top):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        phrases = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in phrases.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in phrases.items():
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 50 * a:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run_counts(rows, longest):
    f = collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f.update((lang or "", k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


@pytest.mark.parametrize(("least", "cells"), [(1, 1 << 10), (10, 1 << 20), (4, 1 << 6)])
def test_sketch_and_counts_of_small_pieces(monkeypatch, least, cells):
    """Whatever the pieces, no run with enough occurrences is lost, and those let through are counted exactly."""
    for name, n in (("GROUP", 300), ("HELD", 500), ("PHRASES", 40), ("BLOCK", 1 << 6)):
        monkeypatch.setattr(collocations, name, n)
    rows, longest = corpus(5), 4
    parts = lambda: iter(batches(rows, "lang", "text"))
    touched = sorted((r["row"], r["block"], r["packed"]) for b in collocations.sketched(parts(), longest, cells) for r in b.to_pylist())
    ordered = pa.table({n: [t[k] for t in touched] for k, n in enumerate(("row", "block", "packed"))}).to_batches(max_chunksize=7)
    blocks = [tuple(r.values()) for b in collocations.merged(iter(ordered), least) for r in b.to_pylist()]
    assert len({b[:2] for b in blocks}) == len(blocks)
    found, names = collections.Counter(), {}
    for b in collocations.counted(parts(), longest, collocations.Sketch(cells, blocks)):
        for r in b.to_pylist():
            if r["size"] == -1:
                assert names.setdefault(r["key"][:8], r["key"][8:].decode()) == r["key"][8:].decode()
            else:
                found[r["lang"], r["size"], r["key"]] += r["n"]
    got = collections.Counter({(lang, k, " ".join(names[key[i : i + 8]] for i in range(0, len(key), 8))): n for (lang, k, key), n in found.items()})
    want = run_counts(rows, longest)
    assert {k: n for k, n in want.items() if n >= least}.items() <= got.items()
    assert all(want[k] == n for k, n in got.items() if k[1])
    assert sum(n for k, n in got.items() if not k[1]) == sum(n for k, n in want.items() if k[1] == 1)


@pytest.mark.parametrize(("longest", "least"), [(3, 10), (3, 3), (5, 4)])
def test_collocations(spark, longest, least):
    rows = corpus(5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("phrase", F.lit(1))
    got = collocations.collocations(df, longest=longest, least=least, top=40)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == mined(rows, longest, least, 40)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_sketch_never_counts_less(spark, monkeypatch):
    """With few cells nearly all runs get through, and the result is the same."""
    rows = corpus(6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    whole = sorted(map(str, collocations.collocations(df).collect()))
    monkeypatch.setattr(collocations, "FEWEST_CELLS", 64)
    monkeypatch.setattr(collocations, "MOST_CELLS", 64)
    assert sorted(map(str, collocations.collocations(df).collect())) == whole


def test_pieces_end_at_splits():
    text = ("word " * 50 + ".") * 20 + "x" * 500
    for most in (1, 100, 400, 5000):
        found = list(collocations.pieces(text.encode(), most))
        assert b"".join(found).decode() == text and all(p.endswith(b".") for p in found[:-1])


@pytest.mark.parametrize("name", ["op2_decontamination", "op12_divergence", "op13_collocations"])
def test_corpus_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DIR)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(str, cursor.fetchall()))
