"""Indexes, byte-pair tokens, graph walks and versioned tables against plain computations."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions import bpe
from lodestone.index import clusters, postings, shared, trigrams
from lodestone.operators import evaluation, graph, search
from lodestone.plans import indexes
from lodestone.sources.versions import Collision, VersionedTable, _ddl
from lodestone.streaming import mirror


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- postings


def prose(rng, n):
    return " ".join(f"w{int(rng.random() ** 4 * 300)}" for _ in range(n))


@pytest.mark.parametrize(("n_docs", "k"), [(0, 3), (2, 5), (400, 5)])
def test_postings_rank_as_all_scores(spark, tmp_path, monkeypatch, n_docs, k):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    rng = random.Random(n_docs)
    docs = [(i, prose(rng, rng.choice([0, 1, 20, 60]))) for i in range(n_docs)] + [(n_docs + 1, None), (n_docs + 2, "Only WORDS here")]
    asked = [(1, "w0 w1 w250"), (2, "w2 w2 w180 w299 nothing"), (3, "absent words"), (4, ""), (5, "only words w0"), (6, " ".join(f"w{i}" for i in range(0, 300, 7)))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid int, query string")
    index = postings.build(d, str(tmp_path / "index"))
    got = {(r.qid, r.rank): (r.id, round(r.score, 6)) for r in postings.top_k(index, q, k).collect()}

    words = {i: (t or "").lower().split() for i, t in docs}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for qid, text in asked:
        scores = []
        for i, ws in words.items():
            tf = Counter(ws)
            shared = [w for w in set(text.lower().split()) if tf[w]]
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in shared)
            if shared:
                scores.append((-round(s, 9), i))
        want |= {(qid, n): (i, round(-s, 6)) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    assert got == want
    if n_docs == 400:
        everyone = evaluation.bm25(d, q).count()
        assert postings.candidates(index, q, k)[0].count() < everyone / 2


def test_only_texts_are_shuffled_for_postings(spark, tmp_path, monkeypatch):
    plans, put = [], shared.Tables.write
    monkeypatch.setattr(shared.Tables, "write", lambda self, name, df, *by: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(self, name, df, *by)))
    texts = ["b a B", None, "", " \t", "é x É  x\nx", "a"]
    index = postings.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "index"))
    assert sum(p.count("Exchange") for p in plans) == 1
    want = [(w, i, n, len((t or "").split())) for i, t in enumerate(texts) for w, n in Counter((t or "").lower().split()).items()]
    assert rows(index.postings, "w", "id", "tf", "len") == sorted(want, key=str)
    whole = index.read("whole").first()
    assert (whole.n, whole.mean) == (6, 9 / 6)


def test_every_test_item_is_asked(spark):
    folder = "/root/testdata/sf0.001"
    words = {w for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for w in (r.text or "").lower().split()}
    want = {r.item_id for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if words & set((r.text or "").lower().split())}
    assert {r.qid for r in indexes.bm25_topk(spark, folder).collect()} == want
    assert any(i % 50 for i in want)


# --- substrings


def test_substrings_as_a_scan(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abÄé_%日😀 ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "ab", "100% a_b", "İstanbul", "x" * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    index = trigrams.build(df, str(tmp_path / "index"), "id")
    patterns = ["aba", "AB", "a_b", "%", "é日", "äb", "日😀 ", "", None, "nowhere at all", "xxxxxxxx", "aaa", "abäé", "İst"]
    asked = spark.createDataFrame(list(enumerate(patterns)), "pid int, pattern string")
    low = df.select("id", F.lower("text").alias("text"))
    want = asked.select("pid", F.lower("pattern").alias("p")).join(low, F.contains("text", F.col("p"))).select("pid", "id")
    got = trigrams.holding(index, asked)
    assert rows(got, "pid", "id") == rows(want, "pid", "id") and got.count() > 300
    some = ["a_b", "日😀", "ÄB"]
    assert rows(trigrams.holding_any(index, some), "id") == rows(search.keyword_hits(df, some, "text"), "id")
    # candidates are few where a pattern is rare
    rare = spark.createDataFrame([(0, "istanbul"), (1, "100% a")], "pid int, pattern string")
    assert trigrams.candidates(index, rare).count() <= 2


# --- vectors by cells


@pytest.mark.parametrize("kind", ["clustered", "spread", "equal", "few", "none"])
def test_cells_as_all_pairs(spark, tmp_path, monkeypatch, kind):
    rng = random.Random(kind)
    monkeypatch.setattr(clusters, "PART_ROWS", 40)
    middle = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = lambda m: [x + rng.gauss(0, 0.05) for x in m]
    vectors = {
        "clustered": lambda: [near(rng.choice(middle)) for _ in range(600)],
        "spread": lambda: [[rng.gauss(0, 1) for _ in range(8)] for _ in range(300)],
        "equal": lambda: [middle[0]] * 200 + [[-x for x in middle[0]]] * 3 + [near(middle[1])],
        "few": lambda: [near(m) for m in middle[:3]],
        "none": lambda: [],
    }[kind]()
    data = list(enumerate(vectors)) + [(9001, None), (9002, [0.0] * 8), (9003, [1.0, 2.0]), (9004, [float("nan")] * 8), (9005, [1.0] * 7 + [None])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([*data[::9], (-1, [1.0] * 8), (-2, None)], "qid long, qvec array<double>").dropDuplicates(["qid"])
    index = clusters.build(df, str(tmp_path / "index"), centres=12)
    found = clusters.search(index, asked, 5)
    got = [(r.qid, r.rank, r.id, round(r.score, 6)) for r in found.results.collect()]
    length = 2 if kind == "none" else 8  # of most vectors
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in data if v and len(v) == length and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    want = []
    for r in asked.collect():
        v = r.qvec
        if not v or len(v) != length or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        n = math.sqrt(sum(x * x for x in v))
        scores = sorted((-round(sum(a * b / n for a, b in zip(u, v, strict=True)), 9), i) for i, u in unit.items() if i != r.qid)
        want += [(r.qid, k, i, round(-s, 6)) for k, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(got) == sorted(want)
    if kind == "clustered":
        assert clusters.share_read(index, found, asked.count()) < 0.5


# --- byte-pair tokens


def vocabulary():
    known = pytest.importorskip("public_tokenizers")
    return known.path("byte_bpe_50k.tiktoken"), known.PATTERN


def library(path, pattern):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=dict(bpe.ranks(path)), special_tokens={})


def test_merges_as_the_library():
    path, pattern = vocabulary()
    rng, known, lib = random.Random(3), bpe.ranks(path), library(path, pattern)
    pieces = ["a", "ab", "hello", " the", "日本語", "😀" * 7, "x" * 5000, "ab" * 3000, *("".join(rng.choice("aehilnorst é") for _ in range(rng.randint(1, 60))) for _ in range(500))]
    for p in pieces:
        assert bpe.merged(p.encode(), known) == lib._encode_single_piece(p)


def test_ids_of_all_documents_as_the_library(spark):
    path, pattern = vocabulary()
    lib = library(path, pattern)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "  \n\n\t x's  'S ſ 's   y  "), (-4, "日本語 ١٢٣ ²③ 😀\r\n\r\n..."), (-5, "x" * 3000), (-6, "́a‍ b　\n c")]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r.doc_id: r.ids for r in bpe.encode(df, path, pattern=pattern).collect()}
    want = {r.doc_id: ids for r in df.collect() if (ids := lib.encode_ordinary(r.text or ""))}
    assert got == want


@pytest.mark.parametrize("few", [0, 200_000])
def test_windows_as_the_library(spark, monkeypatch, few):
    monkeypatch.setattr(bpe, "FEW_PIECES", few)
    path, pattern = vocabulary()
    lib = library(path, pattern)
    texts = ["", None, "one", "Prose of some words, é and 日本語 and 😀. " * 9, "x" * 300]
    df, want = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), []
    for k, t in enumerate(texts):
        ids, start, n = lib.encode_ordinary(t or ""), 0, 0
        while start < len(ids):
            part = ids[start : start + 16]
            want.append((k, n, lib.decode(part, errors="replace"), len(part)))
            if start + 16 >= len(ids):
                break
            start, n = start + 12, n + 1
    assert rows(bpe.windows(df, path, 16, 4, pattern=pattern), "doc_id", "chunk_index", "chunk_text", "chunk_tokens") == sorted(want, key=str)
    with pytest.raises(ValueError):
        bpe.windows(df, path, 4, 4)


# --- graphs


def test_walks_with_budgets(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice("ab")) for _ in range(90)] + [("n1", None, "a"), (None, "n1", "a"), ("n1", "n2", "a"), ("n1", "n2", "a")]
    e = spark.createDataFrame(edges, "source string, target string, kind string")
    seeds = ["n1", "n2", "n3", "lonely"]
    s = spark.createDataFrame([(x,) for x in [*seeds, "n1", None]], "seed string")
    for kinds, budget, depth in ((None, None, 5), (["a"], None, 9), (None, 7, 4), (["a", "b"], 1, 3), ([], None, 2)):
        after = defaultdict(set)
        for a, b, kind in edges:
            if a and b and (kinds is None or kind in kinds):
                after[a].add(b)
        want = set()
        for seed in seeds:
            seen, front = {seed: 0}, [seed]
            for level in range(1, depth + 1):
                if budget is not None and len(seen) >= budget:
                    break
                front = sorted({b for a in front for b in after[a]} - seen.keys())
                front = front if budget is None else front[: budget - len(seen)]
                seen |= dict.fromkeys(front, level)
            want |= {(seed, n, level) for n, level in seen.items()}
        assert set(map(tuple, graph.traverse(e, s, depth, kinds, budget).collect())) == want
    assert graph.traverse(e, s.limit(0), 3).count() == 0


@pytest.mark.parametrize("most", [3, 200_000])
def test_large_frontiers_walk_by_lists(spark, monkeypatch, most):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", "a") for _ in range(150)] + [("hub", f"n{i}", "a") for i in range(40)] * 2 + [("n1", "hub", "a"), ("n2", None, "a"), (None, "n2", "a")]
    e, s = spark.createDataFrame(edges, "source string, target string, kind string"), spark.createDataFrame([("n1",), ("n2",), ("hub",), ("lonely",), (None,)], "seed string")
    cases = [(depth, budget) for depth in (1, 4) for budget in (None, 1, 9, 45)]
    want = [rows(graph.traverse(e, s, depth, None, budget), "seed", "node", "depth") for depth, budget in cases]
    lists, walked = graph._by_lists, []
    monkeypatch.setattr(graph, "_by_lists", lambda *args: walked.append(1) or lists(*args))
    monkeypatch.setattr(graph, "if_few", lambda df: df)
    monkeypatch.setattr(graph, "LIST_NODES", most)
    monkeypatch.setattr(graph, "TASK_NODES", 50)
    assert [rows(graph.traverse(e, s, depth, None, budget), "seed", "node", "depth") for depth, budget in cases] == want and walked


@pytest.mark.parametrize("walk", ["graph_budget", "graph_reach"])
def test_every_customer_walks(spark, walk):
    folder = "/root/testdata/sf0.001"
    customers = {f"c{r.c_custkey}" for r in spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey").collect()}
    assert {r.seed for r in getattr(indexes, walk)(spark, folder).select("seed").distinct().collect()} == customers


# --- versions


def test_versions_stay_as_they_are(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    df = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    with pytest.raises(ValueError):
        table.read()
    table.replace(df(*[(k, "a") for k in range(20)]))
    first = table.read()
    v = table.upsert(df((3, "b"), (99, "b")))
    unchanged = [b for b, f in v.folders.items() if table.version(1).folders.get(b) == f]
    assert len(unchanged) >= 2  # buckets without these keys are as they were
    assert first.where("v = 'b'").count() == 0 and first.count() == 20
    assert rows(table.read().where("v = 'b'"), "k") == [(3,), (99,)] and table.read().count() == 21
    table.append(df((200, "c"), (3, "c")))
    assert table.read().count() == 23
    table.upsert(df((3, "d")), order=["v"])
    assert rows(table.read().where("k = 3"), "v") == [("d",)] and table.read().count() == 22
    with pytest.raises(Exception, match="more than once"):
        table.upsert(df((5, "x"), (5, "y")))
    assert table.version().number == 4 and table.read(1).count() == 20

    def refuse(written):
        raise ValueError(f"{written.count()} rows refused")

    with pytest.raises(ValueError, match="1 rows refused"):
        table.replace(df((1, "z")), check=refuse)
    assert table.version().number == 4
    table.forget(keep=1)
    with pytest.raises(ValueError):
        table.read(1)
    assert table.read().count() == 22
    table.upsert(df().limit(0))
    assert table.read().count() == 22


def test_writers_that_meet(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=2) for _ in range(2))
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    one.replace(df)
    seen = two.version()
    one.upsert(df.withColumn("v", F.lit("b")))
    with pytest.raises(Collision):
        two._commit(seen, two._write(df), _ddl(df), None)
    assert rows(two.read(), "k", "v") == [(1, "b")]


def test_mirror_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    history = [(f"k{rng.randrange(12)}", seq, rng.choice("xyz"), rng.random() < 0.25) for seq in range(1, 120)] + [("tie", 500, "x", False), ("tie", 500, "x", True)]
    df = spark.createDataFrame(history, "id string, n long, v string, gone boolean")
    c = mirror.changes(df, "id", "n", ["v"], F.col("gone"))
    last = {}
    for i, n, v, gone in history:
        last[i] = max(last.get(i, (0, False, "")), (n, gone, v))
    want = sorted((i, n, v) for i, (n, gone, v) in last.items() if not gone)
    ends = []
    for turn in range(3):
        table = mirror.mirror(spark, str(tmp_path / f"t{turn}"), buckets=3)
        parts = [c.where(F.pmod(F.col("seq"), F.lit(4)) == k) for k in range(4)]
        rng.shuffle(parts)
        for n, part in enumerate([*parts, parts[0], parts[2]]):
            mirror.apply(table, part, f"b/{n}")
        assert not mirror.apply(table, c, "b/0")  # a batch of a name is done once
        ends.append(rows(table.read(), "key", "seq", "hash", "gone"))
        assert rows(mirror.current(table), "key", "seq", "v") == sorted(want, key=str)
    assert ends[0] == ends[1] == ends[2]


def test_listings_replace_and_remove(spark, tmp_path):
    table = mirror.mirror(spark, str(tmp_path / "t"), buckets=2)
    listing = lambda n, **r: mirror.changes(spark.createDataFrame([(k, n, v) for k, v in r.items()], "id string, n long, v string"), "id", "n", ["v"])
    mirror.apply_listing(table, listing(1, a="1", b="1", c="1"), 1)
    mirror.apply_listing(table, listing(2, a="1", b="2"), 2)
    assert rows(mirror.current(table), "key", "seq", "v") == [("a", 1, "1"), ("b", 2, "2")]
    mirror.apply(table, listing(1, c="1"))  # an old change doesn't bring back what has gone
    assert rows(mirror.current(table), "key") == [("a",), ("b",)]
    mirror.apply_listing(table, listing(3, c="3", a="1", b="2"), 3)
    assert rows(mirror.current(table), "key", "seq") == [("a", 1), ("b", 2), ("c", 3)]
