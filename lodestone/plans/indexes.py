"""Searches by indexes, byte-pair windows, graph walks and versioned tables, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import bpe
from lodestone.index import clusters, postings, trigrams
from lodestone.operators import graph
from lodestone.plans.base import load, query
from lodestone.plans.context import _PATTERNS, CHUNKS, chunks_of
from lodestone.plans.tables import BM25_ALL
from lodestone.plans.vectors import COS, vector_queries
from lodestone.sources.places import shared_folder
from lodestone.sources.versions import VersionedTable
from lodestone.streaming import mirror


@query("bm25_topk", f"{BM25_ALL}, scored AS (SELECT qid, doc_id AS id, sum({{part}}) AS score FROM q JOIN tf USING (w) JOIN df USING (w), st GROUP BY qid, doc_id) SELECT qid, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 10".format(part="ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))"))
def bm25_topk(spark, sf_dir):
    """The ten best documents of each question by postings with upper bounds."""
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    index = postings.build(load(spark, sf_dir, "documents"), shared_folder(spark, "bm25"))
    return postings.top_k(index, q, 10).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("keyword_trigram", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE contains(lower(chunk_text), '100%') OR contains(lower(chunk_text), 'a_b') OR contains(lower(chunk_text), 'la de') OR contains(lower(chunk_text), 'licensed under')")
def keyword_trigram(spark, sf_dir):
    """The rows of ``keyword_ilike`` by the index of runs of three characters."""
    index = trigrams.build(chunks_of(spark, sf_dir), shared_folder(spark, "trigrams"), "chunk_id", "chunk_text")
    return trigrams.holding_any(index, _PATTERNS).select(F.col("id").alias("chunk_id"))


@query("substring_items", "SELECT item_id AS pid, doc_id AS id FROM (SELECT item_id, lower(substr(text, 4, 20)) AS p FROM benchmark) JOIN documents ON contains(lower(text), p)")
def substring_items(spark, sf_dir):
    """Which documents hold twenty characters of a test item, whatever the case."""
    index = trigrams.build(load(spark, sf_dir, "documents"), shared_folder(spark, "trigrams"))
    return trigrams.holding(index, load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.substring("text", 4, 20).alias("pattern")))


@query("pruned_topk", f"WITH {COS} SELECT qid, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def pruned_topk(spark, sf_dir):
    """The rows of ``batch_topk`` by cells of vectors around centres."""
    index = clusters.build(load(spark, sf_dir, "embeddings"), shared_folder(spark, "cells"))
    found = clusters.search(index, vector_queries(spark, sf_dir), 10).results
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query("bpe_windows")
def bpe_windows(spark, sf_dir):
    """Windows of byte-pair tokens of all documents, by an installed vocabulary."""
    c = bpe.windows(load(spark, sf_dir, "documents"), size=512, overlap=64, **_vocabulary())
    return c.select("doc_id", "chunk_index", "chunk_tokens", F.md5("chunk_text").alias("h"))


@query("bpe_round_trip", "SELECT doc_id, md5(text) AS h, strlen(text) AS n_bytes FROM documents WHERE text <> ''")
def bpe_round_trip(spark, sf_dir):
    """The bytes of windows that don't overlap, one behind the other, are the text."""
    c = bpe.windows(load(spark, sf_dir, "documents"), size=512, overlap=0, **_vocabulary())
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("chunk_bytes").alias("b")))), lambda x: F.hex(x["b"])), "")
    joined = c.groupBy("doc_id").agg(F.unhex(whole).alias("bytes"))
    return joined.select("doc_id", F.md5("bytes").alias("h"), F.octet_length("bytes").cast("long").alias("n_bytes"))


_EDGES = "e AS (SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target, 'placed' AS kind FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'holds' FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'from' FROM lineitem), b AS (SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT target, source, kind FROM e))"


def _trade(spark, sf_dir):
    """Customers, orders, parts and suppliers as a graph, walked both ways."""
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")  # noqa: E741
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))
    edges = edge(o, named("c", "o_custkey"), named("o", "o_orderkey"), "placed").unionAll(edge(l, named("o", "l_orderkey"), named("p", "l_partkey"), "holds")).unionAll(edge(l, named("p", "l_partkey"), named("s", "l_suppkey"), "from"))
    seeds = load(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("seed"))
    return graph.both_ways(edges), seeds


@query("graph_reach", f"WITH RECURSIVE {_EDGES}, walk AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS node, 0 AS depth FROM customer UNION SELECT seed, target, depth + 1 FROM walk JOIN b ON source = node WHERE depth < 3) SELECT seed, node, min(depth)::INTEGER AS depth FROM walk GROUP BY seed, node")
def graph_reach(spark, sf_dir):
    """What customers reach within three steps, over edges of every kind."""
    return graph.traverse(*_trade(spark, sf_dir), depth=3)


def _levels(depth: int, budget: int) -> str:
    """The walk with a budget, level by level: a level that doesn't fit is cut, and its seed stops."""
    out = ["f0 AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS node, 0 AS depth, 1 AS used FROM customer)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, node FROM f{i}" for i in range(k))
        out.append(f"n{k} AS (SELECT seed, target AS node, max(used) AS used FROM f{k - 1} JOIN b ON source = node WHERE kind IN ('placed', 'holds') AND used < {budget} AND (seed, target) NOT IN ({seen}) GROUP BY seed, target)")
        out.append(f"k{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY node) AS n FROM n{k}) WHERE used + n <= {budget})")
        out.append(f"f{k} AS (SELECT seed, node, {k} AS depth, used + count(*) OVER (PARTITION BY seed) AS used FROM k{k})")
    return ",\n".join(out)


@query("graph_budget", f"WITH {_EDGES}, {_levels(4, 120)} " + " UNION ALL ".join(f"SELECT seed, node, depth::INTEGER AS depth FROM f{k}" for k in range(5)))
def graph_budget(spark, sf_dir):
    """The first 120 nodes that each customer reaches over its orders and their parts."""
    return graph.traverse(*_trade(spark, sf_dir), depth=4, kinds=["placed", "holds"], budget=120)


@query(
    "versioned_upsert",
    "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) SELECT 1 AS version, c_custkey AS k, round(c_acctbal, 2) AS amount FROM customer UNION ALL SELECT 2, coalesce(k, c_custkey), round(coalesce(total, c_acctbal), 2) FROM customer FULL JOIN t ON k = c_custkey UNION ALL SELECT 3, c_custkey, 0.0 FROM customer WHERE c_custkey % 10 = 0",
)
def versioned_upsert(spark, sf_dir):
    """Balances of customers, then the sums of some customers' orders in their place, then other rows: each version as it stays readable."""
    table = VersionedTable(spark, shared_folder(spark, "versions"), ["k"])
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("amount"))
    table.replace(c)
    first = table.read()  # planned before the next versions are written
    sums = load(spark, sf_dir, "orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("amount"))
    table.upsert(sums)
    second = table.read()
    table.replace(c.where("k % 10 = 0").withColumn("amount", F.lit(0.0)))
    every = [(1, first), (2, second), (3, table.read())]
    out = [df.select(F.lit(n).alias("version"), "k", F.round("amount", 2).alias("amount")) for n, df in every]
    return out[0].unionAll(out[1]).unionAll(out[2])


_LAST = "SELECT 'u' || user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS kind, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id"


def _changes(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "event_id", F.col("event_type").alias("kind"), "value", (F.col("event_id") % 5 == 0).alias("left"))
    return mirror.changes(e, "key", "event_id", ["kind", "value"], F.col("left")).withColumn("turn", F.col("seq") % 4)


@query("mirror_changes", f"SELECT * FROM ({_LAST}) WHERE seq % 5 <> 0")
def mirror_changes(spark, sf_dir):
    """Users as their last event leaves them, from a stream of files that come out of order and twice; every fifth event removes a user."""
    folder = shared_folder(spark, "mirror")
    c = _changes(spark, sf_dir)
    for n, turn in enumerate((3, 0, 2, 1, 3)):
        c.where(F.col("turn") == turn).drop("turn").write.parquet(f"{folder}/in/{n}")
    table = mirror.mirror(spark, f"{folder}/table")
    stream = spark.readStream.schema(c.drop("turn").schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    mirror.follow(stream, table, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return mirror.current(table).select("key", "seq", "kind", F.round("value", 6).alias("value"))


@query(
    "mirror_listings",
    "SELECT 's' || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 3 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS seq, s_name AS name, round(CASE WHEN s_suppkey % 3 = 0 THEN 1.0 WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE s_acctbal END, 2) AS amount FROM supplier WHERE s_suppkey % 7 <> 0",
)
def mirror_listings(spark, sf_dir):
    """Suppliers by three listings of all there are: some change in each, and every seventh is missing from the last."""
    table = mirror.mirror(spark, shared_folder(spark, "listings"))
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), "s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("amount"))
    for n, change in enumerate((F.lit(False), F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0), 1):
        s = s.withColumn("amount", F.when(change, F.lit(float(n - 2))).otherwise(F.col("amount")))
        listed = s if n < 3 else s.where("s_suppkey % 7 <> 0")
        c = mirror.changes(listed.withColumn("n", F.lit(n)), "key", "n", ["name", "amount"])
        for _ in range(2):  # the second time changes nothing
            mirror.apply_listing(table, c, n, f"listing/{n}")
    return mirror.current(table).select("key", "seq", "name", F.round("amount", 2).alias("amount"))
