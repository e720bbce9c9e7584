"""Structured queries over the relational tables, lexical search, graph traversal and event rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import evaluation, graph
from lodestone.plans.base import MANY_EDGES, MANY_ENTITIES, load, query, with_fixtures
from lodestone.streaming import incremental


@query("structured_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def structured_pricing(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '2000-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n")
    )


@query("structured_segments", "SELECT c_mktsegment, n_name, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def structured_segments(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))  # nations: 25 rows
    return j.groupBy("c_mktsegment", "n_name").agg(F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("structured_top_parts", "SELECT p_brand, p_partkey, qty FROM (SELECT p_brand, p_partkey, sum(l_quantity) AS qty, row_number() OVER (PARTITION BY p_brand ORDER BY sum(l_quantity) DESC, p_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_partkey) WHERE n <= 3")
def structured_top_parts(spark, sf_dir):
    sums = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("qty"))  # before the join: fewer rows to shuffle
    j = sums.join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    w = Window.partitionBy("p_brand").orderBy(F.desc("qty"), "p_partkey")
    return j.withColumn("n", F.row_number().over(w)).where("n <= 3").select("p_brand", "p_partkey", "qty")


@query("structured_unshipped", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def structured_unshipped(spark, sf_dir):
    returned = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("event_rollup", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rollup(spark, sf_dir):
    return incremental.event_rollup(load(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return incremental.sessions(load(spark, sf_dir, "events"))


@query("event_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def event_props(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query("graph_traverse", with_fixtures(", walk AS (SELECT name AS seed, name AS entity, 0 AS depth FROM entities WHERE starts_with(name, 'PTSD~') UNION SELECT seed, e.target_entity, depth + 1 FROM walk JOIN (SELECT source_entity, target_entity FROM edges UNION ALL SELECT target_entity, source_entity FROM edges WHERE directionality = 'bidirectional') e ON e.source_entity = entity WHERE depth < 3) SELECT seed, entity, min(depth)::INTEGER AS depth FROM walk GROUP BY seed, entity", MANY_ENTITIES, MANY_EDGES, recursive=True).replace("\n, walk", ",\nwalk"))
def graph_traverse(spark, sf_dir):
    """What one entity of each customer's graph reaches in three steps."""
    e = MANY_EDGES.frame(spark, sf_dir).select(F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), F.col("directionality").alias("kind"))
    seeds = MANY_ENTITIES.frame(spark, sf_dir).where("startswith(name, 'PTSD~')").select(F.col("name").alias("seed"))
    return graph.traverse(graph.both_ways(e, F.col("kind") == "bidirectional"), seeds, 3).select("seed", F.col("node").alias("entity"), "depth")


_W = "list_filter(string_split_regex(coalesce({t}, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')"


#: BM25 of every test item; ``BM25`` has every fiftieth.
BM25_ALL = f"""WITH q AS (SELECT DISTINCT item_id AS qid, unnest({_W.format(t='lower(text)')}) AS w FROM benchmark),
d AS (SELECT doc_id, {_W.format(t='text')} AS t, {_W.format(t='lower(text)')} AS lt FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
tf AS (SELECT w, doc_id, any_value(len) AS len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(lt) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY w, doc_id), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w)"""
BM25 = BM25_ALL.replace("FROM benchmark)", "FROM benchmark WHERE item_id % 50 = 0)")


@query("bm25", f"""{BM25}
SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))), 6) AS score FROM q JOIN tf USING (w) JOIN df USING (w), st GROUP BY qid, doc_id""")
def bm25(spark, sf_dir):
    q = load(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return evaluation.bm25(load(spark, sf_dir, "documents"), q).withColumn("score", F.round("score", 6))


@query("label_strata", "SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def label_strata(spark, sf_dir):
    j = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id")
    g = j.groupingSets([[], ["lang"]], "lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))
    return g.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("exact_duplicates", "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
