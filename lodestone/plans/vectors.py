"""Vector search, fusion and quality metrics on ``embeddings``: queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vector import dot, l2_normalize, norm
from lodestone.operators import evaluation, rerank, search
from lodestone.plans.base import load, query

K = 10


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def batch(spark: SparkSession, sf_dir: str, k: int = K, unit: bool = True) -> DataFrame:
    return search.batch_top_k(vector_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"), k, unit=unit)


SCORED = """scored AS (
  SELECT q.vec_id AS qid, e.vec_id AS id, {fn}(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score, e.label = q.label AS relevant, q.label AS qlabel
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored)"""
COS = SCORED.format(fn="list_cosine_similarity")


def _zero(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id: the query of the single searches."""
    return load(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query("topk_cosine", "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]) DESC, vec_id LIMIT 10")
def topk_cosine(spark, sf_dir):
    return search.top_k(load(spark, sf_dir, "embeddings"), _zero(spark, sf_dir), K).withColumn("score", F.round("score", 6))


@query("filtered_topk", "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]), 6) AS score FROM embeddings WHERE label IN (1, 3) ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]) DESC, vec_id LIMIT 10")
def filtered_topk(spark, sf_dir):
    return search.filtered_top_k(load(spark, sf_dir, "embeddings"), _zero(spark, sf_dir), K, F.col("label").isin(1, 3)).withColumn("score", F.round("score", 6))


@query(
    "vector_filters",
    "WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings JOIN pages ON page_id = vec_id JOIN events ON event_id = vec_id * 17 WHERE starts_with(url, 'https://') AND label IN (0, 1, 2, 3, 4, 5, 6) AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-28') SELECT vec_id, round(list_cosine_similarity(v, (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]), 6) AS score FROM c ORDER BY list_cosine_similarity(v, (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]) DESC, vec_id LIMIT 10",
)
def vector_filters(spark, sf_dir):
    """Vectors with the url of a page and the time of an event, searched among those of a prefix, some kinds and a span of time."""
    e, p, t = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "pages"), load(spark, sf_dir, "events")
    c = e.join(p.select(F.col("page_id").alias("vec_id"), "url"), "vec_id").join(t.where("event_id % 17 = 0").select((F.col("event_id") / 17).cast("long").alias("vec_id"), "ts"), "vec_id")
    wanted = search.typed_filter("https://", [0, 1, 2, 3, 4, 5, 6], "2024-01-05", "2024-01-28", url="url", kind="label", at="ts")
    return search.filtered_top_k(c, _zero(spark, sf_dir), K, wanted).select("vec_id", F.round("score", 6).alias("score"))


@query("batch_topk", f"WITH {COS} SELECT qid, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def batch_topk(spark, sf_dir):
    return batch(spark, sf_dir).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("dot_search", f"WITH {SCORED.format(fn='list_dot_product')} SELECT qid, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def dot_search(spark, sf_dir):
    return batch(spark, sf_dir, 5, unit=False).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 3)) / (3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS total, 1.0::DOUBLE AS length FROM embeddings")
def normalize(spark, sf_dir):
    tripled = load(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return tripled.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(norm("v"), 6).alias("length"))


@query("dim_check", "SELECT len(embedding)::INTEGER AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def dim_check(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))


def results(spark, sf_dir, k: int = K) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id"), "label")
    hits = batch(spark, sf_dir, k)
    out = hits.join(e.toDF("id", "id_label"), "id").join(e.toDF("qid", "label"), "qid")
    return out.withColumn("relevant", F.col("id_label") == F.col("label"))


PER_QUERY = "per_query AS (SELECT qid, any_value(qlabel) AS label, bool_or(relevant) AS hit, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS rr, max(score) AS top_score, avg(score) AS mean_score FROM ranked WHERE rank <= 5 GROUP BY qid)"


@query("eval_hit_mrr", f"WITH {COS}, {PER_QUERY} SELECT coalesce(CAST(label AS VARCHAR), 'all') AS label, count(*) AS queries, round(avg(hit::INT::DOUBLE), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM per_query GROUP BY GROUPING SETS ((), (label))")
def eval_hit_mrr(spark, sf_dir):
    r = results(spark, sf_dir)
    per_query = evaluation.hits_and_mrr(r, 5).join(r.select("qid", "label").distinct(), "qid")
    return evaluation.summary(per_query, "label")


@query("eval_scores", f"WITH {COS}, {PER_QUERY} SELECT qid, hit, round(rr, 6) AS rr, round(top_score, 6) AS top_score, round(mean_score, 6) AS mean_score FROM per_query")
def eval_scores(spark, sf_dir):
    return evaluation.hits_and_mrr(results(spark, sf_dir), 5).select("qid", "hit", *[F.round(c, 6).alias(c) for c in ("rr", "top_score", "mean_score")])


@query("score_floor", f"WITH {COS} SELECT qid, id, round(score, 6) AS score FROM ranked WHERE rank <= 10 AND score >= 0.30")
def floor(spark, sf_dir):
    return search.score_floor(batch(spark, sf_dir), 0.30).select("qid", "id", F.round("score", 6).alias("score"))


RELEVANT = "rel AS (SELECT qid, sum(relevant::INT) AS n_relevant, any_value(qlabel) FROM scored GROUP BY qid)"


def relevant(spark, sf_dir) -> DataFrame:
    """How many other vectors have a query's label, by grouped counts."""
    e = load(spark, sf_dir, "embeddings")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label").join(sizes, "label").select("qid", "n_relevant")


@query("ndcg", f"WITH {COS}, {RELEVANT}, got AS (SELECT qid, sum(CASE WHEN relevant THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM ranked WHERE rank <= 10 GROUP BY qid) SELECT qid, round(CASE WHEN n_relevant > 0 THEN dcg / list_sum(list_transform(range(1, (least(n_relevant, 10) + 1)::BIGINT), lambda i: 1 / log2(i + 1.0))) ELSE 0 END, 6) AS ndcg FROM rel JOIN got USING (qid)")
def ndcg(spark, sf_dir):
    return evaluation.ndcg(results(spark, sf_dir), relevant(spark, sf_dir)).withColumn("ndcg", F.round("ndcg", 6))


@query("recall_at_k", f"WITH {COS}, {RELEVANT} SELECT qid, round(sum((relevant AND rank <= 1)::INT) / any_value(n_relevant), 6) AS recall_1, round(sum((relevant AND rank <= 5)::INT) / any_value(n_relevant), 6) AS recall_5, round(sum((relevant AND rank <= 10)::INT) / any_value(n_relevant), 6) AS recall_10 FROM ranked JOIN rel USING (qid) GROUP BY qid")
def recall_at_k(spark, sf_dir):
    r = evaluation.recall_at(results(spark, sf_dir), relevant(spark, sf_dir), [1, 5, 10])
    return r.select("qid", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10")])


# Pools: the raw list of each query and two rewrites', whose vectors are those of the next two ids.
POOL = """lists AS (
  SELECT q.vec_id AS qid, r.i AS list_no, l.embedding::DOUBLE[] AS v, q.embedding::DOUBLE[] AS qv, q.label AS qlabel
  FROM embeddings q, (VALUES (0), (1), (2)) r(i), embeddings l WHERE q.vec_id % 50 = 0 AND l.vec_id = q.vec_id + r.i),
found AS (
  SELECT qid, list_no, qv, qlabel, e.vec_id AS id, e.embedding::DOUBLE[] AS ev, e.label AS elabel, list_cosine_similarity(v, e.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY qid, list_no ORDER BY round(list_cosine_similarity(v, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) - 1 AS rank0
  FROM lists, embeddings e WHERE e.vec_id <> qid + list_no),
pool AS (
  SELECT qid, list_no, rank0, id, 'passage ' || (id % 97) || ' of group ' || elabel AS text, score, list_cosine_similarity(qv, ev) AS original,
    'group ' || qlabel AS query, CASE WHEN qid % 100 = 0 THEN 'clinical' ELSE 'lay' END AS register
  FROM found WHERE rank0 < 10)"""


def pool(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("base"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("list_no")).withColumn("qid", F.col("base") + F.col("list_no"))
    lists = q.join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")
    hits = search.batch_top_k(lists.select("qid", "qvec"), e, K).withColumn("rank0", F.col("rank") - 1).drop("rank")
    hits = hits.join(lists.select("qid", "base", "list_no"), "qid").drop("qid").withColumnRenamed("base", "qid")
    own = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("ev"), F.col("label").alias("elabel"))
    asked = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("label").alias("qlabel"))
    joined = hits.join(own, "id").join(asked, "qid").withColumn("original", dot("ev", "qv") / (norm("ev") * norm("qv")))
    text = F.concat(F.lit("passage "), (F.col("id") % 97).cast("string"), F.lit(" of group "), F.col("elabel").cast("string"))
    return joined.select(
        "qid", "list_no", "rank0", "id", text.alias("text"), "score", "original", F.concat(F.lit("group "), F.col("qlabel").cast("string")).alias("query"),
        F.when(F.col("qid") % 100 == 0, "clinical").otherwise("lay").alias("register"),
    )


BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY score DESC, list_no, rank0) AS n FROM {src}) WHERE n = 1)"
LEX = "len(list_intersect(list_distinct(list_filter(string_split_regex(lower(query), '\\W+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(text), '\\W+'), lambda x: x <> '')))) / len(list_distinct(list_filter(string_split_regex(lower(query), '\\W+'), lambda x: x <> '')))"


@query("union_all_hits", f"WITH {POOL} SELECT qid, list_no AS leg, rank0::INTEGER AS rank0, id, round(score, 6) AS score FROM pool")
def union_all_hits(spark, sf_dir):
    p = pool(spark, sf_dir)
    legs = search.union_hits(*[p.where(F.col("list_no") == k) for k in range(3)])
    return legs.select("qid", "leg", "rank0", "id", F.round("score", 6).alias("score"))


@query("dedupe_keep_best", f"WITH {POOL}, {BEST.format(src='pool')} SELECT qid, text, id, list_no, round(score, 6) AS score FROM best")
def dedupe_keep_best(spark, sf_dir):
    return search.best_by_key(pool(spark, sf_dir), ["qid", "text"], rerank.ARRIVAL).select("qid", "text", "id", "list_no", F.round("score", 6).alias("score"))


def _ranking(spark, sf_dir, strategy: str, value: str) -> DataFrame:
    return rerank.rerank(strategy, pool(spark, sf_dir)).select("qid", "text", F.col("position").cast("long").alias("position"), F.round(value, 6).alias("value"))


_ORDERED = "SELECT qid, text, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS position, round({value}, 6) AS value FROM {src}"
query("rrf", f"WITH {POOL}, fused AS (SELECT qid, text, sum(1.0 / (60 + rank0)) AS value, min(list_no * 1000 + rank0) AS first FROM pool GROUP BY qid, text) " + _ORDERED.format(order="round(value, 9) DESC, first", value="value", src="fused"))(
    lambda s, d: _ranking(s, d, "rrf", "rrf")
)
query("cosine_dedup", f"WITH {POOL}, {BEST.format(src='(SELECT * FROM pool WHERE list_no > 0)')} " + _ORDERED.format(order="score DESC, list_no, rank0", value="score", src="best"))(lambda s, d: _ranking(s, d, "cosine_dedup", "score"))
query("cross_encoder", f"WITH {POOL}, {BEST.format(src='pool')} " + _ORDERED.format(order=f"{LEX} DESC, list_no, rank0", value=LEX, src="best"))(lambda s, d: _ranking(s, d, "cross_encoder", "pair_score"))
_aware = BEST.format(src="(SELECT * FROM pool WHERE register <> 'clinical' OR list_no = 0)")
query("register_aware", f"WITH {POOL}, {_aware} " + _ORDERED.format(order=f"{LEX} DESC, list_no, rank0", value=LEX, src="best"))(lambda s, d: _ranking(s, d, "register_aware", "pair_score"))
query("cosine_original", f"WITH {POOL}, {BEST.format(src='pool')} " + _ORDERED.format(order="round(original, 9) DESC, list_no, rank0", value="original", src="best"))(lambda s, d: _ranking(s, d, "cosine_original", "original"))
for _a in (3, 5, 7):
    _mm = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END"
    query(
        f"hybrid_alpha_0{_a}",
        f"WITH {POOL}, {BEST.format(src='pool')}, lex AS (SELECT *, {LEX} AS ce FROM best), mixed AS (SELECT *, {_a / 10} * ({_mm.format(c='ce')}) + {1 - _a / 10} * ({_mm.format(c='score')}) AS value FROM lex WINDOW w AS (PARTITION BY qid)) "
        + _ORDERED.format(order="round(value, 9) DESC, list_no, rank0", value="value", src="mixed"),
    )(lambda s, d, a=_a: _ranking(s, d, f"hybrid_0{a}", "hybrid"))


@query("llm_rank_parse", f"WITH {POOL}, {BEST.format(src='pool')}, base AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_no, rank0) AS p FROM best), placed AS (SELECT *, list_position([2, 0, 99, 1], (p - 1)::INTEGER) AS spot FROM base) SELECT qid, text, row_number() OVER (PARTITION BY qid ORDER BY coalesce(spot, 2147483647), p) AS position FROM placed")
def llm_rank_parse(spark, sf_dir):
    answered = pool(spark, sf_dir).withColumn("answer", F.lit("Here: [2, 0, 99, 1, 0] done"))
    return rerank.rerank("llm", answered).select("qid", "text", F.col("position").cast("long").alias("position"))


RAW_NEW = """ranks AS (SELECT qid, list_no, rank0 + 1 AS rank, elabel = qlabel AS relevant FROM found WHERE rank0 < 5),
pq AS (SELECT qid, CASE WHEN qid % 100 = 0 THEN 'clinical' ELSE 'lay' END AS register,
  coalesce(max((list_no = 0 AND relevant)::INT), 0) AS raw_hit, coalesce(max((list_no = 1 AND relevant)::INT), 0) AS new_hit,
  coalesce(1.0 / min(CASE WHEN list_no = 0 AND relevant THEN rank END), 0) AS raw_rr, coalesce(1.0 / min(CASE WHEN list_no = 1 AND relevant THEN rank END), 0) AS new_rr FROM ranks GROUP BY qid)"""


def raw_and_new(spark, sf_dir) -> DataFrame:
    p = pool(spark, sf_dir).where("rank0 < 5")
    labels = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = p.join(labels.toDF("id", "il"), "id").join(labels.toDF("qid", "ql"), "qid").withColumn("relevant", F.col("il") == F.col("ql"))
    hit = lambda k: F.coalesce(F.max(((F.col("list_no") == k) & F.col("relevant")).cast("int")), F.lit(0))
    rr = lambda k: F.coalesce(1.0 / F.min(F.when((F.col("list_no") == k) & F.col("relevant"), F.col("rank0") + 1)), F.lit(0.0))
    return r.groupBy("qid", "register").agg(hit(0).alias("raw_hit"), hit(1).alias("new_hit"), rr(0).alias("raw_rr"), rr(1).alias("new_rr"))


@query("rewrite_lift_grouping_sets", f"WITH {POOL}, {RAW_NEW}, g AS (SELECT coalesce(register, 'all') AS register, count(*) AS queries, round(avg(raw_hit), 6) AS raw_hit, round(avg(new_hit), 6) AS new_hit, round(avg(raw_rr), 6) AS raw_rr, round(avg(new_rr), 6) AS new_rr FROM pq GROUP BY GROUPING SETS ((), (register))) SELECT *, round(new_hit - raw_hit, 6) AS hit_delta, round(new_rr - raw_rr, 6) AS rr_delta FROM g")
def rewrite_lift(spark, sf_dir):
    return evaluation.lift(raw_and_new(spark, sf_dir), "register")


@query("improved_regressed", f"WITH {POOL}, {RAW_NEW} SELECT qid, CASE WHEN new_rr > raw_rr THEN 'improved' ELSE 'regressed' END AS change FROM pq WHERE new_rr <> raw_rr")
def improved_regressed(spark, sf_dir):
    return evaluation.changed(raw_and_new(spark, sf_dir)).select("qid", "change")


@query("scoreboard", f"WITH {POOL}, {RAW_NEW} SELECT s AS strategy, register, 'mrr' AS metric, round(avg(v), 4) AS mean, count(*) AS n FROM (SELECT 'raw' AS s, register, raw_rr AS v FROM pq UNION ALL SELECT 'rewrite', register, new_rr FROM pq) GROUP BY ALL")
def scoreboard(spark, sf_dir):
    p = raw_and_new(spark, sf_dir).withColumn("s", F.explode(F.array(F.struct(F.lit("raw").alias("strategy"), F.col("raw_rr").alias("value")), F.struct(F.lit("rewrite").alias("strategy"), F.col("new_rr").alias("value")))))
    return evaluation.scoreboard(p.select("register", "s.strategy", "s.value", F.lit("mrr").alias("metric")))


@query("retrieve", f"WITH {POOL}, texts AS (SELECT *, 'passage ' || (id % 97) || ' of group ' || elabel AS text FROM found WHERE rank0 < 10), {BEST.format(src='texts')}, cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, list_no, rank0 + 1, id) AS position FROM best) SELECT qid AS request, text, id, position, round(score, 6) AS score FROM cut WHERE position <= 10")
def retrieve(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("passage "), (F.col("vec_id") % 97).cast("string"), F.lit(" of group "), F.col("label").cast("string")).alias("chunk_text"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("request"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("list_no")).withColumn("qid", F.col("request") + F.col("list_no"))
    q = q.join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")
    return search.retrieve(q, chunks, K).select("request", F.col("chunk_text").alias("text"), "id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"))
