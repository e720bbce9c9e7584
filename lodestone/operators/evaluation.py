"""Retrieval quality: hit rate, reciprocal rank, lift, precision and recall, scoreboards, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits_and_mrr(results: DataFrame, k: int = 5) -> DataFrame:
    """``qid``, ``hit``, ``rr``, ``top_score``, ``mean_score`` of ranked results (``qid``, ``rank``, ``relevant``, ``score``)."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return (
        results.where(F.col("rank") <= k)
        .groupBy("qid")
        .agg(first.alias("first"), F.max("score").alias("top_score"), F.avg("score").alias("mean_score"))
        .select("qid", F.col("first").isNotNull().alias("hit"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"), "top_score", "mean_score")
    )


def summary(per_query: DataFrame, group: str) -> DataFrame:
    """Overall (``all``) and per group: queries, hit rate, mean reciprocal rank."""
    out = per_query.groupingSets([[], [group]], group).agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr")
    )
    return out.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("all")))


def lift(per_query: DataFrame, group: str) -> DataFrame:
    """Raw and rewritten hit rate and reciprocal rank and their differences, overall and per group."""
    avg = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    out = per_query.groupingSets([[], [group]], group).agg(F.count("*").alias("queries"), *[avg(c).alias(c) for c in ("raw_hit", "new_hit", "raw_rr", "new_rr")])
    return out.select(
        F.coalesce(F.col(group).cast("string"), F.lit("all")).alias(group), "queries", "raw_hit", "new_hit", "raw_rr", "new_rr",
        F.round(F.col("new_hit") - F.col("raw_hit"), 6).alias("hit_delta"), F.round(F.col("new_rr") - F.col("raw_rr"), 6).alias("rr_delta"),
    )


def precision_recall(queried: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and exact match of two sets; nothing queried is precise, nothing expected is recalled."""
    both = F.size(F.array_intersect(queried, expected))
    n, m = F.size(F.array_distinct(queried)), F.size(F.array_distinct(expected))
    precision = F.when((n == 0) & (m == 0), 1.0).when(n == 0, 1.0).otherwise(both / n)
    recall = F.when(m == 0, F.when(n == 0, 1.0).otherwise(0.0)).otherwise(both / m)
    precision = F.when((m == 0) & (n > 0), 0.0).otherwise(precision)
    recall = F.when((n == 0) & (m > 0), 0.0).when(m == 0, 1.0).otherwise(recall)
    exact = F.array_sort(F.array_distinct(queried)) == F.array_sort(F.array_distinct(expected))
    return precision, recall, exact


def scoreboard(scores: DataFrame) -> DataFrame:
    """Mean of each metric for each strategy and register, to four places; missing values are left out."""
    return scores.where("value IS NOT NULL").groupBy("strategy", "register", "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


def changed(per_query: DataFrame) -> DataFrame:
    """Queries whose reciprocal rank rose or fell."""
    delta = F.col("new_rr") - F.col("raw_rr")
    return per_query.withColumn("change", F.when(delta > 0, "improved").when(delta < 0, "regressed")).where("change IS NOT NULL")


def winner(configs: DataFrame) -> DataFrame:
    """The configuration of the best hit rate, then reciprocal rank, then fewest chunks."""
    return configs.orderBy(F.desc("hit_rate"), F.desc("mrr"), "chunks", "config").limit(1)


def ndcg(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Binary nDCG at ``k``. ``relevant``: ``qid``, ``n_relevant``."""
    gain = F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    got = results.where(F.col("rank") <= k).groupBy("qid").agg(gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_relevant", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return relevant.join(got, "qid", "left").select("qid", F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(F.lit(0.0)).alias("ndcg"))


def latency_percentiles(calls: DataFrame, group: str, ms: str = "ms") -> DataFrame:
    """Calls and exact p50, p95 and p99 of their latency for each group; calls without one don't count."""
    share = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = calls.where(F.col(ms).isNotNull()).groupBy(group).agg(F.count("*").alias("calls"), share.alias("p"))
    return out.select(group, "calls", *[F.round(F.get("p", F.lit(k)), 6).alias(name) for k, name in enumerate(("p50", "p95", "p99"))])


def rank_error(k: int) -> float:
    """Share of ranks that a quantile of a sketch of size ``k`` is off by at most, in 99 of 100 sketches."""
    return 2.296 / k**0.9021


def latency_sketch(calls: DataFrame, group: list[str], ms: str = "ms", k: int = 400) -> DataFrame:
    """Calls and a mergeable sketch of their latency for each group: tasks send sketches of some kilobytes, never a group's values."""
    known = calls.where(F.col(ms).isNotNull() & ~F.isnan(F.col(ms).cast("double")))
    return known.groupBy(*group).agg(F.count("*").alias("calls"), F.kll_sketch_agg_double(F.col(ms).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """The sketches of several parts, such as days, as one for each group."""
    return sketches.groupBy(*group).agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """A column for each named share: the latency at that rank, to ``rank_error``."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in shares.items()}).drop("sketch")


def recall_at(results: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    hits = [F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"h{k}") for k in ks]
    got = results.groupBy("qid").agg(*hits)
    share = lambda k: F.when(F.col("n_relevant") > 0, F.coalesce(f"h{k}", F.lit(0)) / F.col("n_relevant")).otherwise(F.lit(0.0)).alias(f"recall_{k}")
    return relevant.join(got, "qid", "left").select("qid", *[share(k) for k in ks])


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``qid``, id and score of documents that share a word with a query: grouped counts and joins on words."""
    from lodestone.functions.text import tokens

    q = queries.select("qid", F.explode(F.array_distinct(tokens(F.lower("query")))).alias("w"))
    wanted = q.select("w").distinct()
    split = docs.select(id_col, tokens(F.lower(text)).alias("words"))
    lengths = split.select(id_col, F.size("words").alias("len"))
    whole = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
    tf = split.select(id_col, "words", F.explode("words").alias("w")).select(id_col, F.size("words").alias("len"), "w").join(F.broadcast(wanted) if wanted.count() <= 100_000 else wanted, "w").groupBy("w", id_col, "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return q.join(tf, "w").join(df, "w").crossJoin(F.broadcast(whole)).groupBy("qid", id_col).agg(F.sum(part).alias("score"))
