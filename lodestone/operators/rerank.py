"""Fusion and reranking of result lists.

Pools are DataFrames of ``qid``, ``list_no`` (0: the raw query, above: its rewrites),
``rank0`` (from 0), ``text``, ``score`` and whatever else. Ties go to what came first:
the smaller list, then the smaller rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.search import best_by_key

RRF_K = 60
ARRIVAL = ["list_no", "rank0"]


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``position`` (from 1) within each query."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def cosine_dedup(pool: DataFrame) -> DataFrame:
    """Rewrites only: the best score of each text."""
    return ranked(best_by_key(pool.where("list_no > 0"), ["qid", "text"], ARRIVAL), F.desc("score"), *ARRIVAL)


def rrf(pool: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion by text, over all lists, ranks from 0."""
    first = F.min(F.struct(*ARRIVAL))
    fused = pool.groupBy("qid", "text").agg(F.sum(F.lit(1.0) / (k + F.col("rank0"))).alias("rrf"), first.alias("first"))
    return ranked(fused, F.desc(F.round("rrf", 9)), "first").drop("first")


def lexical_score(query: Column, text: Column) -> Column:
    """The share of the query's distinct words that stand in the text: the offline scorer of pairs."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != ""))
    asked = words(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)).otherwise(F.lit(0.0))


def pair_rerank(pool: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """The pool, one row for each text, by a score of query and text (column ``query``)."""
    best = best_by_key(pool, ["qid", "text"], ARRIVAL)
    return ranked(best.withColumn("pair_score", scorer(F.col("query"), F.col("text"))), F.desc("pair_score"), *ARRIVAL)


def register_aware(pool: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """As ``pair_rerank``, but clinical queries (column ``register``) keep to the raw list."""
    return pair_rerank(pool.where("register <> 'clinical' OR list_no = 0"), scorer)


def min_max(value: str) -> Column:
    """Within a query to 0 … 1; 0.5 for all where they are equal."""
    w = Window.partitionBy("qid")
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.5))


def hybrid(pool: DataFrame, alpha: float, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """``alpha`` of the normalised pair score and the rest of the normalised cosine."""
    scored = best_by_key(pool, ["qid", "text"], ARRIVAL).withColumn("pair_score", scorer(F.col("query"), F.col("text")))
    mixed = scored.withColumn("hybrid", alpha * min_max("pair_score") + (1 - alpha) * min_max("score"))
    return ranked(mixed, F.desc(F.round("hybrid", 9)), *ARRIVAL)


def cosine_original(pool: DataFrame) -> DataFrame:
    """The pool by cosine to the original query (column ``original``), one row for each text."""
    first = best_by_key(pool, ["qid", "text"], ARRIVAL)
    return ranked(first, F.desc(F.round("original", 9)), *ARRIVAL)


def model_order(pool: DataFrame, answer: str = "answer") -> DataFrame:
    """By a model's answer, a JSON array of positions (from 0): those out of range and repeats go, the rest follow in order."""
    base = ranked(best_by_key(pool, ["qid", "text"], ARRIVAL), *ARRIVAL)
    asked = F.array_distinct(F.coalesce(F.from_json(F.regexp_extract(answer, r"(\[[^\]]*\])", 1), "array<int>"), F.array().cast("array<int>")))
    place = F.array_position(asked, (F.col("position") - 1).cast("int"))
    return ranked(base.withColumn("_p", F.when(place > 0, place).otherwise(F.lit(2**31 - 1))), "_p", "position").drop("_p")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "cosine_dedup": cosine_dedup,
    "rrf": rrf,
    "cross_encoder": pair_rerank,
    "register_aware": register_aware,
    "hybrid_03": lambda pool: hybrid(pool, 0.3),
    "hybrid_05": lambda pool: hybrid(pool, 0.5),
    "hybrid_07": lambda pool: hybrid(pool, 0.7),
    "cosine_original": cosine_original,
    "llm": model_order,
}


def rerank(strategy: str, pool: DataFrame) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](pool)
