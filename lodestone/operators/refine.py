"""Expansion of hits into context: neighbours, sections, related documents, entity arcs, under token budgets.

Origins are DataFrames of ``oid``, ``doc_title``, ``chunk_index``; a whole set of origins is
expanded by one plan. Chunks: ``chunk_id``, ``doc_title``, ``doc_section``,
``chunk_index``, ``chunk_text``, ``chunk_tokens`` and, where a vector is needed,
``embedding``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import cosine
from lodestone.operators.search import best_by_key

WINDOW = 2
FLOOR = 0.30
# Strategies of source families.
FAMILY_STRATEGY = {"document": "section", "clinical_document": "section", "code": "adjacent"}


def _renamed(origins: DataFrame) -> DataFrame:
    return origins.select("oid", F.col("doc_title").alias("o_title"), F.col("chunk_index").alias("o_index"))


def adjacent(origins: DataFrame, chunks: DataFrame, window: int = WINDOW) -> DataFrame:
    """Chunks within ``window`` of each origin; the wanted places are listed so that the join is on equality alone."""
    wanted = _renamed(origins).withColumn("chunk_index", F.explode(F.sequence(F.greatest(F.lit(0), F.col("o_index") - window), F.col("o_index") + window)))
    found = wanted.withColumnRenamed("o_title", "doc_title").join(chunks, ["doc_title", "chunk_index"])
    return found.withColumn("is_origin", F.col("chunk_index") == F.col("o_index"))


def section(origins: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of each origin's section; the origin alone where it has none; nothing where it doesn't exist."""
    at = _renamed(origins).join(
        chunks.select(F.col("doc_title").alias("o_title"), F.col("chunk_index").alias("o_index"), F.nullif("doc_section", F.lit("")).alias("o_section")), ["o_title", "o_index"]
    )
    named = at.where("o_section IS NOT NULL").join(chunks, (F.col("o_title") == F.col("doc_title")) & (F.col("o_section") == F.col("doc_section")))
    alone = at.where("o_section IS NULL").join(chunks, (F.col("o_title") == F.col("doc_title")) & (F.col("o_index") == F.col("chunk_index")))
    return named.unionByName(alone).withColumn("is_origin", F.col("chunk_index") == F.col("o_index")).drop("o_title", "o_section")


def parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """For hits on small chunks, the section that they stand in: ``qid``, its title, section, text, tokens, best score and number of hits.

    Hits are gathered by section first, so that a section is put together once however many
    of its chunks were hit; a chunk without a section is its own parent. ``hits``: ``qid``,
    ``doc_title``, ``chunk_index``, ``score``.
    """
    place = lambda: F.when(F.nullif("doc_section", F.lit("")).isNotNull(), F.concat(F.lit("s"), "doc_section")).otherwise(F.concat(F.lit("c"), F.col("chunk_index").cast("string")))
    placed = chunks.withColumn("_parent", place())
    at = hits.join(placed.select("doc_title", "chunk_index", "_parent"), ["doc_title", "chunk_index"])
    best = at.groupBy("qid", "doc_title", "_parent").agg(F.max("score").alias("score"), F.count("*").alias("hits"))
    wanted = best.select("doc_title", "_parent").distinct()
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])
    text = placed.join(wanted, ["doc_title", "_parent"], "left_semi").groupBy("doc_title", "_parent").agg(
        F.array_join(parts, "\n\n").alias("text"), F.sum("chunk_tokens").alias("tokens"), F.first("doc_section").alias("doc_section")
    )
    return best.join(text, ["doc_title", "_parent"]).drop("_parent")


def related_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity``, ``related``, ``pos``: one hop; edges marked bidirectional go both ways.

    ``edges``: ``source_entity``, ``target_entity``, ``directionality``, ``pos``. Two
    equi-joins' worth of oriented edges instead of one join on either end.
    """
    forward = edges.select(F.col("source_entity").alias("entity"), F.col("target_entity").alias("related"), "pos")
    back = edges.where("directionality = 'bidirectional'").select(F.col("target_entity").alias("entity"), F.col("source_entity").alias("related"), "pos")
    return forward.unionAll(back).join(entities.select(F.col("name").alias("entity")), "entity", "left_semi")


def related_titles(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_title``, ``titles``: documents of the entities one hop from a document's (first) entity, in order, each once.

    ``entities``: ``name``, ``pos``, ``doc_titles`` (array).
    """
    listed = entities.select("name", "pos", F.posexplode("doc_titles").alias("t", "doc_title"))
    owner = listed.groupBy("doc_title").agg(F.min_by("name", "pos").alias("entity"))
    hop = owner.join(related_entities(entities, edges).withColumnRenamed("pos", "edge_pos"), "entity")
    target = listed.select(F.col("name").alias("related"), "t", F.col("doc_title").alias("target"))
    found = hop.join(target, "related").where("target <> doc_title")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("edge_pos", "t", "target"))), lambda x: x["target"])
    return found.groupBy("doc_title").agg(F.array_distinct(ordered).alias("titles"))


def aliases_of(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``qid``, ``aliases``: of the first entity of that name, whatever its case; empty where there is none."""
    named = queries.select("qid", F.lower("query").alias("n")).join(entities.select(F.lower("name").alias("n"), "pos", "aliases"), "n")
    first = named.groupBy("qid").agg(F.min_by("aliases", "pos").alias("aliases"))
    return queries.select("qid").join(first, "qid", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def cross_reference(origins: DataFrame, chunks: DataFrame, titles: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each origin first, with score 1.0, then the ``window`` best chunks of related documents by similarity to its ``qvec``."""
    own = origins.join(chunks, ["doc_title", "chunk_index"]).withColumn("score", F.lit(1.0)).withColumn("position", F.lit(0)).drop("embedding", "qvec")
    targets = origins.select("oid", "doc_title", "qvec").join(titles, "doc_title").select("oid", "qvec", F.explode("titles").alias("doc_title"))
    scored = targets.join(chunks, "doc_title").withColumn("score", cosine("embedding", "qvec")).drop("qvec", "embedding")
    order = Window.partitionBy("oid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    best = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= window)
    return own.unionByName(best)


def entity_arc(queries: DataFrame, chunks: DataFrame, aliases: DataFrame, window: int, floor: float = FLOOR) -> DataFrame:
    """The ``window`` best chunks of a document by vector together with all that name the entity or an alias.

    The better score of a chunk counts (vector wins ties), those under ``floor`` go, and
    document order is restored. ``queries``: ``qid``, ``query``, ``doc_title``, ``qvec``.
    """
    scored = queries.join(chunks, "doc_title").withColumn("score", cosine("embedding", "qvec")).drop("qvec", "embedding")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    by_vector = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= window).drop("n").withColumn("leg", F.lit(0))
    names = scored.join(aliases, "qid")
    holds = F.exists(F.concat(F.array("query"), "aliases"), lambda a: F.contains(F.lower("chunk_text"), F.lower(a)))
    by_name = names.where(holds).drop("aliases").withColumn("leg", F.lit(1))
    return best_by_key(by_vector.unionByName(by_name), ["qid", "chunk_index"], ["leg"]).where(F.col("score") >= floor).drop("leg")


def budget_prefix(rows: DataFrame, key: str, budget: int | Column, cost: str = "chunk_tokens", order: list[Column | str] | None = None, spent: int | Column = 0) -> DataFrame:
    """Best rows first until the first that overflows; adds ``truncated`` and ``total_chunks`` (only if truncated)."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    w = Window.partitionBy(key).orderBy(*(order or [F.desc("score"), "chunk_index"])).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    marked = rows.withColumn("_fits", F.sum(cost).over(w) + spent <= budget).withColumn("_total", F.count("*").over(whole))
    kept = marked.withColumn("_kept", F.count_if("_fits").over(whole)).where("_fits")
    return _with_totals(kept)


def _with_totals(kept: DataFrame) -> DataFrame:
    truncated = F.col("_kept") < F.col("_total")
    return kept.withColumn("truncated", truncated).withColumn("total_chunks", F.when(truncated, F.col("_total"))).drop("_fits", "_kept", "_total", "_n")


def budget_skip(rows: DataFrame, key: str, budget: int, cost: str = "chunk_tokens", position: str = "chunk_index") -> DataFrame:
    """Best rows first, passing over those that overflow; then in document order.

    A running state that no window expresses: a fold over a key's rows, which are bounded by a document.
    """
    grouped = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(position).alias("p"), F.col(cost).cast("long").alias("c")))).alias("items"),
        F.count("*").alias("_total"),
    )
    start = F.expr("named_struct('used', 0L, 'kept', CAST(array() AS array<int>))")

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["c"] <= budget
        used = F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"])
        kept = F.when(fits, F.concat(acc["kept"], F.array(x["p"].cast("int")))).otherwise(acc["kept"])
        return F.struct(used.alias("used"), kept.alias("kept"))

    folded = grouped.select(key, "_total", F.aggregate("items", start, step, lambda a: a["kept"]).alias("kept"))
    flat = folded.select(key, "_total", F.size("kept").alias("_kept"), F.explode("kept").alias(position))
    return _with_totals(rows.join(flat, [key, position]))


def budget_outward(rows: DataFrame, key: str, budget: int, cost: str = "chunk_tokens", position: str = "chunk_index", origin: str = "o_index") -> DataFrame:
    """From the origin outwards, before and after in turn, each side until its first misfit; the origin always stays."""
    far = F.abs(F.col(position) - F.col(origin))
    after = (F.col(position) > F.col(origin)).cast("int")
    grouped = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(far.alias("d"), after.alias("after"), F.col(position).alias("p"), F.col(cost).cast("long").alias("c")))).alias("items"),
        F.count("*").alias("_total"),
    )
    start = F.expr("named_struct('used', 0L, 'before', true, 'after', true, 'kept', CAST(array() AS array<int>))")

    def step(acc: Column, x: Column) -> Column:
        own = x["d"] == 0
        open_ = F.when(x["after"] == 1, acc["after"]).otherwise(acc["before"])
        fits = own | (open_ & (acc["used"] + x["c"] <= budget))
        return F.struct(
            F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"),
            F.when((x["after"] == 0) & ~fits, F.lit(False)).otherwise(acc["before"]).alias("before"),
            F.when((x["after"] == 1) & ~fits, F.lit(False)).otherwise(acc["after"]).alias("after"),
            F.when(fits, F.concat(acc["kept"], F.array(x["p"].cast("int")))).otherwise(acc["kept"]).alias("kept"),
        )

    folded = grouped.select(key, "_total", F.aggregate("items", start, step, lambda a: a["kept"]).alias("kept"))
    flat = folded.select(key, "_total", F.size("kept").alias("_kept"), F.explode("kept").alias(position))
    return _with_totals(rows.join(flat, [key, position]))


def resolve_strategy(requests: DataFrame) -> DataFrame:
    """``strategy``, ``max_tokens``, ``window``, ``min_score`` of each request.

    ``requests``: ``tool_strategy``, ``tool_max_tokens``, ``tool_window``, ``family`` and
    ``strategies``, array<struct<kind, enabled, max_context_tokens, window, min_score>> or null.
    """
    enabled = F.filter(F.coalesce("strategies", F.expr("CAST(array() AS array<struct<kind: string, enabled: boolean, max_context_tokens: int, window: int, min_score: double>>)")), lambda s: s["enabled"])
    asked = F.filter(enabled, lambda s: F.col("tool_strategy").isNull() | (s["kind"] == F.col("tool_strategy")))
    config = F.get(asked, F.lit(0))
    family = F.lit("adjacent")
    for name, strategy in FAMILY_STRATEGY.items():
        family = F.when(F.col("family") == name, strategy).otherwise(family)
    return requests.select(
        "*",
        F.coalesce("tool_strategy", config["kind"], family).alias("strategy"),
        F.coalesce("tool_max_tokens", config["max_context_tokens"]).alias("max_tokens"),
        F.coalesce("tool_window", config["window"], F.lit(WINDOW)).alias("window"),
        config["min_score"].alias("min_score"),
    )


def batch_refine(hits: DataFrame, chunks: DataFrame, window: int = WINDOW) -> DataFrame:
    """Neighbourhoods of all hits of a query, each chunk once (first seen), in document order.

    ``hits``: ``qid``, ``rank``, ``doc_title``, ``chunk_index``.
    """
    origins = hits.withColumn("oid", F.struct("qid", "rank"))
    near = adjacent(origins, chunks, window).withColumn("qid", F.col("oid.qid")).withColumn("rank", F.col("oid.rank"))
    order = Window.partitionBy("qid", "doc_title", "chunk_index").orderBy("rank")
    first = near.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "oid")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("doc_title", "chunk_index")))


def resolve_chunk_id(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_title`` and ``chunk_index`` of chunk ids; ``found`` is false for ids that no chunk has."""
    known = chunks.select("chunk_id", "doc_title", "chunk_index", F.lit(True).alias("found"))
    return requests.join(known, "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

