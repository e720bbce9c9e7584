"""Catalog operators: listings, cards, registration, lifecycle; joins of small governed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# States a source may go to from each state.
TRANSITIONS = [
    ("draft", "curated"),
    ("draft", "retired"),
    ("curated", "published"),
    ("curated", "retired"),
    ("published", "curated"),
    ("published", "retired"),
]
AGENT_VISIBLE = ["curated", "published"]


def list_sources(sources: DataFrame, indexes: DataFrame) -> DataFrame:
    """Curated and published sources with the document count of their active index, null if none."""
    counts = indexes.select(F.col("id").alias("active_index"), "document_count")
    return sources.where(F.col("status").isin(AGENT_VISIBLE)).join(counts, "active_index", "left").select("slug", "name", "family", "status", "document_count")


def describe_source(sources: DataFrame, prompts: DataFrame) -> DataFrame:
    """Sources with their sample prompts as a list in order; null where there are none."""
    listed = prompts.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " | ").alias("prompts"), F.count("*").alias("n_prompts"))
    return sources.join(listed, "slug", "left").select("slug", "prompts", "n_prompts")


def active_recipe(sources: DataFrame, indexes: DataFrame, recipes: DataFrame) -> DataFrame:
    """Source, active index and recipe version; sources without either are left out."""
    i = indexes.select(F.col("id").alias("active_index"), "location", "recipe_id")
    r = recipes.select(F.col("id").alias("recipe_id"), "version", "model", "url")
    return sources.select("slug", "active_index").join(i, "active_index").join(r, "recipe_id").select("slug", "location", "version", "model", "url")


def recipe_attributes(sources: DataFrame, indexes: DataFrame, recipes: DataFrame) -> DataFrame:
    """``slug``, ``github_repo``, ``embedding_model`` of each source, as its active index's recipe has them; null where any of it is missing."""
    i = indexes.select(F.col("id").alias("active_index"), "recipe_id")
    content = F.from_json("content", "github_repo string, embedding struct<model: string>")
    r = recipes.select(F.col("id").alias("recipe_id"), content.alias("c"))
    joined = sources.select("slug", "active_index").join(i, "active_index", "left").join(r, "recipe_id", "left")
    return joined.select("slug", F.col("c.github_repo").alias("github_repo"), F.col("c.embedding.model").alias("embedding_model"))


def endpoint_health(recipes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Health of each recipe's model: null without a model, ``unknown`` where it is not registered; and the url to call."""
    e = endpoints.select(F.col("model_name").alias("model"), F.col("url").alias("registered"), F.col("status").alias("health"))
    joined = recipes.join(e, "model", "left")
    return joined.select(
        "slug", "version", "model", F.when(F.col("model").isNotNull(), F.coalesce("health", F.lit("unknown"))).alias("health"), F.coalesce("registered", "url").alias("endpoint")
    )


def latest_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` runs of each source, those not started last; with their duration in seconds."""
    order = Window.partitionBy("slug").orderBy(F.desc_nulls_last("started"), F.desc("run_id"))
    seconds = (F.unix_micros("completed") - F.unix_micros("started")) / 1e6
    return runs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).withColumn("seconds", seconds).select("slug", "run_id", "position", "status", "seconds")


def latest_index(indexes: DataFrame) -> DataFrame:
    order = Window.partitionBy("location", "slug").orderBy(F.desc("built"), F.desc("id"))
    return indexes.withColumn("n", F.row_number().over(order)).where("n = 1").select("location", "slug", "id")


def register_versions(recipes: DataFrame, incoming: DataFrame) -> DataFrame:
    """The version each incoming recipe gets: that of equal content (by hash), else the largest and one."""
    known = recipes.select("slug", F.sha2("content", 256).alias("h"), "version")
    top = recipes.groupBy("slug").agg(F.max("version").alias("top"))
    same = known.groupBy("slug", "h").agg(F.min("version").alias("same"))
    new = incoming.withColumn("h", F.sha2("content", 256))
    joined = new.join(same, ["slug", "h"], "left").join(top, "slug", "left")
    return joined.select("slug", "content", F.coalesce("same", F.coalesce("top", F.lit(0)) + 1).alias("version"), F.col("same").isNotNull().alias("reused"))


def upsert(table: DataFrame, incoming: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Rows of ``table`` with ``update`` columns of ``incoming`` where the key is there; new keys are appended whole."""
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in update])
    changed = table.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in update else F.col(c) for c in table.columns])
    return changed.unionByName(incoming.join(table, key, "left_anti"), allowMissingColumns=True)


def annotate(chunks: DataFrame, notes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with all notes on them (``note``, ``at``), oldest first; texts and vectors stay as they are."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x["note"])
    return chunks.join(notes.groupBy(key).agg(listed.alias("notes")), key, "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def audit_records(writes: DataFrame, sources: DataFrame, indexes: DataFrame, recipes: DataFrame) -> DataFrame:
    """One record for each write (``request_id``, ``sub``, ``slug``, ``mode``, ``item_id``): who wrote which items, by which recipe version."""
    version = active_recipe(sources, indexes, recipes).select("slug", F.col("version").alias("recipe_version"))
    items = F.array_sort(F.collect_set("item_id"))
    return writes.groupBy("request_id", "sub", "slug", "mode").agg(items.alias("item_ids")).join(version, "slug", "left")


def insert_if_absent(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return table.unionByName(incoming.join(table, key, "left_anti"), allowMissingColumns=True)


def delete_by_prefix(table: DataFrame, column: str, prefix: str) -> DataFrame:
    return table.where(~F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Changes of state (``old``, ``new``) that the lifecycle doesn't allow; keeping a state is allowed."""
    allowed = changes.sparkSession.createDataFrame(TRANSITIONS, "old string, new string")
    return changes.where("old <> new").join(F.broadcast(allowed), ["old", "new"], "left_anti")


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def search_catalog(sources: DataFrame, needle: str, family: str | None = None, visibility: str | None = None) -> DataFrame:
    """Sources whose name, slug, description or a tag holds the needle, whatever the case."""
    n = F.lit(needle.lower())
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), n)
    found = holds(F.col("name")) | holds(F.col("slug")) | holds(F.col("description")) | F.exists("tags", holds)
    if family:
        found = found & (F.col("family") == family)
    if visibility:
        found = found & (F.col("visibility") == visibility)
    return sources.where(found)


def admin_rollup(sources: DataFrame) -> DataFrame:
    """Counts by state, and of sources with an unhealthy index."""
    flagged = F.col("health").isin("degraded", "failed")
    return sources.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.coalesce(flagged, F.lit(False))).alias("flagged"))


def best_run(runs: DataFrame, score: str = "recall_at_5") -> DataFrame:
    """The best score of each source's runs, the first of equals, and how many runs there are."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return runs.groupBy("slug").agg(F.max(s).alias("best"), F.max_by("run_id", F.struct(s, -F.col("run_id"))).alias("run_id"), F.count("*").alias("runs"))


def source_card(sources: DataFrame, indexes: DataFrame, recipes: DataFrame, runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row for each source: recipe, versions, runs and prompts, gathered before they are joined."""
    versions = recipes.groupBy("slug").agg(F.array_join(F.transform(F.sort_array(F.collect_list("version"), False), lambda v: v.cast("string")), ",").alias("versions"))
    history = runs.groupBy("slug").agg(F.count("*").alias("runs"), F.max("recall_at_5").alias("best"))
    asked = prompts.groupBy("slug").agg(F.count("*").alias("n_prompts"))
    active = active_recipe(sources, indexes, recipes).select("slug", "version", "model", "location")
    card = sources.select("slug", "name", "status").join(active, "slug", "left").join(versions, "slug", "left").join(history, "slug", "left").join(asked, "slug", "left")
    return card.select(
        "slug", "name", "status", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("versions", F.lit("")).alias("versions"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("n_prompts", F.lit(0)).alias("n_prompts"),
    )


def publishable(sources: DataFrame, indexes: DataFrame, runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Curated sources with a healthy index, an evaluation and a sample prompt."""
    healthy = indexes.where("health = 'ok'").select(F.col("id").alias("active_index"))
    out = sources.where("status = 'curated'").join(healthy, "active_index", "left_semi")
    return out.join(runs, "slug", "left_semi").join(prompts, "slug", "left_semi").select("slug")
