"""Smaller operators: imports of evaluation runs, samples, metric maps, cards, formats, nested fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.plans.base import INDEXES, PROMPTS, RECIPES, SOURCES, Fixture, load, query, tagged, with_fixtures

SWEEP = Fixture("sweep_results", "suite string, location string, config string, hit double", [("s1", "idx_guidelines_v1", "512/0", 0.68), ("s1", "idx_bulletins_v1", "256/0", 0.5), ("s2", "idx_guidelines_v1", "512/0", 0.7), ("s1", "idx_none", "1/0", 0.1)]).over("supplier", "s_suppkey", every=True, suite=tagged("s_suppkey"), location=tagged("s_suppkey"))
SUITES = Fixture("suites", "suite string", [("s2",)]).over("supplier", "s_suppkey", every=True, suite=tagged("s_suppkey"))


@query("import_eval_runs", with_fixtures("SELECT r.suite, r.config, i.id AS index_id, hit FROM sweep_results r LEFT JOIN (SELECT location, arg_max(id, (built, id)) AS id FROM indexes GROUP BY location) i USING (location) WHERE suite NOT IN (SELECT suite FROM suites)", SWEEP, SUITES, INDEXES))
def import_eval_runs(spark, sf_dir):
    """Results of suites that are not there yet, each with the newest index of its location."""
    newest = INDEXES.frame(spark, sf_dir).groupBy("location").agg(F.max_by("id", F.struct("built", "id")).alias("index_id"))
    return SWEEP.frame(spark, sf_dir).join(SUITES.frame(spark, sf_dir), "suite", "left_anti").join(newest, "location", "left").select("suite", "config", "index_id", "hit")


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '/42'), doc_id LIMIT 30")
def seeded_sample(spark, sf_dir):
    """A sample of fixed size, the same for the same seed: ids in the order of their hashes."""
    return load(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("/42"))), "doc_id").limit(30)


@query("merge_metrics", "SELECT n_nationkey, 'hit=' || n_regionkey || ',mrr=' || n_nationkey AS metrics FROM nation")
def merge_metrics(spark, sf_dir):
    """Two maps of metrics in one, known names only, the later value of a name."""
    a = F.create_map(F.lit("hit"), F.lit(0), F.lit("junk"), F.lit(1))
    b = F.create_map(F.lit("hit"), F.col("n_regionkey"), F.lit("mrr"), F.col("n_nationkey"))
    merged = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    known = F.array_sort(F.map_entries(F.map_filter(merged, lambda k, v: k.isin("hit", "mrr"))))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(known, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("metrics"))


@query("default_prompt", with_fixtures("SELECT s.slug, coalesce((SELECT arg_min(text, pos) FROM prompts p WHERE p.slug = s.slug AND text LIKE 'Who%'), (SELECT arg_min(text, pos) FROM prompts p WHERE p.slug = s.slug)) AS prompt FROM sources s", SOURCES, PROMPTS))
def default_prompt(spark, sf_dir):
    """The generic prompt of a source, else its first."""
    p = PROMPTS.frame(spark, sf_dir).groupBy("slug").agg(F.min_by("text", F.when(F.startswith("text", F.lit("Who")), F.col("pos"))).alias("generic"), F.min_by("text", "pos").alias("first"))
    return SOURCES.frame(spark, sf_dir).select("slug").join(p, "slug", "left").select("slug", F.coalesce("generic", "first").alias("prompt"))


@query("recipe_card", with_fixtures("SELECT s.slug, coalesce(max(version), 0) AS version, coalesce(arg_max(model, version), '') AS model FROM sources s LEFT JOIN recipes r USING (slug) GROUP BY s.slug", SOURCES, RECIPES))
def recipe_card(spark, sf_dir):
    r = RECIPES.frame(spark, sf_dir).groupBy("slug").agg(F.max("version").alias("version"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("version"))).alias("model"))
    return SOURCES.frame(spark, sf_dir).select("slug").join(r, "slug", "left").select("slug", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("model", F.lit("")).alias("model"))


@query("depth_filter", "SELECT page_id FROM pages WHERE len(string_split(regexp_replace(url, '^https?://', ''), '/')) = 3")
def depth_filter(spark, sf_dir):
    return load(spark, sf_dir, "pages").where(F.size(F.split(F.regexp_replace("url", "^https?://", ""), "/")) == 3).select("page_id")


@query("iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_time(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("thousands", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS total FROM orders")
def thousands(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("total"))


@query("flatten_truth", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS ids FROM lineitem GROUP BY l_orderkey")
def flatten_truth(spark, sf_dir):
    """Nested lists of ids as one list, each id once."""
    nested = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_suppkey", "l_suppkey")).alias("n"))
    flat = F.array_sort(F.array_distinct(F.flatten("n")))
    return nested.select("l_orderkey", F.array_join(F.transform(flat, lambda x: x.cast("string")), ",").alias("ids"))


@query("index_problematic", with_fixtures("SELECT slug, coalesce(health IN ('degraded', 'failed'), false) OR len(coalesce(w_groups, [])) > 1 AS problematic FROM sources", SOURCES))
def index_problematic(spark, sf_dir):
    return SOURCES.frame(spark, sf_dir).select("slug", (F.coalesce(F.col("health").isin("degraded", "failed"), F.lit(False)) | (F.coalesce(F.size("w_groups"), F.lit(0)) > 1)).alias("problematic"))


@query("problem_order", with_fixtures("SELECT id, row_number() OVER (PARTITION BY split_part(id, '~', 2) ORDER BY health <> 'ok' DESC, built DESC, id) AS position FROM indexes", INDEXES))
def problem_order(spark, sf_dir):
    order = Window.partitionBy(F.substring_index("id", "~", -1)).orderBy(F.desc(F.col("health") != "ok"), F.desc("built"), "id")
    return INDEXES.frame(spark, sf_dir).select("id", F.row_number().over(order).cast("long").alias("position"))


@query("nested_default", with_fixtures("SELECT slug, version, coalesce(CAST(json_extract(content, '$.size') AS INTEGER), 512) AS size, coalesce(CAST(json_extract(content, '$.size') AS INTEGER), 0) > 300 AS enabled FROM recipes", RECIPES))
def nested_default(spark, sf_dir):
    size = F.from_json("content", "size int")["size"]
    return RECIPES.frame(spark, sf_dir).select("slug", "version", F.coalesce(size, F.lit(512)).alias("size"), (F.coalesce(size, F.lit(0)) > 300).alias("enabled"))


@query("lineage", with_fixtures("SELECT s.slug, i.id AS physical_index_id, r.version AS recipe_version, 'req-1' AS request_id FROM sources s JOIN indexes i ON i.id = s.active_index LEFT JOIN recipes r ON r.id = i.recipe_id", SOURCES, INDEXES, RECIPES))
def lineage(spark, sf_dir):
    i = INDEXES.frame(spark, sf_dir).select(F.col("id").alias("active_index"), "recipe_id")
    r = RECIPES.frame(spark, sf_dir).select(F.col("id").alias("recipe_id"), F.col("version").alias("recipe_version"))
    joined = SOURCES.frame(spark, sf_dir).select("slug", "active_index").join(i, "active_index").join(r, "recipe_id", "left")
    return joined.select("slug", F.col("active_index").alias("physical_index_id"), "recipe_version", F.lit("req-1").alias("request_id"))


@query("set_difference", with_fixtures("SELECT DISTINCT slug FROM recipes WHERE slug NOT IN (SELECT slug FROM indexes)", RECIPES, INDEXES))
def set_difference(spark, sf_dir):
    return RECIPES.frame(spark, sf_dir).select("slug").distinct().join(INDEXES.frame(spark, sf_dir).select("slug"), "slug", "left_anti")
