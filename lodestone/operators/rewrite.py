"""Query rewriting: prompts, answers of models, and a rewriter that needs none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_REWRITES = 5
ANSWER = "array<struct<text: string, intent: string, rationale: string, confidence: double>>"


def parse_answer(raw: Column) -> Column:
    """Rewrites of a model's answer: an array or an object with ``queries``, with or without a code fence; null if neither."""
    inner = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), raw)
    body = F.trim(inner)
    listed = F.when(F.startswith(body, F.lit("[")), body).when(F.startswith(body, F.lit("{")), F.get_json_object(body, "$.queries"))
    parsed = F.from_json(listed, ANSWER)
    return F.when(F.forall(parsed, lambda r: r["text"].isNotNull() & F.coalesce(r["confidence"].between(0, 1), F.lit(True))), parsed)


def rewrites(requests: DataFrame, limit: int = MAX_REWRITES) -> DataFrame:
    """``qid``, ``rank``, ``text``, ``confidence`` of the first ``limit`` rewrites; the raw query has rank 0 and always stays."""
    parsed = F.slice(F.coalesce(parse_answer(F.col("answer")), F.array().cast(ANSWER)), 1, limit)
    raw = F.array(F.struct(F.col("query").alias("text"), F.lit(1.0).alias("confidence")))
    every = F.concat(raw, F.transform(parsed, lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence"))))
    return requests.select("qid", F.posexplode(every).alias("rank", "r")).select("qid", "rank", "r.text", "r.confidence")


def offline_rewrite(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One rewrite a query: words and abbreviations that the vocabulary (``term``, ``preferred``) knows are replaced."""
    words = queries.select("qid", F.posexplode(F.split("query", " ")).alias("pos", "word"))
    known = vocabulary.groupBy(F.lower("term").alias("t")).agg(F.min("preferred").alias("preferred"))
    swapped = words.join(known, F.lower("word") == F.col("t"), "left").withColumn("word", F.coalesce("preferred", "word"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return swapped.groupBy("qid").agg(joined.alias("rewrite"), F.count("preferred").alias("replaced"))


# What a prompt template must have.
TEMPLATE_KEYS = ("name", "version", "system", "user")
_templates: dict[str, dict[str, str]] = {}


def load_template(spark: SparkSession, path: str) -> dict[str, str]:
    """A prompt template in YAML, read once for each path; an error names the key that is missing."""
    import yaml

    if path not in _templates:
        found = yaml.safe_load(spark.read.text(path, wholetext=True).first().value) or {}
        for key in TEMPLATE_KEYS:
            if key not in found:
                raise ValueError(f"template {path} has no {key!r}")
        _templates[path] = found
    return _templates[path]


def cache_key(*parts: str) -> Column:
    """One key for a source, versions of template and metadata, a query and a context; nulls and empty texts differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(p) for p in parts]), {"ignoreNullFields": "false"}), 256)


def with_cache(requests: DataFrame, cache: DataFrame, *parts: str) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache (``key``, ``answer``, ``stored``) answers, by its newest entry, and those still to be asked, each key once."""
    keyed = requests.withColumn("key", cache_key(*parts))
    newest = cache.groupBy("key").agg(F.max_by("answer", "stored").alias("answer"))
    return keyed.join(newest, "key"), keyed.join(newest, "key", "left_anti").dropDuplicates(["key"])


def bulleted(items: Column, limit: int, empty: str) -> Column:
    """Up to ``limit`` lines with a dash, then how many more there are; a phrase where there are none."""
    lines = F.array_join(F.transform(F.slice(items, 1, limit), lambda x: F.concat(F.lit("- "), x)), "\n")
    more = F.when(F.size(items) > limit, F.concat(F.lit("\n… "), (F.size(items) - limit).cast("string"), F.lit(" more omitted"))).otherwise("")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(lines, more)).otherwise(empty)


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def assemble_context(hits: DataFrame, limit: int = 1000) -> DataFrame:
    """The context of an answer: hits in order, each under its title and section, cut to ``limit`` characters."""
    part = F.concat(F.lit("["), "doc_title", F.lit(" — "), F.coalesce("doc_section", F.lit("N/A")), F.lit("]\n"), F.substring("chunk_text", 1, limit))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    return hits.groupBy("qid").agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))
