"""As-of joins, mergeable sketches, pages read as trees, and external search as a data source."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import markup
from lodestone.functions import text as T
from lodestone.operators import asof, evaluation
from lodestone.plans.base import load, query
from lodestone.plans.texts import _BARE, html_text
from lodestone.sources import search_source


_MARKS = f"""WITH t AS (SELECT page_id, {html_text()} AS t FROM {_BARE}),
lines AS (SELECT page_id, k, l[k] AS line FROM (SELECT page_id, string_split(t, chr(10)) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k FROM t)),
placed AS (SELECT page_id, line, (sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY k) - length(line) - 1)::BIGINT AS place FROM lines),
marks AS (SELECT page_id, place, regexp_extract(line, '^#{{1,6}}\\s+(.+?)\\s*$', 1) AS heading FROM placed WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S')),
points AS (SELECT page_id, unnest(range(0, length(t), 200)) AS place FROM t)"""


@query(
    "heading_asof",
    f"""{_MARKS}
SELECT p.page_id, p.place, m.heading FROM points p ASOF LEFT JOIN marks m ON p.page_id = m.page_id AND p.place >= m.place""",
)
def heading_asof(spark, sf_dir):
    """The heading above every 200th character of each page: headings and places meet in one order, not page by page in a row."""
    pages = load(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("t"))
    marks = pages.select("page_id", F.explode(T.sections_of(F.col("t"))).alias("s")).select("page_id", F.col("s.char_offset").cast("long").alias("place"), "s.heading")
    points = pages.where("t <> ''").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("t") - 1, F.lit(200).cast("long"))).alias("place"))
    return asof.as_of(points, marks, ["page_id"], "place", ["heading"], width=10_000)


@query("section_asof", f"{_MARKS} SELECT page_id, place, (SELECT arg_max(heading, m.place) FROM marks m WHERE m.page_id = t.page_id AND m.place <= v.place) AS heading FROM t, (VALUES (0), (50), (100), (250), (3500)) v(place)")
def section_asof(spark, sf_dir):
    """The heading at five places of each page, looked up in the page's own list of headings."""
    pages = load(spark, sf_dir, "pages").select("page_id", T.sections_of(T.html_to_markdown(F.col("html"))).alias("s"))
    pages = pages.select("*", F.explode(F.array(*map(F.lit, (0, 50, 100, 250, 3500)))).alias("place"))
    return pages.select("page_id", "place", T.section_at(F.col("s"), F.col("place")).alias("heading"))


@query(
    "event_asof",
    "WITH m AS (SELECT user_id, event_id, ts, value FROM events WHERE event_id % 10 = 0), p AS (SELECT user_id, event_id AS point, ts FROM events WHERE event_id % 10 <> 0), one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) SELECT p.user_id, point, one.event_id AS last_event, round(one.value, 6) AS value FROM p ASOF LEFT JOIN one ON p.user_id = one.user_id AND p.ts >= one.ts",
)
def event_asof(spark, sf_dir):
    """For each event the last tenth event of its user until then; the stretches are of one day."""
    e = load(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    points = e.where("event_id % 10 <> 0").select("user_id", F.col("event_id").alias("point"), "at")
    marks = e.where("event_id % 10 = 0").select("user_id", "at", F.col("event_id").alias("last_event"), "value")
    found = asof.as_of(points, marks, ["user_id"], "at", ["last_event", "value"], width=86_400e6, ties=["last_event"])
    return found.select("user_id", "point", "last_event", F.round("value", 6).alias("value"))


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("latency_sketch", "SELECT event_type, count(*) AS calls, true AS p50, true AS p95, true AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_sketch(spark, sf_dir):
    """Percentiles from sketches of each day, merged; told is whether their exact ranks are within twice the stated error."""
    e, k = load(spark, sf_dir, "events"), 400
    days = evaluation.latency_sketch(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", k)
    found = evaluation.sketch_percentiles(evaluation.merged_sketches(days, ["event_type"]), SHARES)
    j = e.where("value IS NOT NULL").select("event_type", "value").join(F.broadcast(found), "event_type")  # a row for each type of event
    slack = 2 * evaluation.rank_error(k)
    below = lambda name: F.count_if(F.col("value") < F.col(name)) / F.count("*") - slack <= SHARES[name]
    upto = lambda name: F.count_if(F.col("value") <= F.col(name)) / F.count("*") + slack >= SHARES[name]
    return j.groupBy("event_type").agg(F.max("calls").alias("calls"), *[(below(n) & upto(n)).alias(n) for n in SHARES])


_WORDS = "list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')"


@query("html_tree", f"SELECT page_id, md5(array_to_string({_WORDS}, ' ')) AS h, len({_WORDS}) AS n_words FROM (SELECT page_id, {html_text()} AS t FROM {_BARE})")
def html_tree(spark, sf_dir):
    """The words of pages read as trees, which on these pages are those of the chain of patterns."""
    words = F.filter(F.split(F.col("t"), r"\s+"), lambda x: x != "")
    pages = load(spark, sf_dir, "pages").select("page_id", markup.main_markdown(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5(F.array_join(words, " ")).alias("h"), F.size(words).cast("long").alias("n_words"))


@query("html_tree_title", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def html_tree_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", markup.title(F.col("html")).alias("title"))


def answer(question: str, top_k: int) -> list[dict]:
    """A made-up search system: five results, or none where the question is too long for it."""
    if len(question) % 7 == 0:
        raise ConnectionError("down")
    return [{"text": f"{question[:9]} {k}", "score": 1 / k, "source_uri": f"ext:{k}"} for k in range(1, min(top_k, 5) + 1)]


@query(
    "search_source",
    "SELECT item_id AS qid, k::INTEGER AS rank, substr(text, 1, 9) || ' ' || k AS text, round(1.0::DOUBLE / k, 6) AS score, 'ext:' || k AS source_uri FROM benchmark, range(1, 4) r(k) WHERE item_id % 50 = 0 AND length(text) % 7 <> 0",
)
def search_source_query(spark, sf_dir):
    """Questions to an external system through a registered data source, which is told how many results count."""
    asked = load(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", "text").collect()  # the stated set of questions
    search_source.register(spark)
    reader = spark.read.format("lodestone_search").option("client", "lodestone.plans.joins:answer").option("queries", json.dumps([[r.item_id, r.text] for r in asked])).option("top_k", "5")
    return reader.load().where("rank <= 3").select("qid", "rank", "text", F.round("score", 6).alias("score"), "source_uri")
