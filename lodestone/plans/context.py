"""Expansion of hits into context, over chunks of 128 words of all documents; every document's second chunk is an origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import chunk, refine, rewrite, search
from lodestone.plans.base import EDGES, ENTITIES, MANY_EDGES, MANY_ENTITIES, Fixture, load, query, tagged, with_fixtures
from lodestone.plans.texts import windows_sql

CHUNKS = f"""{windows_sql(128, 16)}, nvec AS (SELECT count(*) AS n FROM embeddings),
chunks AS (
  SELECT doc_id, 'doc-' || doc_id AS doc_title, chunk_index, array_to_string(w, ' ') AS chunk_text, len(w) AS chunk_tokens, 'doc-' || doc_id || '#' || chunk_index AS chunk_id,
    CASE WHEN chunk_index % 7 <> 6 THEN 'S' || (chunk_index // 3) END AS doc_section FROM cut)"""
VECTORS = ", vchunks AS (SELECT c.*, e.embedding::DOUBLE[] AS embedding FROM chunks c, nvec, embeddings e WHERE e.vec_id = (doc_id * 7 + chunk_index) % n)"
ORIGINS = "origins AS (SELECT doc_title AS o_title, chunk_index AS o_index, doc_id AS oid FROM chunks WHERE chunk_index = 1)"


def chunks_of(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_title"), "text")
    c = chunk.fixed_windows(d, 128, 16)
    section = F.when(F.col("chunk_index") % 7 != 6, F.concat(F.lit("S"), F.floor(F.col("chunk_index") / 3).cast("string")))
    return c.withColumn("chunk_id", F.concat("doc_title", F.lit("#"), F.col("chunk_index").cast("string"))).withColumn("doc_section", section)


def vector_chunks(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    c = chunks_of(spark, sf_dir).crossJoin(F.broadcast(e.agg(F.count("*").alias("_n"))))  # one row
    return c.withColumn("vec_id", (F.col("doc_id") * 7 + F.col("chunk_index")) % F.col("_n")).join(e, "vec_id").drop("vec_id", "_n")


def origins_of(c: DataFrame) -> DataFrame:
    return c.where("chunk_index = 1").select(F.col("doc_id").alias("oid"), "doc_title", "chunk_index")


def _digest(df: DataFrame) -> DataFrame:
    return df.select("oid", "chunk_id", "is_origin")


@query("refine_adjacent", f"WITH {CHUNKS}, {ORIGINS} SELECT oid, chunk_id, chunk_index = o_index AS is_origin FROM origins JOIN chunks ON doc_title = o_title AND chunk_index BETWEEN greatest(0, o_index - 2) AND o_index + 2")
def refine_adjacent(spark, sf_dir):
    c = chunks_of(spark, sf_dir)
    return _digest(refine.adjacent(origins_of(c), c))


_SECTION = f"{ORIGINS}, here AS (SELECT o.*, nullif(c.doc_section, '') AS o_section FROM origins o JOIN chunks c ON c.doc_title = o_title AND c.chunk_index = o_index), sect AS (SELECT oid, o_index, c.* FROM here JOIN chunks c ON c.doc_title = o_title AND (c.doc_section = o_section OR (o_section IS NULL AND c.chunk_index = o_index)))"


@query("refine_section", f"WITH {CHUNKS}, {_SECTION} SELECT oid, chunk_id, chunk_index = o_index AS is_origin FROM sect")
def refine_section(spark, sf_dir):
    c = chunks_of(spark, sf_dir)
    return _digest(refine.section(origins_of(c), c))


_NEAR = f"{ORIGINS}, near AS (SELECT oid, o_index, c.* FROM origins JOIN chunks c ON doc_title = o_title AND chunk_index BETWEEN greatest(0, o_index - 4) AND o_index + 4)"


def _near(spark, sf_dir) -> DataFrame:
    c = chunks_of(spark, sf_dir)
    return refine.adjacent(origins_of(c), c, 4)


def _kept(df: DataFrame) -> DataFrame:
    return df.select("oid", "chunk_id", "truncated", F.col("total_chunks").cast("long").alias("total_chunks"))


_SCORE = "1.0 / (1 + abs(chunk_index - o_index))"


@query("budget_prefix", f"WITH {CHUNKS}, {_NEAR}, run AS (SELECT *, sum(chunk_tokens) OVER (PARTITION BY oid ORDER BY {_SCORE} DESC, chunk_index) <= 400 AS fits, count(*) OVER (PARTITION BY oid) AS total FROM near), k AS (SELECT *, sum(fits::INT) OVER (PARTITION BY oid) AS kept FROM run) SELECT oid, chunk_id, kept < total AS truncated, CASE WHEN kept < total THEN total END AS total_chunks FROM k WHERE fits")
def budget_prefix(spark, sf_dir):
    near = _near(spark, sf_dir).withColumn("score", 1.0 / (1 + F.abs(F.col("chunk_index") - F.col("o_index"))))
    return _kept(refine.budget_prefix(near, "oid", 400))


@query(
    "budget_skip",
    f"""WITH RECURSIVE {CHUNKS}, {_NEAR}, items AS (SELECT oid, chunk_id, chunk_tokens AS c, row_number() OVER (PARTITION BY oid ORDER BY chunk_index % 3 DESC, chunk_index) AS r, count(*) OVER (PARTITION BY oid) AS total FROM near),
fold AS (SELECT oid, chunk_id, r, total, c <= 300 AS fits, CASE WHEN c <= 300 THEN c ELSE 0 END AS used FROM items WHERE r = 1
  UNION ALL SELECT i.oid, i.chunk_id, i.r, i.total, used + c <= 300, CASE WHEN used + c <= 300 THEN used + c ELSE used END FROM fold f JOIN items i ON i.oid = f.oid AND i.r = f.r + 1),
k AS (SELECT *, sum(fits::INT) OVER (PARTITION BY oid) AS kept FROM fold) SELECT oid, chunk_id, kept < total AS truncated, CASE WHEN kept < total THEN total END AS total_chunks FROM k WHERE fits""",
)
def budget_skip(spark, sf_dir):
    return _kept(refine.budget_skip(_near(spark, sf_dir).withColumn("score", (F.col("chunk_index") % 3).cast("double")), "oid", 300))


@query(
    "budget_outward",
    f"""WITH RECURSIVE {CHUNKS}, {_NEAR}, items AS (SELECT oid, chunk_id, chunk_tokens AS c, chunk_index = o_index AS own, chunk_index > o_index AS aft, row_number() OVER (PARTITION BY oid ORDER BY abs(chunk_index - o_index), chunk_index) AS r, count(*) OVER (PARTITION BY oid) AS total FROM near),
fold AS (SELECT oid, chunk_id, r, total, true AS fits, c AS used, true AS ob, true AS oa FROM items WHERE r = 1
  UNION ALL SELECT i.oid, i.chunk_id, i.r, i.total, (CASE WHEN aft THEN oa ELSE ob END) AND used + c <= 450, CASE WHEN (CASE WHEN aft THEN oa ELSE ob END) AND used + c <= 450 THEN used + c ELSE used END,
    ob AND (aft OR used + c <= 450), oa AND (NOT aft OR used + c <= 450) FROM fold f JOIN items i ON i.oid = f.oid AND i.r = f.r + 1),
k AS (SELECT *, sum(fits::INT) OVER (PARTITION BY oid) AS kept FROM fold) SELECT oid, chunk_id, kept < total AS truncated, CASE WHEN kept < total THEN total END AS total_chunks FROM k WHERE fits""",
)
def budget_outward(spark, sf_dir):
    return _kept(refine.budget_outward(_near(spark, sf_dir), "oid", 450))


_BOTH = "both_ways AS (SELECT source_entity AS entity, target_entity AS related, pos FROM edges UNION ALL SELECT target_entity, source_entity, pos FROM edges WHERE directionality = 'bidirectional')"


@query("xref_targets", with_fixtures(f", {_BOTH} SELECT entity, related FROM both_ways WHERE entity IN (SELECT name FROM entities)".lstrip(), MANY_ENTITIES, MANY_EDGES).replace("\n, both", ",\nboth"))
def xref_targets(spark, sf_dir):
    return refine.related_entities(MANY_ENTITIES.frame(spark, sf_dir), MANY_EDGES.frame(spark, sf_dir)).select("entity", "related")


_TITLES = f""", {_BOTH}, listed AS (SELECT name, pos, unnest(doc_titles) AS doc_title, generate_subscripts(doc_titles, 1) - 1 AS t FROM entities),
owner AS (SELECT doc_title, arg_min(name, pos) AS entity FROM listed GROUP BY doc_title),
hop AS (SELECT o.doc_title, l.doc_title AS target, min((b.pos, l.t)) AS first FROM owner o JOIN both_ways b USING (entity) JOIN listed l ON l.name = b.related WHERE l.doc_title <> o.doc_title GROUP BY ALL)"""


@query("related_titles", with_fixtures(_TITLES + " SELECT doc_title, string_agg(target, ',' ORDER BY first) AS titles FROM hop GROUP BY doc_title", MANY_ENTITIES, MANY_EDGES).replace("\n, both", ",\nboth"))
def related_titles(spark, sf_dir):
    return refine.related_titles(MANY_ENTITIES.frame(spark, sf_dir), MANY_EDGES.frame(spark, sf_dir)).select("doc_title", F.array_join("titles", ",").alias("titles"))


_X = with_fixtures(
    _TITLES
    + f""", {CHUNKS}{VECTORS}, {ORIGINS}, q AS (SELECT oid, o_title, o_index, embedding AS qv FROM origins JOIN vchunks ON doc_title = o_title AND chunk_index = o_index),
own AS (SELECT oid, chunk_id, 0 AS position, 1.0::DOUBLE AS score FROM q JOIN vchunks ON doc_title = o_title AND chunk_index = o_index),
rel AS (SELECT oid, chunk_id, row_number() OVER (PARTITION BY oid ORDER BY round(list_cosine_similarity(embedding, qv), 9) DESC, chunk_id) AS position, list_cosine_similarity(embedding, qv) AS score FROM q JOIN hop ON hop.doc_title = o_title JOIN vchunks v ON v.doc_title = target)
SELECT oid, chunk_id, position, round(score, 6) AS score FROM own UNION ALL SELECT oid, chunk_id, position, round(score, 6) FROM rel WHERE position <= 3""",
    ENTITIES,
    EDGES,
).replace("\n, both", ",\nboth")


@query("refine_cross_reference", _X)
def refine_cross_reference(spark, sf_dir):
    c = vector_chunks(spark, sf_dir)
    o = c.where("chunk_index = 1").select(F.col("doc_id").alias("oid"), "doc_title", "chunk_index", F.col("embedding").alias("qvec"))
    titles = refine.related_titles(ENTITIES.frame(spark, sf_dir), EDGES.frame(spark, sf_dir))
    out = refine.cross_reference(o, c, titles, 3)
    return out.select("oid", "chunk_id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"))


ASKED = Fixture("asked", "qid int, query string, doc_title string", [(0, "ptsd", "doc-0"), (1, "SUD", "doc-2"), (2, "unknown", "doc-3"), (3, "phq-9", "doc-5"), (4, "et", "doc-11")])

MANY_ASKED = ASKED.over("customer", "c_custkey", every=True, qid="{v} + 5 * CAST(c_custkey AS INT)", query=tagged("c_custkey"))


@query("entity_aliases", with_fixtures("SELECT qid, array_to_string(coalesce((SELECT arg_min(aliases, pos) FROM entities WHERE lower(name) = lower(query)), []), ',') AS aliases FROM asked", MANY_ENTITIES, MANY_ASKED))
def entity_aliases(spark, sf_dir):
    return refine.aliases_of(MANY_ASKED.frame(spark, sf_dir), MANY_ENTITIES.frame(spark, sf_dir)).select("qid", F.array_join("aliases", ",").alias("aliases"))


_ARC = with_fixtures(
    f""", {CHUNKS}{VECTORS}, q AS (SELECT a.*, coalesce((SELECT arg_min(aliases, pos) FROM entities WHERE lower(name) = lower(query)), []) AS al, e.embedding::DOUBLE[] AS qv FROM asked a JOIN embeddings e ON e.vec_id = a.qid),
s AS (SELECT qid, query, al, v.*, list_cosine_similarity(embedding, qv) AS score FROM q JOIN vchunks v USING (doc_title)),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS n FROM s),
hit AS (SELECT qid, chunk_index, score FROM top WHERE n <= 2 UNION ALL SELECT qid, chunk_index, score FROM s WHERE len(list_filter(list_concat([query], al), lambda x: contains(lower(chunk_text), lower(x)))) > 0)
SELECT qid, chunk_index, round(max(score), 6) AS score FROM hit GROUP BY qid, chunk_index HAVING max(score) >= -0.05""",
    ENTITIES,
    ASKED,
).replace("\n, toks", ",\ntoks")


@query("refine_entity_arc", _ARC)
def refine_entity_arc(spark, sf_dir):
    asked = ASKED.frame(spark, sf_dir)
    q = asked.join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")
    arc = refine.entity_arc(q, vector_chunks(spark, sf_dir), refine.aliases_of(asked, ENTITIES.frame(spark, sf_dir)), 2, -0.05)
    return arc.select(F.col("qid").cast("int").alias("qid"), "chunk_index", F.round("score", 6).alias("score"))


REQUESTS = Fixture(
    "requests",
    "id int, tool_strategy string, tool_max_tokens int, tool_window int, family string, kind1 string, enabled1 boolean, max1 int, window1 int, min1 double, kind2 string, enabled2 boolean, max2 int, window2 int, min2 double",
    [
        (0, None, None, None, "document", None, None, None, None, None, None, None, None, None, None),
        (1, None, None, None, "code", None, None, None, None, None, None, None, None, None, None),
        (2, "entity_arc", None, 5, "document", "adjacent", True, 100, 3, None, "entity_arc", True, 900, 20, 0.4),
        (3, None, 50, None, "document", "adjacent", False, 100, 3, None, "entity_arc", True, 900, 20, 0.4),
        (4, "section", None, None, "other", "section", False, 100, 9, 0.1, None, None, None, None, None),
        (5, None, None, None, "other", None, None, None, None, None, None, None, None, None, None),
    ],
).over("orders", "o_orderkey", id="CAST(o_orderkey AS INT)", tool_max_tokens="{v} + CAST(o_custkey AS INT)")


@query("resolve_strategy", with_fixtures("""SELECT id, coalesce(tool_strategy, CASE WHEN u1 THEN kind1 WHEN u2 THEN kind2 END, CASE family WHEN 'document' THEN 'section' WHEN 'clinical_document' THEN 'section' ELSE 'adjacent' END) AS strategy,
coalesce(tool_max_tokens, CASE WHEN u1 THEN max1 WHEN u2 THEN max2 END) AS max_tokens, coalesce(tool_window, CASE WHEN u1 THEN window1 WHEN u2 THEN window2 END, 2) AS window, CASE WHEN u1 THEN min1 WHEN u2 THEN min2 END AS min_score
FROM (SELECT *, coalesce(enabled1, false) AND (tool_strategy IS NULL OR tool_strategy = kind1) AS u1, coalesce(enabled2, false) AND (tool_strategy IS NULL OR tool_strategy = kind2) AS u2 FROM requests)""", REQUESTS))
def resolve_strategy(spark, sf_dir):
    r = REQUESTS.frame(spark, sf_dir)
    s = lambda k: F.struct(F.col(f"kind{k}").alias("kind"), F.col(f"enabled{k}").alias("enabled"), F.col(f"max{k}").alias("max_context_tokens"), F.col(f"window{k}").alias("window"), F.col(f"min{k}").alias("min_score"))
    r = r.withColumn("strategies", F.filter(F.array(s(1), s(2)), lambda x: x["kind"].isNotNull()))
    return refine.resolve_strategy(r).select("id", "strategy", "max_tokens", "window", "min_score")


@query("batch_refine", f"WITH {CHUNKS}, hits AS (SELECT doc_id // 100 AS qid, doc_id AS rank, doc_title, chunk_index FROM chunks WHERE chunk_index IN (1, 2)), first AS (SELECT h.qid, c.doc_title, c.chunk_index, c.chunk_id FROM hits h JOIN chunks c ON c.doc_title = h.doc_title AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY ALL) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY doc_title, chunk_index) AS position FROM first")
def batch_refine(spark, sf_dir):
    c = chunks_of(spark, sf_dir)
    h = c.where("chunk_index IN (1, 2)").select(F.floor(F.col("doc_id") / 100).alias("qid"), F.col("doc_id").alias("rank"), "doc_title", "chunk_index")
    return refine.batch_refine(h, c, 1).select("qid", "chunk_id", F.col("position").cast("long").alias("position"))


@query("resolve_chunk_id", f"WITH {CHUNKS}, asked AS (SELECT 'doc-' || doc_id || '#2' AS chunk_id FROM documents) SELECT a.chunk_id, c.doc_title, c.chunk_index, c.chunk_id IS NOT NULL AS found FROM asked a LEFT JOIN chunks c USING (chunk_id)")
def resolve_chunk_id(spark, sf_dir):
    asked = load(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("#2")).alias("chunk_id"))
    return refine.resolve_chunk_id(asked, chunks_of(spark, sf_dir))


_PATTERNS = ["100%", "a_b", "la de", "Licensed under"]


@query("keyword_ilike", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE contains(lower(chunk_text), '100%') OR contains(lower(chunk_text), 'a_b') OR contains(lower(chunk_text), 'la de') OR contains(lower(chunk_text), 'licensed under')")
def keyword_ilike(spark, sf_dir):
    return search.keyword_hits(chunks_of(spark, sf_dir), _PATTERNS).select("chunk_id")


@query("keyword_scored", f"WITH {CHUNKS}{VECTORS} SELECT chunk_index, round(list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS score FROM vchunks WHERE doc_title = 'doc-0' AND contains(lower(chunk_text), 'la')")
def keyword_scored(spark, sf_dir):
    q = load(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding
    return search.keyword_scored(vector_chunks(spark, sf_dir), ["la"], q, "doc-0").select("chunk_index", F.round("score", 6).alias("score"))


@query("context_assembly", f"WITH {CHUNKS} SELECT doc_id AS qid, md5(string_agg('[' || doc_title || ' — ' || coalesce(doc_section, 'N/A') || ']' || chr(10) || substr(chunk_text, 1, 1000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index)) AS h FROM chunks GROUP BY doc_id")
def context_assembly(spark, sf_dir):
    hits = chunks_of(spark, sf_dir).select(F.col("doc_id").alias("qid"), F.col("chunk_index").alias("rank"), "doc_title", "doc_section", "chunk_text")
    return rewrite.assemble_context(hits).select("qid", F.md5("context").alias("h"))


@query("section_counts", f"WITH {CHUNKS} SELECT coalesce(doc_section, 'none') AS section, count(*) AS n FROM chunks GROUP BY 1")
def section_counts(spark, sf_dir):
    return chunks_of(spark, sf_dir).groupBy(F.coalesce("doc_section", F.lit("none")).alias("section")).agg(F.count("*").alias("n"))


@query("conversation_window", "SELECT c.conv_id, c.turn, count(*) AS n, sum(length(o.text))::BIGINT AS chars FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn BETWEEN greatest(0, c.turn - 2) AND c.turn + 2 GROUP BY ALL")
def conversation_window(spark, sf_dir):
    t = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_title"), F.col("turn").cast("int").alias("chunk_index"), "text")
    o = t.select(F.struct("doc_title", "chunk_index").alias("oid"), "doc_title", "chunk_index")
    n = refine.adjacent(o, t)
    return n.groupBy(F.col("oid.doc_title").cast("long").alias("conv_id"), F.col("oid.chunk_index").cast("long").alias("turn")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("parent_child", f"WITH {CHUNKS}, hits AS (SELECT doc_id % 10 AS qid, doc_title, chunk_index, 1.0::DOUBLE / (1 + chunk_index + doc_id % 7) AS score FROM chunks WHERE chunk_index % 5 IN (0, 1)), placed AS (SELECT *, CASE WHEN doc_section IS NOT NULL THEN 's' || doc_section ELSE 'c' || chunk_index END AS p FROM chunks), best AS (SELECT qid, doc_title, p, max(score) AS score, count(*) AS hits FROM hits JOIN placed USING (doc_title, chunk_index) GROUP BY ALL), sect AS (SELECT doc_title, p, string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_index) AS text, sum(chunk_tokens)::BIGINT AS tokens, any_value(doc_section) AS doc_section FROM placed GROUP BY ALL) SELECT qid, doc_title, doc_section, md5(text) AS h, tokens, round(score, 6) AS score, hits FROM best JOIN sect USING (doc_title, p)")
def parent_child(spark, sf_dir):
    """Small chunks are hit, their sections are returned."""
    c = chunks_of(spark, sf_dir)
    hits = c.where("chunk_index % 5 IN (0, 1)").select((F.col("doc_id") % 10).alias("qid"), "doc_title", "chunk_index", (1 / (1 + F.col("chunk_index") + F.col("doc_id") % 7)).alias("score"))
    return refine.parents(hits, c).select("qid", "doc_title", "doc_section", F.md5("text").alias("h"), "tokens", F.round("score", 6).alias("score"), "hits")
