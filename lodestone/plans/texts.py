"""Text cleaning, parsing, naming and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunk, rewrite
from lodestone.plans.base import Fixture, load, query, with_fixtures

LINES = Fixture(
    "samples",
    "id int, s string",
    [
        (0, "Skip to main content now\nBody\n\n\n\nMore\nBack to top\n"),
        (1, "# Title\n\ntext\n## Part one\nmore\n### Deep \nend"),
        (2, "token eyJab-1.cd_2.ef3 and password = hunter2 Client_Secret: x"),
        (3, "All rights reserved by some\nkeep"),
        (4, None),
        (5, "## Only second\nbody"),
        (6, "First one. Second one. Third"),
        (7, "Single sentence."),
    ],
).over("documents", "doc_id", id="CAST(doc_id AS INT)", s="{v} || chr(10) || text")
NAMES = Fixture(
    "names",
    "id int, s string",
    [(0, "SB_1234 wing"), (1, "ssl 5"), (2, "report"), (3, "good-slug-1"), (4, "bad--slug"), (5, "-edge"), (6, ""), (7, "https://github.com/own/repo.git"), (8, "git@github.com:own/other"), (9, "care/adult/guide.md"), (10, "http://h/v1/chat/completions/"), (11, "UPPER"), (12, None)],
).over("part", "p_partkey", id="CAST(p_partkey AS INT)", s="replace(replace({v}, 'w', 'w' || CAST(p_partkey AS STRING)), 'd', 'd' || CAST(p_size AS STRING))")


def _strip(s: str) -> str:
    return f"regexp_replace(coalesce({s}, ''), '(?im)^(" + "|".join(T.BOILERPLATE) + ").*$', '', 'g')"


def _trim(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def _collapse(s: str) -> str:
    return _trim(f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_NORMAL = _collapse(_strip("text"))


@query("boilerplate", with_fixtures(f"SELECT id, {_strip('s')} AS clean FROM samples", LINES))
def boilerplate(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", T.strip_boilerplate(F.coalesce("s", F.lit(""))).alias("clean"))


@query("collapse_blank", f"SELECT doc_id, md5({_collapse('text')}) AS h FROM documents")
def collapse_blank(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_blank(F.col("text"))).alias("h"))


@query("min_body", f"SELECT doc_id, length({_NORMAL}) AS n FROM documents WHERE length({_NORMAL}) >= 200")
def min_body(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("t"))
    return d.where("t IS NOT NULL").select("doc_id", F.length("t").cast("long").alias("n"))


KINDS = Fixture("kinds", "id int, t string", [(0, "Text/HTML; charset=x"), (1, "application/pdf"), (2, "text/markdown"), (3, "text/plain"), (4, "image/png"), (5, None)]).over("pages", "page_id", id="CAST(page_id AS INT)", t="{v} || '; page=' || CAST(page_id AS STRING)")


@query("content_type_dispatch", with_fixtures("SELECT id, CASE WHEN contains(lower(t), 'html') THEN 'html' WHEN contains(lower(t), 'pdf') THEN 'pdf' WHEN contains(lower(t), 'markdown') THEN 'markdown' WHEN contains(lower(t), 'plain') THEN 'plain' ELSE 'markdown' END AS kind FROM kinds", KINDS))
def content_type(spark, sf_dir):
    return KINDS.frame(spark, sf_dir).select("id", T.content_kind(F.col("t")).alias("kind"))


def _unescape(s: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    return s


@query("html_title", "SELECT page_id, " + _unescape(_trim("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")) + " AS title FROM pages")
def html_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_BARE = "(SELECT page_id, regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g') AS b FROM pages)"


def html_text() -> str:
    """The text of a page in SQL, of a page ``b`` without scripts."""
    part = lambda tag: f"nullif(regexp_extract(b, '(?is)<{tag}[^>]*>(.*)</{tag}>', 1), '')"
    s = f"coalesce({part('main')}, {part('article')}, {part('body')}, b)"
    for k in range(1, 7):
        s = f"regexp_replace({s}, '(?is)<h{k}[^>]*>(.*?)</h{k}>', chr(10) || chr(10) || '{'#' * k} \\1' || chr(10) || chr(10), 'g')"
    s = f"regexp_replace({s}, '(?i)<(p|div|li|tr|br)[^>]*>', chr(10), 'g')"
    s = _unescape(f"regexp_replace({s}, '(?s)<[^>]*>', '', 'g')")
    return _collapse(f"regexp_replace({s}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')")


@query("html_strip", f"SELECT page_id, md5({html_text()}) AS h, length({html_text()}) AS n FROM {_BARE}")
def html_strip(spark, sf_dir):
    d = load(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("t"))
    return d.select("page_id", F.md5("t").alias("h"), F.length("t").cast("long").alias("n"))


_REDACT = "regexp_replace(regexp_replace({s}, 'eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+', '[REDACTED]', 'g'), '(?i)(client_secret|password|secret|authorization)\\s*[=:]\\s*\\S+', '\\1=[REDACTED]', 'g')"


@query("redact_secrets", with_fixtures(f"SELECT 'sample' AS origin, id::BIGINT AS id, md5({_REDACT.format(s='s')}) AS h FROM samples UNION ALL SELECT 'document', doc_id, md5({_REDACT.format(s='text')}) FROM documents", LINES))
def redact_secrets(spark, sf_dir):
    a = LINES.frame(spark, sf_dir).select(F.lit("sample").alias("origin"), F.col("id").cast("long").alias("id"), F.md5(T.redact(F.col("s"))).alias("h"))
    return a.unionAll(load(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", F.md5(T.redact(F.col("text")))))


@query("doc_type", with_fixtures("SELECT id, CASE WHEN coalesce(regexp_extract(s, '(?i)^(SB|SL|SSL|VSP|CIL)[_ ]', 1), '') = '' THEN 'OTHER' ELSE upper(regexp_extract(s, '(?i)^(SB|SL|SSL|VSP|CIL)[_ ]', 1)) END AS kind FROM names", NAMES))
def doc_type(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("id", T.doc_type(F.col("s")).alias("kind"))


@query("slug_validate", with_fixtures("SELECT id, CASE WHEN coalesce(s, '') = '' THEN 'slug is empty' WHEN contains(s, '--') THEN 'slug holds a double hyphen' WHEN NOT regexp_matches(s, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?$') THEN 'slug must be lower-case letters, digits and inner hyphens' END AS error FROM names", NAMES))
def slug_validate(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("id", T.slug_error(F.col("s")).alias("error"))


@query("table_name", with_fixtures("SELECT id, 'idx_' || replace(s, '-', '_') || '_v1' AS name FROM names", NAMES))
def table_name(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("id", T.table_name(F.col("s")).alias("name"))


@query("repo_from_remote", with_fixtures("SELECT id, coalesce(nullif(regexp_extract(s, '^https?://github\\.com/([^/]+/[^/]+?)(?:\\.git)?$', 1), ''), nullif(regexp_extract(s, '^git@github\\.com:([^/]+/[^/]+?)(?:\\.git)?$', 1), '')) AS repo FROM names", NAMES))
def repo_from_remote(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("id", T.repo_of_remote(F.col("s")).alias("repo"))


@query("doc_id", with_fixtures("SELECT id, regexp_replace(s, '\\.md$', '') AS doc FROM names", NAMES))
def doc_id(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("id", T.doc_id_of_path(F.col("s")).alias("doc"))


@query("base_url", with_fixtures("SELECT id, regexp_replace(s, '(/v1)?(/chat/completions|/embeddings)?/*$', '') AS url FROM names", NAMES))
def base_url(spark, sf_dir):
    return NAMES.frame(spark, sf_dir).select("id", T.base_url(F.col("s")).alias("url"))


@query("corpus_tree_titles", "SELECT source || '/' || lang || '/doc-' || doc_id AS title FROM documents")
def corpus_tree_titles(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"))


@query("first_sentence", with_fixtures("SELECT id, CASE WHEN ends_with(string_split(s, '. ')[1], '.') THEN string_split(s, '. ')[1] ELSE string_split(s, '. ')[1] || '.' END AS first FROM samples", LINES))
def first_sentence(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", T.first_sentence(F.col("s")).alias("first"))


@query("title", with_fixtures("SELECT id, coalesce(nullif(regexp_extract(s, '(?m)^#[ \\t]+(\\S.*?)[ \\t]*$', 1), ''), nullif(regexp_extract(s, '(?m)^#{1,6}[ \\t]+(\\S.*?)[ \\t]*$', 1), ''), 'given') AS title FROM samples", LINES))
def title(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", T.title_of(F.col("s"), F.lit("given")).alias("title"))


@query("markdown_headings", with_fixtures("SELECT id, level, heading, char_offset::INTEGER AS char_offset FROM (SELECT id, length(regexp_extract(l, '^(#{1,6})\\s+\\S', 1))::INTEGER AS level, regexp_extract(l, '^#{1,6}\\s+(.+?)\\s*$', 1) AS heading, coalesce(sum(length(l) + 1) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset FROM (SELECT id, unnest(string_split(s, chr(10))) AS l, generate_subscripts(string_split(s, chr(10)), 1) AS p FROM samples WHERE s IS NOT NULL)) WHERE level > 0", LINES))
def headings(spark, sf_dir):
    return LINES.frame(spark, sf_dir).select("id", F.explode(T.sections_of(F.col("s"))).alias("h")).select("id", "h.level", "h.heading", "h.char_offset")


@query("recipe_hash", "SELECT n_nationkey, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS h FROM nation")
def recipe_hash(spark, sf_dir):
    json = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    return load(spark, sf_dir, "nation").select("n_nationkey", T.canonical_hash(json).alias("h"))


@query("fingerprint", "SELECT n_nationkey, substr(sha256(substr(sha256(n_name), 1, 12) || '|' || substr(sha256(CAST(n_regionkey AS VARCHAR)), 1, 12)), 1, 16) AS f FROM nation")
def fingerprint(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", T.fingerprint(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("f"))


@query("formatting", "SELECT p_partkey, p_size || ' tok / ' || (p_size % 7) || ' overlap' AS chunker, printf('%+.3f', p_retailprice - 1000) AS delta FROM part")
def formatting(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.chunker_summary(F.col("p_size"), F.col("p_size") % 7).alias("chunker"), T.signed(F.col("p_retailprice") - 1000).alias("delta"))


@query("relative_time", "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-20 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)")
def relative_time(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", T.relative_time(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("age"))


TOKENS = "toks AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM documents)"


def windows_sql(size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""{TOKENS}, cut AS (
  SELECT doc_id, i::INTEGER AS chunk_index, t[i * {stride} + 1:i * {stride} + {size}] AS w FROM (
    SELECT doc_id, t, unnest(range(0, CASE WHEN len(t) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(t) - {size}) / {stride}.0) AS BIGINT) END)) AS i FROM toks WHERE len(t) > 0))"""


def _fixed(size: int, overlap: int):
    def run(spark, sf_dir):
        c = chunk.fixed_windows(load(spark, sf_dir, "documents").select("doc_id", "text"), size, overlap)
        return c.select("doc_id", "chunk_index", F.md5("chunk_text").alias("h"), F.col("chunk_tokens").cast("long").alias("n"))

    return run


for _s, _o in ((512, 0), (512, 64), (256, 0), (256, 64), (1024, 0)):
    query(f"chunk_fixed_{_s}_{_o}", f"WITH {windows_sql(_s, _o)} SELECT doc_id, chunk_index, md5(array_to_string(w, ' ')) AS h, len(w) AS n FROM cut")(_fixed(_s, _o))

_GRID = [(512, 0), (256, 64), (128, 16)]


@query(
    "sweep_grid",
    " UNION ALL ".join(f"SELECT * FROM (WITH {windows_sql(s, o)} SELECT {s} AS size, {o} AS overlap, count(*) AS chunks, count(DISTINCT doc_id) AS docs, sum(len(w))::BIGINT AS tokens FROM cut)" for s, o in _GRID),
)
def sweep_grid(spark, sf_dir):
    c = chunk.sweep(load(spark, sf_dir, "documents").select("doc_id", "text"), _GRID)
    return c.groupBy("size", "overlap").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.sum("chunk_tokens").alias("tokens"))


@query("chunk_counts", f"WITH {windows_sql(256, 64)} SELECT doc_id, count(*) AS chunks FROM cut GROUP BY doc_id")
def chunk_counts(spark, sf_dir):
    return chunk.fixed_windows(load(spark, sf_dir, "documents").select("doc_id", "text"), 256, 64).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("token_stats", f"WITH {TOKENS} SELECT lang, sum(len(t))::BIGINT AS tokens, max(len(t)) AS longest, count(*) AS docs FROM toks JOIN documents USING (doc_id) GROUP BY lang")
def token_stats(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("lang", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.count("*").alias("docs"))


@query("chunk_offset", f"WITH {windows_sql(128, 16)} SELECT doc_id, chunk_index, greatest(strpos(text, substr(array_to_string(w, ' '), 1, 32)) - 1, 0) AS place FROM cut JOIN documents USING (doc_id)")
def chunk_offset(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    return chunk.fixed_windows(d, 128, 16).select("doc_id", "chunk_index", T.chunk_offset(F.col("whole"), F.col("chunk_text")).cast("long").alias("place"))


@query("chunk_sentence", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS chunk_index, md5(s) AS h FROM (SELECT doc_id, unnest(q) AS s, generate_subscripts(q, 1) AS p FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS q FROM documents))")
def chunk_sentence(spark, sf_dir):
    return chunk.sentences(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.md5("chunk_text").alias("h"))


_TOKENS_OF = "list_filter(string_split_regex({0}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


def _passages_oracle(size: int, overlap: int) -> str:
    """The fold over passages as a recursion: what is closed at each passage, and what stays open."""
    n, whole = (lambda x: f"len({_TOKENS_OF.format(x)})"), "array_to_string(held, chr(10))"
    tail = f"array_to_string({_TOKENS_OF.format(whole)}[-{overlap}:], ' ')"
    after = f"CASE WHEN {tail} <> '' THEN [{tail}] ELSE []::VARCHAR[] END"
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
raw AS (SELECT doc_id, i, ['title_1', 'paragraph', 'table_caption', 'paragraph'][i % 4 + 1] AS kind, ['INTRO', 'INTRO', 'RESULTS', 'REF'][(i // 4) % 4 + 1] AS section, regexp_replace(l[i + 1], '^\\s+|\\s+$', '', 'g') AS t
  FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM l)),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, section, text, {n('text')} AS cost FROM (
  SELECT doc_id, i, section, CASE WHEN kind = 'title_1' THEN '# ' || t || chr(10) WHEN kind = 'table_caption' THEN 'Table: ' || t ELSE t END AS text FROM raw WHERE section <> 'REF' AND t <> '')),
fold AS (
  SELECT doc_id, r, section, [text] AS held, cost::BIGINT AS n, []::STRUCT(t VARCHAR, n BIGINT, s VARCHAR)[] AS closed FROM p WHERE r = 1
  UNION ALL SELECT doc_id, r, section, list_append(held, text), n + cost, closed FROM (
    SELECT * REPLACE (CASE WHEN shut THEN {after} ELSE held END AS held, CASE WHEN shut THEN {n(tail)} ELSE n END AS n,
      CASE WHEN shut THEN list_append(closed, {{'t': {whole}, 'n': {n(whole)}::BIGINT, 's': section}}) ELSE closed END AS closed) FROM (
      SELECT *, len(held) > 0 AND n + cost > {size} AS shut FROM (
        SELECT doc_id, r, section, text, cost, CASE WHEN turned THEN {after} ELSE held END AS held, CASE WHEN turned THEN {n(tail)} ELSE n END AS n,
          CASE WHEN turned THEN [{{'t': {whole}, 'n': {n(whole)}::BIGINT, 's': before}}] ELSE []::STRUCT(t VARCHAR, n BIGINT, s VARCHAR)[] END AS closed
        FROM (SELECT f.doc_id, p.r, p.section, f.section AS before, p.text, p.cost, f.held, f.n, p.section <> f.section AND len(f.held) > 0 AS turned FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.r = f.r + 1))))),
ended AS (SELECT doc_id, section, {whole} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) AS back FROM fold),
every AS (
  SELECT doc_id, r, k, closed[k].t AS t, closed[k].n AS n, closed[k].s AS s FROM (SELECT doc_id, r, closed, unnest(range(1, len(closed) + 1)) AS k FROM fold)
  UNION ALL SELECT doc_id, 1000000000, 1, t, {n('t')}, section FROM ended WHERE back = 1)
SELECT 'doc-' || doc_id AS doc_title, (row_number() OVER (PARTITION BY doc_id ORDER BY r, k) - 1)::INTEGER AS chunk_index, s AS doc_section, md5(t) AS h, n::BIGINT AS n FROM every"""


@query("chunk_bioc", _passages_oracle(64, 8))
def chunk_bioc(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("title_1", "paragraph", "table_caption", "paragraph")])
    sections = F.array(*[F.lit(x) for x in ("INTRO", "INTRO", "RESULTS", "REF")])
    d = load(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_title"), F.lit("").alias("doc_url"), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    p = F.transform("l", lambda x, i: F.struct(F.get(sections, (i / 4).cast("int") % 4).alias("section"), F.get(kinds, i % 4).alias("kind"), x.alias("text")))
    c = chunk.chunk_passages(d.select("doc_title", "doc_url", p.alias("passages")), 64, 8)
    return c.select("doc_title", "chunk_index", "doc_section", F.md5("chunk_text").alias("h"), F.col("chunk_tokens").cast("long").alias("n"))


@query("chunk_code")
def chunk_code(spark, sf_dir):
    code = F.concat(F.lit("def f_"), F.col("item_id").cast("string"), F.lit("():\n    return '''"), F.regexp_replace("text", "'", ""), F.lit("'''\n\nclass C:\n    def g(self):\n        return 1\n"))
    return chunk.global_index(chunk.chunk_code(load(spark, sf_dir, "benchmark").select(F.concat(F.lit("p/"), F.col("item_id").cast("string"), F.lit(".py")).alias("path"), code.alias("text")), 32, 4))


INFONS = Fixture("infons", "id int, raw string, kwd string", [(0, "surname:Doe;given-names:Jane", "heart  risk"), (1, "given-names:Li;surname:Wu", None), (2, "surname:Solo", "one"), (3, None, "")]).over("customer", "c_custkey", id="CAST(c_custkey AS INT)", raw="{v} || CAST(c_custkey AS STRING)", kwd="{v} || ' ' || c_mktsegment")


@query("bioc_meta", with_fixtures("SELECT id, CASE WHEN raw IS NULL THEN '' ELSE trim(regexp_extract(raw, '(?:^|;)given-names:([^;]*)', 1) || ' ' || regexp_extract(raw, '(?:^|;)surname:([^;]*)', 1)) END AS authors, array_to_string(list_filter(string_split_regex(coalesce(kwd, ''), '\\s+'), lambda x: x <> ''), ',') AS keywords FROM infons", INFONS))
def bioc_meta(spark, sf_dir):
    d = INFONS.frame(spark, sf_dir).withColumn("m", F.when(F.col("raw").isNotNull(), F.create_map(F.lit("name_0"), "raw", F.lit("name_2"), "raw")).otherwise(F.create_map(F.lit("x"), F.lit("y"))))
    return d.select("id", F.array_join(T.authors_of(F.col("m")), ",").alias("authors"), F.array_join(T.keywords_of(F.col("kwd")), ",").alias("keywords"))


PASSAGES = Fixture("passages", "id int, k string, t string", [(0, "title_1", ""), (1, "fig_caption", " a"), (2, "table_caption", "b "), (3, "paragraph", ""), (4, "abstract_title_1", " "), (5, "title_1", None)]).over("benchmark", "item_id", id="CAST(item_id AS INT)", t="{v} || substr(text, 1, 30)")


@query("passage_text", with_fixtures("SELECT id, CASE WHEN coalesce(trim(t), '') = '' THEN '' WHEN k IN ('title_1', 'title_2', 'abstract_title_1') THEN '# ' || trim(t) || chr(10) WHEN k = 'table_caption' THEN 'Table: ' || trim(t) WHEN k = 'fig_caption' THEN 'Figure: ' || trim(t) ELSE trim(t) END AS t FROM passages", PASSAGES))
def passage_text(spark, sf_dir):
    return PASSAGES.frame(spark, sf_dir).select("id", T.passage_text(F.col("t"), F.col("k")).alias("t"))


_BUCKET = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16"


@query("embed_hash", f"WITH w AS (SELECT item_id, {_BUCKET} AS b FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower('doc: ' || text), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM benchmark)), c AS (SELECT item_id, b, count(*) AS n FROM w GROUP BY ALL) SELECT item_id, b AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM c")
def embed_hash(spark, sf_dir):
    d = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(chunk.hash_embedding(F.col("text"), 16, "doc: ")).alias("place", "value"))
    return d.where("value > 0").select("item_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


ANSWERS = Fixture(
    "answers",
    "qid int, query string, answer string",
    [
        (0, "q0", '```json\n[{"text": "a", "confidence": 0.5}, {"text": "b", "confidence": 1}]\n```'),
        (1, "q1", '{"queries": [{"text": "c", "confidence": 0.1}]}'),
        (2, "q2", "no"),
        (3, "q3", '[{"text": "d", "confidence": 2}]'),
        (4, "q4", ' [{"text": "e", "intent": "i", "rationale": "r"}] '),
        (5, "q5", 'Sure:\n```\n{"queries": [{"text": "f", "confidence": 0}]}\n```\nDone.'),
        (6, "q6", '{"rewrites": [{"text": "g"}]}'),
        (7, "q7", "[]"),
        (8, "q8", '[{"confidence": 0.5}]'),
        (9, "q9", None),
        (10, "q10", "[" + ", ".join(f'{{"text": "t{k}", "confidence": 0.25}}' for k in range(8)) + "]"),
    ],
).over("orders", "o_orderkey", qid="CAST(o_orderkey AS INT)", query="{v} || ' of ' || CAST(o_custkey AS STRING)", answer="replace({v}, '\"text\": \"', '\"text\": \"' || CAST(o_orderkey AS STRING) || ' ')")
_ANSWER = """body AS (SELECT qid, query, TRY(CAST(trim(coalesce(nullif(regexp_extract(answer, '```(?:json)?\\s*(.*?)\\s*```', 1, 's'), ''), answer), ' ' || chr(10)) AS JSON)) AS j FROM answers),
listed AS (SELECT qid, query, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN j->'$.queries' END AS a FROM body),
items AS (SELECT qid, query, CASE WHEN a IS NULL THEN [] ELSE list_transform(CAST(a AS JSON[]), lambda x: {'t': json_extract_string(x, '$.text'), 'c': CAST(json_extract_string(x, '$.confidence') AS DOUBLE)}) END AS l FROM listed),
good AS (SELECT qid, query, CASE WHEN len(list_filter(l, lambda x: x.t IS NULL OR (x.c IS NOT NULL AND (x.c < 0 OR x.c > 1)))) > 0 THEN [] ELSE l[1:5] END AS l FROM items)
SELECT qid, 0 AS rank, query AS text, 1.0::DOUBLE AS confidence FROM good
UNION ALL SELECT qid, k::INTEGER, l[k].t, l[k].c FROM (SELECT qid, l, unnest(range(1, len(l) + 1)) AS k FROM good)"""


@query("parse_llm_json", with_fixtures(", " + _ANSWER, ANSWERS).replace("\n, body", ",\nbody"))
def parse_llm_json(spark, sf_dir):
    return rewrite.rewrites(ANSWERS.frame(spark, sf_dir))


VOCABULARY = Fixture("vocabulary", "term string, preferred string", [("the", "THE"), ("of", "about"), ("et", "and"), ("de", "from")])


@query("offline_rewrite", with_fixtures("SELECT item_id AS qid, string_agg(coalesce(preferred, w), ' ' ORDER BY p) AS rewrite, count(preferred) AS replaced FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM benchmark) LEFT JOIN vocabulary ON lower(w) = term GROUP BY item_id", VOCABULARY))
def offline_rewrite(spark, sf_dir):
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return rewrite.offline_rewrite(q, VOCABULARY.frame(spark, sf_dir))


@query("prompt_format", "SELECT source, CASE WHEN n > 3 THEN array_to_string(list_transform(x[1:3], lambda v: '- ' || v), chr(10)) || chr(10) || '… ' || (n - 3) || ' more omitted' ELSE array_to_string(list_transform(x, lambda v: '- ' || v), chr(10)) END AS prompt FROM (SELECT source, list_sort(list(DISTINCT lang)) AS x, count(DISTINCT lang) AS n FROM documents GROUP BY source)")
def prompt_format(spark, sf_dir):
    d = load(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("x"))
    return d.select("source", rewrite.interpolate(F.lit("{langs}"), {"langs": rewrite.bulleted(F.col("x"), 3, "none")}).alias("prompt"))
