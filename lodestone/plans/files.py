"""Sources and sinks end to end: files are written to a shared folder, scanned, and compared with the tables that they came from."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import chunk, rewrite
from lodestone.plans.base import INDEXES, RECIPES, SOURCES, Fixture, load, query, tagged, with_fixtures
from lodestone.plans.texts import windows_sql
from lodestone.sources import scan, sink
from lodestone.sources.places import shared_folder, write_files


def _nations(spark, sf_dir) -> list:
    """The 25 nations with their regions: few enough to be written as files by the driver."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).orderBy("n_nationkey").collect()


_NATIONS = "(SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("scan_tree", f"SELECT r_name || '/' || n_name || '/guide' AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'http://n/' || n_nationkey END AS url, md5('# ' || n_name || chr(10) || 'é') AS h FROM {_NATIONS}")
def scan_tree(spark, sf_dir):
    """Folders of category and slug; files that describe a folder are left out, urls come from a manifest."""
    rows = _nations(spark, sf_dir)
    files = {f"tree/{r.r_name}/{r.n_name}/guide.md": f"# {r.n_name}\né" for r in rows} | {f"tree/{rows[0].r_name}/{rows[0].n_name}/README.md": "no", "tree/top.md.txt": "no"}
    files["manifest.json"] = json.dumps({"entries": [{"slug": r.n_name, "guide_url": f"http://n/{r.n_nationkey}" if r.n_nationkey % 2 == 0 else ""} for r in rows]})
    folder = write_files(spark, shared_folder(spark, "tree"), files)
    urls = scan.url_map(scan.manifest(spark, f"{folder}/manifest.json", "entries", "slug: string, guide_url: string"))
    d = scan.markdown_tree(spark, f"{folder}/tree", urls)
    return d.select("title", F.when(F.startswith("url", F.lit("http")), F.col("url")).alias("url"), F.md5("text").alias("h"))


@query("scan_folder", "SELECT upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) || ' Notes' AS title, md5(r_name) AS h FROM region WHERE NOT contains(r_name, ' ')")
def scan_folder(spark, sf_dir):
    rows = [r.r_name for r in load(spark, sf_dir, "region").where("NOT contains(r_name, ' ')").collect()]
    folder = write_files(spark, shared_folder(spark, "folder"), {f"{r.lower()}-notes.md": r for r in rows} | {"Contributing.md": "no", "deep/x.md": "no", "x.txt": "no"})
    return scan.markdown_folder(spark, folder).select("title", F.md5("text").alias("h"))


@query("scan_articles", f"SELECT r_name AS article, count(*) AS passages, string_agg(n_name, '|' ORDER BY n_nationkey) AS texts FROM {_NATIONS} GROUP BY r_name")
def scan_articles(spark, sf_dir):
    """Article JSON, half of it in a list and half bare."""
    files: dict[str, list] = {}
    for r in _nations(spark, sf_dir):
        files.setdefault(r.r_name, []).append({"offset": r.n_nationkey, "infons": {"section_type": "INTRO", "type": "paragraph"}, "text": r.n_name})
    whole = {name: {"documents": [{"passages": p}, {"passages": []}]} for name, p in files.items()}
    folder = write_files(spark, shared_folder(spark, "articles"), {f"{name}.json": json.dumps([d] if k % 2 else d) for k, (name, d) in enumerate(whole.items())})
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    texts = F.array_join(F.transform("passages", lambda p: p["text"]), "|")
    return scan.articles(spark, folder).select(name.alias("article"), F.size("passages").cast("long").alias("passages"), texts.alias("texts"))


@query("scan_code", "SELECT n_name || '.py' AS file, md5('x = ' || n_nationkey) AS h FROM nation")
def scan_code(spark, sf_dir):
    files = {f"src/{r.r_name}/{r.n_name}.py": f"x = {r.n_nationkey}" for r in _nations(spark, sf_dir)} | {"src/.venv/no.py": "y", "src/__pycache__/no.py": "y", "src/blank.py": " \n", "src/no.txt": "y"}
    folder = write_files(spark, shared_folder(spark, "code"), files)
    return scan.code_tree(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("text").alias("h"))


@query("scan_manifest", "SELECT n_name AS stem, 'Nation ' || n_nationkey AS title, md5(n_name) AS h FROM nation WHERE n_nationkey % 3 <> 0")
def scan_manifest(spark, sf_dir):
    """Entries of a manifest with their files; entries without a file and files that describe a folder are left out."""
    rows = _nations(spark, sf_dir)
    files = {f"f/{r.n_name}.md": r.n_name for r in rows if r.n_nationkey % 3} | {"f/readme.md": "no"}
    files["m.json"] = json.dumps({"articles": [{"stem": r.n_name, "title": f"Nation {r.n_nationkey}"} for r in rows] + [{"stem": "readme", "title": "no"}]})
    folder = write_files(spark, shared_folder(spark, "manifest"), files)
    entries = scan.manifest(spark, f"{folder}/m.json", "articles", "stem: string, title: string")
    return scan.join_files(entries, scan._files(spark, f"{folder}/f", "*.md", False)).select("stem", "title", F.md5("text").alias("h"))


@query("scan_csv", "SELECT doc_id, lang, source, n_chars, md5(text) AS h FROM documents")
def scan_csv(spark, sf_dir):
    """All documents through CSV files, texts with quotes and line ends included."""
    path = f"{shared_folder(spark, 'csv')}/documents"
    load(spark, sf_dir, "documents").write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    d = scan.csv_table(spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("h"))


@query(
    "scan_questions",
    "WITH q AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'lay' ELSE 'clinical' END AS r, n_name AS question FROM nation), c AS (SELECT *, row_number() OVER (ORDER BY md5(id || '/42'), id) AS k FROM q WHERE r = 'clinical') SELECT id, r AS language_register, question FROM q WHERE r = 'lay' UNION ALL SELECT id, r, question FROM c WHERE k <= 12 - (SELECT count(*) FROM q WHERE r = 'lay')",
)
def scan_questions(spark, sf_dir):
    """An evaluation set in JSON: all lay questions, and as many clinical ones as make twelve."""
    asked = [{"id": r.n_nationkey, "question": r.n_name, "language_register": "clinical" if r.n_nationkey % 4 else "lay"} for r in _nations(spark, sf_dir)]
    folder = write_files(spark, shared_folder(spark, "questions"), {"qa.json": json.dumps({"questions": asked, "name": "x"}, indent=1)})
    q = scan.questions(spark, f"{folder}/qa.json", "id: int, question: string, language_register: string")
    return scan.choose_questions(q, 12).select("id", "language_register", "question")


@query("scan_binary", "SELECT r_name || '.pdf' AS file, 6 + strlen(r_name) AS bytes, md5('%PDF-' || r_name || chr(10)) AS h FROM region")
def scan_binary(spark, sf_dir):
    names = [r.r_name for r in load(spark, sf_dir, "region").collect()]
    folder = write_files(spark, shared_folder(spark, "binary"), {f"a/{n}.pdf": f"%PDF-{n}\n".encode() for n in names} | {"a/no.txt": b"x"})
    d = scan.binary_files(spark, folder)
    return d.select(F.url_decode(F.element_at(F.split("url", "/"), -1)).alias("file"), F.octet_length("raw_bytes").cast("long").alias("bytes"), F.md5("raw_bytes").alias("h"))


def _answer(url: str, timeout: float) -> tuple[int, str, bytes]:
    """A server of made-up pages: every fifth is missing, every seventh fails."""
    k = int(url.rpartition("/")[2])
    if k % 5 == 0:
        return 404, "", b""
    return (0, "", b"") if k % 7 == 0 else (200, "text/html; charset=utf-8", f"<p>{k}</p>".encode())


@query("fetch_pages", "SELECT 'http://x/' || page_id AS url, CASE WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 7 = 0 THEN 0 ELSE 200 END AS status, CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN '' ELSE '<p>' || page_id || '</p>' END AS body FROM pages")
def fetch_pages(spark, sf_dir):
    urls = load(spark, sf_dir, "pages").select(F.concat(F.lit("http://x/"), F.col("page_id").cast("string")).alias("url"))
    return scan.fetch(urls, get=_answer).select("url", "status", F.col("raw_bytes").cast("string").alias("body"))


REPOSITORIES = Fixture(
    "recipe_contents",
    "id string, content string",
    [("r1", "{}"), ("r2", '{"github_repo":"own/guides","embedding":{"model":"large"}}'), ("r3", '{"embedding":{"model":"small"}}'), ("r4", '{"github_repo":""}')],
).over("supplier", "s_suppkey", every=True, id=tagged("s_suppkey"))
WANTED = Fixture("wanted", "qid long, slug string, path string, ref string", [(0, "guidelines", "a.md", None), (1, "guidelines", "dir", "v1"), (2, "bulletins", "a.md", None), (3, "nobody", "a.md", None), (4, "guidelines", "gone.md", None), (5, "articles", "a.md", "v2"), (6, "guidelines", "big.md", None), (7, "guidelines", "a.md", "v1"), (8, "guidelines", "a.md", "v2"), (9, "guidelines", "a.md", "v1")]).over("supplier", "s_suppkey", every=True, qid="{v} + 10 * CAST(s_suppkey AS BIGINT)", slug=tagged("s_suppkey"))


def _repository(url: str, timeout: float) -> tuple[int, str, bytes]:
    import base64

    path, _, ref = url.partition("/contents/")[2].partition("?ref=")
    if path == "dir":
        return 200, "", b'{"type": "dir"}'
    if path == "big.md":
        return 403, "", b""
    return (200, "", json.dumps({"type": "file", "content": base64.b64encode(f"text of a{ref}".encode()).decode()}).encode()) if path == "a.md" else (404, "", b"")


_REPO = "named AS (SELECT s.slug, json_extract_string(r.content, '$.github_repo') AS github_repo, json_extract_string(r.content, '$.embedding.model') AS embedding_model FROM sources s LEFT JOIN indexes i ON i.id = s.active_index LEFT JOIN recipe_contents r ON r.id = i.recipe_id)"


@query("recipe_attributes", with_fixtures(f", {_REPO} SELECT * FROM named", SOURCES, INDEXES, REPOSITORIES).replace("\n, named", ",\nnamed"))
def recipe_attributes(spark, sf_dir):
    from lodestone.operators import catalog

    return catalog.recipe_attributes(SOURCES.frame(spark, sf_dir), INDEXES.frame(spark, sf_dir), REPOSITORIES.frame(spark, sf_dir))


@query(
    "retrieve_file",
    with_fixtures(
        f", {_REPO}, e AS (SELECT w.qid, w.slug, path, ref, CASE WHEN n.slug IS NULL THEN 'unknown source' WHEN coalesce(github_repo, '') = '' THEN 'no repository' WHEN path = 'dir' THEN 'not a file' WHEN path = 'big.md' THEN 'forbidden' WHEN path <> 'a.md' THEN 'not found' END AS error FROM wanted w LEFT JOIN named n USING (slug)) SELECT qid, slug, '' AS chunk_id, path AS doc_title, CASE WHEN error IS NULL THEN 'text of a' || coalesce(ref, '') END AS text, CASE WHEN error IS NULL THEN 1.0::DOUBLE END AS score, error FROM e",
        SOURCES, INDEXES, REPOSITORIES, WANTED,
    ).replace("\n, named", ",\nnamed"),
)
def retrieve_file(spark, sf_dir):
    """Single files of the repositories that sources' recipes name, as hits."""
    return scan.retrieve_files(WANTED.frame(spark, sf_dir), recipe_attributes(spark, sf_dir).select("slug", "github_repo"), _repository)


def _external(question: str, top_k: int) -> list[dict]:
    if "SA" in question:
        raise ConnectionError("down")
    return [{"text": f"{question} {k}", "score": 1 / k, "source_uri": f"ext:{k}", "kind": "e"} for k in range(1, 9)]


@query("passthrough_external", "SELECT n_nationkey::BIGINT AS qid, k::INTEGER AS rank, n_name || ' ' || k AS text, round(1.0::DOUBLE / k, 6) AS score, 'ext:' || k AS source_uri, '{\"kind\": \"e\"}' AS metadata, CAST(NULL AS VARCHAR) AS error FROM nation, range(1, 4) t(k) WHERE NOT contains(n_name, 'SA') UNION ALL SELECT n_nationkey, NULL, NULL, NULL, NULL, NULL, 'down' FROM nation WHERE contains(n_name, 'SA')")
def passthrough_external(spark, sf_dir):
    asked = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("query"))
    return scan.passthrough(asked, _external, 3).withColumn("score", F.round("score", 6))


@query("chunk_table", f"WITH {windows_sql(512, 64)} SELECT 'doc-' || doc_id AS doc_title, chunk_index, len(w) AS chunk_tokens, sha256('u' || doc_id || '|doc-' || doc_id || '|' || chunk_index || '|' || array_to_string(w, ' ')) AS id FROM cut")
def chunk_table(spark, sf_dir):
    """Chunks with vectors through the sink: stable ids, all or nothing."""
    key = F.col("doc_id").cast("string")
    c = chunk.fixed_windows(load(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), key).alias("doc_title"), F.concat(F.lit("u"), key).alias("doc_url"), "text"), 512, 64)
    vector = F.array(F.col("chunk_tokens").cast("float"), F.lit(1.0).cast("float"))
    path = f"{shared_folder(spark, 'chunks')}/table"
    sink.write_chunks(c.select("chunk_text", "chunk_tokens", "doc_title", "doc_url", F.lit(None).cast("string").alias("doc_section"), "chunk_index", vector.alias("embedding")), path, 2)
    return sink.read_chunks(spark, path).select("doc_title", "chunk_index", F.col("chunk_tokens").cast("long").alias("chunk_tokens"), "id")


@query("create_table", "SELECT step, there, n_columns, (SELECT count(*) FROM supplier) * step AS n_rows FROM (VALUES (0, false, 0), (1, true, 8), (2, true, 8)) v(step, there, n_columns)")
def create_table(spark, sf_dir):
    """A chunk table that is created if it isn't there, twice, and filled each time with a row a supplier."""
    import uuid

    name, seen = f"lodestone_{uuid.uuid4().hex}", []
    for step in range(3):
        there = sink.table_exists(spark, name)
        seen.append((step, there, len(spark.table(name).columns) if there else 0, spark.table(name).count() if there else 0))
        sink.create_chunk_table(spark, name)
        made = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("chunk_text"), F.col("s_suppkey").cast("int").alias("chunk_index"))
        columns = {f.name: f.dataType for f in spark.table(name).schema.fields}
        made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]).write.insertInto(name)
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(seen, "step int, there boolean, n_columns int, n_rows long")


@query("write_scores", "SELECT o_orderkey, round(o_totalprice / 7, 4) AS score, kind FROM orders, (VALUES ('csv'), ('json')) v(kind)")
def write_scores(spark, sf_dir):
    """Scores as CSV and as JSON, to four places."""
    scores, folder = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 7).alias("score")), shared_folder(spark, "scores")
    for kind in ("csv", "json"):
        sink.write_scores(scores, f"{folder}/{kind}", kind)
    schema = "o_orderkey long, score double"
    csv, lines = scan.csv_table(spark, f"{folder}/csv", schema), spark.read.schema(schema).json(f"{folder}/json")
    return csv.withColumn("kind", F.lit("csv")).unionByName(lines.withColumn("kind", F.lit("json")))


@query("write_corpus", "SELECT 'corpus' AS part, item_id AS id, md5(text) AS h FROM benchmark UNION ALL SELECT 'qa', n_nationkey, md5(n_name) FROM nation")
def write_corpus(spark, sf_dir):
    docs = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("texts"))
    path = shared_folder(spark, "corpus")
    sink.write_corpus(docs, load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("question")), path)
    corpus, qa = spark.read.parquet(f"{path}/corpus"), spark.read.parquet(f"{path}/qa")
    return corpus.select(F.lit("corpus").alias("part"), "id", F.md5("contents").alias("h")).unionAll(qa.select(F.lit("qa"), "id", F.md5("question")))


@query("stage_once", "SELECT n_regionkey, count(*) AS n, 1 AS built FROM nation GROUP BY n_regionkey")
def stage_once(spark, sf_dir):
    """A stage that is built when it is first asked for, and read when it is asked for again."""
    path, built = f"{shared_folder(spark, 'stages')}/counts", []

    def build():
        built.append(1)
        return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))

    sink.once(spark, path, build)
    return sink.once(spark, path, build).withColumn("built", F.lit(len(built)))


TITLES = Fixture(
    "titles",
    "id int, title string, headings array<string>",
    [
        (0, "VA/DOD Clinical Practice Guideline for &amp; X", []),
        (1, "Pocket card", ["Intro", "VA/DOD CLINICAL PRACTICE GUIDELINE: diagnosi s", "Clinical practice guideline two"]),
        (2, "Clinical Practice Guidelines", ["none"]),
        (3, "DIAGNOSI S of Y", []),
        (4, "Clinical Practice Guidelines", ["The clinical practice guideline."]),
        (5, "Clinical practice guidelinest", []),
    ],
).over("part", "p_partkey", id="CAST(p_partkey AS INT)", title="{v} || ', no. ' || CAST(p_partkey AS STRING)")
_MEND = "replace(replace(replace({0}, '&amp;', '&'), 'VA/DOD', 'VA/DoD'), 'DIAGNOSI S', 'DIAGNOSIS')"
_NAMED = "regexp_matches({0}, '(?i)CLINICAL PRACTICE GUIDELINE([^A-Za-z0-9_]|$)')"


@query(
    "guideline_title",
    with_fixtures(
        f"SELECT id, CASE WHEN {_NAMED.format('t')} THEN replace(upper(t), 'VA/DOD', 'VA/DoD') ELSE t END AS title FROM (SELECT id, CASE WHEN {_NAMED.format('own')} THEN own ELSE coalesce(list_filter(hs, lambda x: {_NAMED.format('x')})[1], own) END AS t FROM (SELECT id, {_MEND.format('title')} AS own, list_transform(headings, lambda y: {_MEND.format('y')}) AS hs FROM titles))",
        TITLES,
    ),
)
def guideline_title(spark, sf_dir):
    from lodestone.functions.text import guideline_title as named

    return TITLES.frame(spark, sf_dir).select("id", named(F.col("title"), F.col("headings")).alias("title"))


PARAMS = Fixture("params", "id int, p string", [(0, "{'module_type': 'x', 'chunk_method': 'Token', 'chunk_size': 512, 'chunk_overlap': 64}"), (1, '{"chunk_method": "Sentence", "chunk_overlap": 0, "chunk_size": 1024}'), (2, "{'chunk_size': 3}"), (3, None)]).over("orders", "o_orderkey", id="CAST(o_orderkey AS INT)", p="replace({v}, '512', CAST(o_orderkey AS STRING))")
_PARAM = "nullif(regexp_extract(p, '[''\"]{0}[''\"]\\s*:\\s*[''\"]?([^''\",}}\\s]+)', 1), '')"


@query("chunker_label", with_fixtures("SELECT id, " + " || '-' || ".join(_PARAM.format(n) for n in ("chunk_method", "chunk_size", "chunk_overlap")) + " AS label FROM params", PARAMS))
def chunker_label(spark, sf_dir):
    from lodestone.functions.text import chunker_label as label

    return PARAMS.frame(spark, sf_dir).select("id", label(F.col("p")).alias("label"))


CACHE = Fixture("cache_rows", "slug string, version int, question string, context string, answer string, stored int", [("a", 1, "q", None, "old", 1), ("a", 1, "q", None, "new", 2), ("a", 1, "q", "", "other", 5), ("b", 1, "q", None, "b", 1)]).over("supplier", "s_suppkey", every=True, slug=tagged("s_suppkey"), answer="{v} || s_name")
ASKED = Fixture("asked", "qid int, slug string, version int, question string, context string", [(0, "a", 1, "q", None), (1, "a", 2, "q", None), (2, "a", 1, "q", ""), (3, "b", 1, "r", None), (4, "b", 1, "q", None)]).over("supplier", "s_suppkey", every=True, slug=tagged("s_suppkey"), qid="{v} + 5 * CAST(s_suppkey AS INT)")


@query(
    "rewrite_cache",
    with_fixtures("SELECT qid, (SELECT arg_max(answer, stored) FROM cache_rows c WHERE c.slug = a.slug AND c.version = a.version AND c.question = a.question AND c.context IS NOT DISTINCT FROM a.context) AS answer FROM asked a", CACHE, ASKED),
)
def rewrite_cache(spark, sf_dir):
    parts = ["slug", "version", "question", "context"]
    cache = CACHE.frame(spark, sf_dir).select(rewrite.cache_key(*parts).alias("key"), "answer", "stored")
    hits, misses = rewrite.with_cache(ASKED.frame(spark, sf_dir), cache, *parts)
    return hits.select("qid", "answer").unionAll(misses.select("qid", F.lit(None).cast("string")))


@query("latency_percentiles", "SELECT event_type, count(*) AS calls, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    from lodestone.operators.evaluation import latency_percentiles as percentiles

    return percentiles(load(spark, sf_dir, "events"), "event_type", "value")


@query("annotate", "SELECT c.conv_id, c.turn, coalesce((SELECT string_agg(e.event_type, ',' ORDER BY e.event_id) FROM events e WHERE e.event_id = c.conv_id * 3 + c.turn OR e.event_id = (c.conv_id * 3 + c.turn) + 100), '') AS notes FROM conversations c")
def annotate(spark, sf_dir):
    """Notes of agents beside chunks that stay as they are; two events are notes on each message."""
    from lodestone.operators import catalog

    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).alias("chunk_id"))
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("event_type").alias("note"))
    notes = e.withColumn("chunk_id", F.col("at")).unionAll(e.withColumn("chunk_id", F.col("at") - 100))
    return catalog.annotate(c, notes).select("conv_id", "turn", F.array_join("notes", ",").alias("notes"))


WRITES = Fixture("writes", "request_id string, sub string, slug string, mode string, item_id string", [("q1", "bob", "bulletins", "append", "i2"), ("q1", "bob", "bulletins", "append", "i1"), ("q1", "bob", "bulletins", "append", "i1"), ("q2", "ann", "guidelines", "annotate", "c9"), ("q3", "bot", "engine-code", "upsert", "k")]).over("supplier", "s_suppkey", every=True, request_id=tagged("s_suppkey"), slug=tagged("s_suppkey"), item_id=tagged("s_suppkey"))


@query("audit_records", with_fixtures("SELECT request_id, sub, w.slug, mode, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items, any_value(v.version) AS recipe_version FROM writes w LEFT JOIN (SELECT s.slug, r.version FROM sources s JOIN indexes i ON i.id = s.active_index JOIN recipes r ON r.id = i.recipe_id) v USING (slug) GROUP BY ALL", SOURCES, INDEXES, WRITES, RECIPES).replace("any_value(v.version)", "max(v.version)"))
def audit_records(spark, sf_dir):
    from lodestone.operators import catalog

    a = catalog.audit_records(WRITES.frame(spark, sf_dir), SOURCES.frame(spark, sf_dir), INDEXES.frame(spark, sf_dir), RECIPES.frame(spark, sf_dir))
    return a.select("request_id", "sub", "slug", "mode", F.array_join("item_ids", ",").alias("items"), "recipe_version")



@query("row_count", "SELECT count(*) AS written, sum(n_chars)::BIGINT AS tokens, count(*) AS n FROM documents WHERE doc_id % 2 = 0")
def row_count(spark, sf_dir):
    """What a write tells of its rows, and their number when they are counted again."""
    d = load(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    vector = F.array(F.lit(1.0).cast("float"))
    c = d.select(F.col("text").alias("chunk_text"), F.col("n_chars").cast("int").alias("chunk_tokens"), F.col("source").alias("doc_title"), F.col("lang").alias("doc_url"), F.lit(None).cast("string").alias("doc_section"), F.col("doc_id").cast("int").alias("chunk_index"), vector.alias("embedding"))
    path = f"{shared_folder(spark, 'counted')}/table"
    written, tokens = sink.write_chunks(c, path, 1)
    return spark.createDataFrame([(written, tokens, sink.count_rows(spark, path))], "written long, tokens long, n long")


_tried: set[str] = set()


def _unsteady(texts: list[str]) -> list[list[float]]:
    """A model that fails the first time it is asked for a batch in a process."""
    if texts[0] not in _tried:
        _tried.add(texts[0])
        raise TimeoutError("try again")
    return [[float(len(t)), float(k)] for k, t in enumerate(texts)]


@query("embed_retry", "SELECT item_id, 5.0::DOUBLE + length(text) AS n FROM benchmark")
def embed_retry(spark, sf_dir):
    """Vectors by a model that fails at first: batches are asked for again, and come back in order."""
    e = chunk.embed(load(spark, sf_dir, "benchmark"), "text", "v", _unsteady, batch=500, prefix="doc: ")
    return e.select("item_id", F.get("v", F.lit(0)).alias("n"))


@query("prompt_template", "SELECT n_nationkey, 'Answer for ' || n_name || ':' || chr(10) AS prompt FROM nation")
def prompt_template(spark, sf_dir):
    """Prompts by a template that is read from a file of the shared folder."""
    folder = write_files(spark, shared_folder(spark, "template"), {"t.yaml": "name: n\nversion: 1\nsystem: |\n  Answer for {nation}:\nuser: q\n"})
    text = rewrite.load_template(spark, f"{folder}/t.yaml")["system"]
    return load(spark, sf_dir, "nation").select("n_nationkey", rewrite.interpolate(F.lit(text), {"nation": F.col("n_name")}).alias("prompt"))
