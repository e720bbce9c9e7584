"""Corpora as DataFrames: folders of markdown and code, manifests, article JSON, pages fetched over HTTP."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import stem_title
from lodestone.operators.chunk import IGNORED_FOLDERS

# File stems that describe a folder and are no part of its corpus.
SKIP_STEMS = ["readme", "index", "license", "contributing"]
PASSAGES = "documents array<struct<passages: array<struct<offset: int, infons: map<string, string>, text: string>>>>"


def _files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).text(path, wholetext=True)
    # paths come as they stand in a URI
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return raw.select(path.alias("file"), F.col("value").alias("text"))


def _stem(file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """``title``, ``url``, ``text`` of the ``*.md`` files of one folder, without those that describe it."""
    d = _files(spark, path, "*.md", False).withColumn("stem", _stem(F.col("file")))
    return d.where(~F.lower("stem").isin(SKIP_STEMS)).select(stem_title(F.col("stem")).alias("title"), F.col("file").alias("url"), "text")


def markdown_tree(spark: SparkSession, path: str, urls: DataFrame | None = None) -> DataFrame:
    """Files of ``category/slug/stem.md`` below a folder: title, url (of ``urls``: ``key``, ``url``; else the file), parts, text.

    Only paths of three parts below the folder count; stems that describe a folder go.
    """
    d = _files(spark, path, "*.md", True)
    parts = F.split(F.regexp_replace("file", r"\.md$", ""), "/")
    d = d.select("file", "text", F.slice(parts, -3, 3).alias("p")).select("file", "text", F.col("p")[0].alias("category"), F.col("p")[1].alias("slug"), F.col("p")[2].alias("document_type"))
    d = d.where(~F.lower("document_type").isin(SKIP_STEMS)).withColumn("title", F.concat_ws("/", "category", "slug", "document_type"))
    if urls is None:
        return d.withColumnRenamed("file", "url")
    named = d.withColumn("key", F.concat_ws("/", "slug", "document_type")).join(urls.withColumnRenamed("url", "_url"), "key", "left")
    return named.withColumn("url", F.coalesce("_url", "file")).drop("key", "_url", "file")


def url_map(entries: DataFrame) -> DataFrame:
    """``key`` (slug/kind) and ``url`` of manifest entries with columns ``slug`` and ``<kind>_url``; missing urls go."""
    kinds = [c[:-4] for c in entries.columns if c.endswith("_url")]
    listed = F.array(*[F.struct(F.concat("slug", F.lit(f"/{k}")).alias("key"), F.col(f"{k}_url").alias("url")) for k in kinds])
    return entries.select(F.explode(listed).alias("e")).select("e.key", "e.url").where("url IS NOT NULL AND url <> ''")


def manifest(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The entries listed under ``field`` of a JSON manifest, with an explicit schema."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(field).alias("e")).select("e.*")


def join_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries with the text of the file of their ``stem``; those without a file are left out."""
    return entries.where(~F.lower("stem").isin(SKIP_STEMS)).join(files.withColumn("stem", _stem(F.col("file"))).select("stem", "text"), "stem")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``passages`` of article JSON, in a list or bare: the first document of each file."""
    d = _files(spark, path, "*.json", True)
    bare = F.from_json("text", PASSAGES)
    wrapped = F.get(F.from_json("text", f"array<struct<{PASSAGES.replace(' array', ': array', 1)}>>"), F.lit(0))
    docs = F.when(F.startswith(F.trim("text"), F.lit("[")), wrapped["documents"]).otherwise(bare["documents"])
    return d.select("file", F.get(docs, F.lit(0))["passages"].alias("passages"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, or a folder of such, read by an explicit schema."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows listed under ``questions`` of evaluation sets in JSON."""
    return manifest(spark, path, "questions", schema)


def choose_questions(asked: DataFrame, total: int, register: str = "language_register", first: str = "lay", then: str = "clinical", key: str = "id", seed: int = 42) -> DataFrame:
    """All questions of one register, and of another as many as make ``total``: those whose hashes are smallest, the same for the same seed."""
    drawn = F.md5(F.concat_ws("/", F.col(key), F.lit(str(seed))))
    own, other = asked.where(F.col(register) == first), asked.where(F.col(register) == then)
    missing = max(total - own.count(), 0)
    return own.unionByName(other.withColumn("_h", drawn).orderBy("_h", key).limit(missing).drop("_h"))


def code_tree(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of the ``*.py`` files below a folder, outside ignored folders; blank ones go."""
    d = _files(spark, path, "*.py", True).withColumnRenamed("file", "path")
    ignored = F.array(*[F.lit(x) for x in IGNORED_FOLDERS])
    return d.where(~F.arrays_overlap(F.split("path", "/"), ignored) & F.rlike("text", F.lit(r"\S")))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("url"), F.col("content").alias("raw_bytes"))


def _get(url: str, timeout: float, retries: int = 3) -> tuple[int, str, bytes]:
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.status, r.headers.get("Content-Type", ""), r.read()
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == retries:
                return e.code, "", b""
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                return 0, "", b""
        time.sleep(2**attempt)
    return 0, "", b""


def fetch(urls: DataFrame, timeout: float = 60, get: Callable[[str, float], tuple[int, str, bytes]] = _get) -> DataFrame:
    """``url``, ``status``, ``content_type``, ``raw_bytes`` of each url; failures carry their status instead of ending the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, *get(u, timeout)) for u in batch["url"]]
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "raw_bytes"])

    return urls.select("url").mapInPandas(run, "url string, status int, content_type string, raw_bytes binary")


def passthrough(requests: DataFrame, ask: Callable[[str, int], list[dict]], top_k: int = 5) -> DataFrame:
    """Answers of an external search system as results: ``qid``, ``rank``, ``text``, ``score``, ``source_uri``, ``metadata`` (JSON), ``error``.

    ``ask`` takes a query and a number of results and returns dicts; it is called on the
    executors. A failure is a row with its message, in place of the results of that query.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for qid, query in zip(batch["qid"], batch["query"], strict=True):
                try:
                    found = ask(query, top_k)[:top_k]
                except (OSError, ValueError, KeyError) as e:
                    rows.append((qid, None, None, None, None, None, str(e)))
                    continue
                for rank, hit in enumerate(found, 1):
                    known = {k: hit[k] for k in hit if k not in ("text", "score", "source_uri")}
                    rows.append((qid, rank, hit.get("text", ""), float(hit.get("score", 0.0)), hit.get("source_uri"), json.dumps(known, sort_keys=True), None))
            yield pd.DataFrame(rows, columns=["qid", "rank", "text", "score", "source_uri", "metadata", "error"]).astype({"rank": "Int32"})

    return requests.select("qid", "query").mapInPandas(run, "qid long, rank int, text string, score double, source_uri string, metadata string, error string")


def repository_files(requests: DataFrame, get: Callable[[str, float], tuple[int, str, bytes]] = _get, api: str = "https://api.github.com") -> DataFrame:
    """``repo``, ``path``, ``ref``, ``text``, ``error`` of single files of hosted repositories (``repo``, ``path``, ``ref``)."""

    def one(repo: str, path: str, ref: str | None) -> tuple[str | None, str | None]:
        status, _, body = get(f"{api}/repos/{repo}/contents/{path}" + (f"?ref={ref}" if ref else ""), 30)
        if status != 200:
            return None, {404: "not found", 403: "forbidden"}.get(status, f"status {status}")
        found = json.loads(body)
        if not isinstance(found, dict) or found.get("type") != "file":
            return None, "not a file"
        return base64.b64decode(found.get("content", "")).decode("utf-8", errors="replace"), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, p, ref, *one(r, p, ref)) for r, p, ref in zip(batch["repo"], batch["path"], batch["ref"], strict=True)]
            yield pd.DataFrame(rows, columns=["repo", "path", "ref", "text", "error"])

    return requests.select("repo", "path", "ref").mapInPandas(run, "repo string, path string, ref string, text string, error string")


def retrieve_files(requests: DataFrame, recipes: DataFrame, get: Callable[[str, float], tuple[int, str, bytes]] = _get) -> DataFrame:
    """Single files as results. ``requests``: ``qid``, ``slug``, ``path``, ``ref``; ``recipes``: ``slug``, ``github_repo`` of known sources.

    One hit of score 1.0 for each request, of the file as it is at its ``ref``; ``error`` tells unknown sources, sources without a
    repository, and what the repository answers.
    """
    named = requests.join(recipes.withColumn("_known", F.lit(True)), "slug", "left")
    wrong = F.when(F.col("_known").isNull(), "unknown source").when(F.coalesce("github_repo", F.lit("")) == "", "no repository")
    wanted = named.where(F.coalesce("github_repo", F.lit("")) != "").select(F.col("github_repo").alias("repo"), "path", "ref").distinct()
    found = repository_files(wanted, get).toDF("_repo", "_path", "_ref", "text", "error")
    same = (F.col("github_repo") == F.col("_repo")) & (F.col("path") == F.col("_path")) & F.col("ref").eqNullSafe(F.col("_ref"))
    out = named.withColumn("wrong", wrong).join(found, same, "left")
    error = F.coalesce("wrong", "error")
    return out.select("qid", "slug", F.lit("").alias("chunk_id"), F.col("path").alias("doc_title"), "text", F.when(error.isNull(), 1.0).alias("score"), error.alias("error"))
