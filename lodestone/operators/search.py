"""Exact vector search, keyword search, and the union and deduplication of their hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import like_escape
from lodestone.functions.vector import cosine

#: Scores, and components of the corpus' vectors, that a task has in memory at a time, however many queries and rows there are.
BLOCK_SCORES, BLOCK_NUMBERS = 1 << 20, 1 << 20
#: Bytes of query vectors that one pass over the corpus answers; more take further passes.
PASS_BYTES = 64_000_000


def top_k(corpus: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows most like one query vector (``TakeOrderedAndProject``: a bounded heap in each task)."""
    scored = corpus.withColumn("score", cosine(vector, F.array(*[F.lit(float(x)) for x in query])))
    return scored.where("score IS NOT NULL").drop(vector).orderBy(F.desc("score"), id_col).limit(k)


def typed_filter(url_prefix: str | None = None, kinds: list | None = None, since: str | None = None, until: str | None = None, url: str = "doc_url", kind: str = "kind", at: str = "at") -> Column:
    """A filter of search by the beginning of a url, by kinds of documents, and by a span of time (its end left out); what isn't given doesn't restrict."""
    found = F.lit(True)
    if url_prefix is not None:
        found = found & F.startswith(F.col(url), F.lit(url_prefix))
    if kinds is not None:
        found = found & F.col(kind).isin(kinds)
    if since is not None:
        found = found & (F.col(at) >= F.lit(since).cast("timestamp"))
    if until is not None:
        found = found & (F.col(at) < F.lit(until).cast("timestamp"))
    return found


def filtered_top_k(corpus: DataFrame, query: list[float], k: int, condition: Column, **names: str) -> DataFrame:
    """``top_k`` among the rows that meet a condition, which is pushed into the scan."""
    return top_k(corpus.where(condition), query, k, **names)


def _normed(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch are there, of ``d`` components, and these as rows of a matrix; null components are NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    valid = np.flatnonzero(lengths == d)
    flat = column.take(pa.array(valid)).flatten().to_numpy(zero_copy_only=False)
    return valid, flat.astype(np.float64).reshape(len(valid), d)


def _block_scores(queries: Broadcast, k: int, unit: bool):
    """Of each batch the ``k`` best rows for every query; products in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, every = queries.value
        most = max(k + 1, BLOCK_NUMBERS // max(every.shape[1], 1))
        for batch in (whole.slice(start, most) for whole in batches for start in range(0, whole.num_rows, most)):
            valid, rows = _vectors(batch.column(1), every.shape[1])
            own = batch.column(0).to_numpy(zero_copy_only=False)[valid]
            if unit:
                shown = np.linalg.norm(rows, axis=1) > 0  # neither zero nor NaN
                rows, own = _normed(rows[shown]), own[shown]
            keep = min(k + 1, len(own))  # one more: a query may meet itself
            if not keep:
                continue
            step = max(1, BLOCK_SCORES // len(own))
            for start in range(0, len(every), step):
                score = every[start : start + step] @ rows.T
                kth = np.partition(score, len(own) - keep, axis=1)[:, len(own) - keep]
                q, r = np.nonzero(score >= kth[:, None] - 1e-9)  # ties at the edge are kept for the final ranking
                yield pa.RecordBatch.from_arrays([pa.array(ids[start + q]), pa.array(own[r]), pa.array(score[q, r])], names=["qid", "id", "score"])

    return run


def _passes(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, cut by length of the vectors and by ``PASS_BYTES``."""
    held: dict[int, list] = {}

    def arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r.qid for r in rows], dtype=np.int64), np.array([r.qvec for r in rows], dtype=np.float64)

    for row in queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec")).where("qvec IS NOT NULL").toLocalIterator():
        d = len(row.qvec)
        held.setdefault(d, []).append(row)
        if len(held[d]) * 8 * d >= PASS_BYTES:
            yield arrays(held.pop(d))
    for rows in held.values():
        yield arrays(rows)


def batch_top_k(
    queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", unit: bool = True, digits: int = 9
) -> DataFrame:
    """``qid``, ``id``, ``score``, ``rank`` of the ``k`` best rows for every query, itself excluded.

    ``queries``: ``qid`` and ``qvec``. As many as ``PASS_BYTES`` hold are answered by one scan
    of the corpus, to which they are broadcast; a task keeps the best of each batch, so that
    what is shuffled grows with queries times tasks and not with the corpus. Equal scores
    (to ``digits``) rank by id. Query sets of many passes are better joined to cells
    (``index.clusters``), where they never come to the driver.
    """
    spark, scored = queries.sparkSession, None
    for ids, matrix in _passes(queries):
        shared = spark.sparkContext.broadcast((ids, _normed(matrix) if unit else matrix))
        part = corpus.select(F.col(id_col).cast("long"), vector).mapInArrow(_block_scores(shared, k, unit), "qid long, id long, score double")
        scored = part if scored is None else scored.unionAll(part)
    if scored is None:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), "id")
    return scored.where("qid <> id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_hits(chunks: DataFrame, patterns: list[str], text: str = "chunk_text") -> DataFrame:
    """Rows whose text holds any of the patterns, whatever the case; ``%``, ``_`` and the escape are literal."""
    if not patterns:
        return chunks.limit(0)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.ilike(F.col(text), F.lit(f"%{like_escape(p)}%"), F.lit("!"))
    return chunks.where(hit)


def keyword_scored(chunks: DataFrame, patterns: list[str], query: list[float], title: str, vector: str = "embedding") -> DataFrame:
    """Keyword hits of one document with their similarity to the query, in document order, without a limit."""
    found = keyword_hits(chunks.where(F.col("doc_title") == title), patterns)
    return found.withColumn("score", cosine(vector, F.array(*[F.lit(float(x)) for x in query]))).drop(vector).orderBy("chunk_index")


def union_hits(*legs: DataFrame) -> DataFrame:
    """UNION ALL of result lists, with ``leg`` to tell them apart in later ties."""
    out = None
    for k, leg in enumerate(legs):
        leg = leg.withColumn("leg", F.lit(k))
        out = leg if out is None else out.unionByName(leg)
    return out


def best_by_key(hits: DataFrame, keys: list[str], ties: list[str | Column], score: str = "score") -> DataFrame:
    """One row for each key: that of the highest score, then the first by ``ties``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def score_floor(hits: DataFrame, least: float = 0.30, score: str = "score") -> DataFrame:
    return hits.where(F.col(score) >= least)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int, text: str = "chunk_text", id_col: str = "chunk_id") -> DataFrame:
    """Hits of raw queries and their rewrites: search each, keep the best of equal texts, cut to ``k``.

    ``queries``: ``request`` (groups a query with its rewrites), ``list_no`` (0: raw), ``qid``, ``qvec``.
    """
    hits = batch_top_k(queries, chunks, k, id_col).join(queries.select("qid", "request", "list_no"), "qid")
    hits = hits.join(chunks.select(F.col(id_col).alias("id"), text), "id")
    best = best_by_key(hits, ["request", text], ["list_no", "rank", "id"])
    order = Window.partitionBy("request").orderBy(F.desc("score"), "list_no", "rank", "id")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
