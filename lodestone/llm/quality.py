"""Quality classification by document evidence and hierarchical empirical Bayes.

A logistic classifier on byte statistics gives every document the probability that it is
good. Sites then pool that evidence: a path's rate of good documents is shrunk towards its
host's and a host's towards the global rate, with the strength that the spread between
hosts (or between the paths of a host) bears out by the method of moments. The posterior
of a document is its own evidence with the site's rate in place of the global rate as
prior.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, those of the smallest
hash values; counts and rates cover all documents. Null texts count as empty, null hosts
and paths are sites of their own.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Scratch, small_batches, table

#: Bound of the labelled sample that the classifier is fitted on.
TRAIN_ROWS = 8_000
#: Bounds of the strength of shrinkage, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1_000.0
#: Sites that are broadcast at most.
BROADCAST_SITES = 100_000
#: How far a site may move a document, in log odds.
SITE_WEIGHT = 0.5

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in " \t"]] = 4
_CLASS[[ord(c) for c in "\n\r"]] = 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6
_CLASS[[ord(c) for c in "!"]] = 7
_CLASS[[ord(c) for c in "#$%&*@^~+=<>"]] = 8
_CLASS[[ord(c) for c in "|\\/_{}[]`"]] = 9
_CLASS[128:] = 1
FEATURES = 15
#: Shares of the byte classes in plain prose, counted as ``PRIOR_BYTES`` bytes more so that a few words decide little.
_PROSE = np.array([0.0, 0.79, 0.02, 0.0, 0.15, 0.01, 0.03, 0.0, 0.0, 0.0])
PRIOR_BYTES = 40


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes, and how words and lines are made and repeated."""
    raw = (text or "").encode()
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10)[:10]
    share = (count + PRIOR_BYTES * _PROSE) / (len(raw) + PRIOR_BYTES)
    lines, words = raw.split(b"\n"), raw.split()
    repeated_lines = (len(lines) - len(set(lines))) / (len(lines) + 2)
    repeated_words = sum(map(operator.eq, words, words[1:])) / (len(words) + 5)
    width = min((len(raw) + PRIOR_BYTES) / (len(words) + 7), 40) / 10
    odd = share[7] + share[8] + share[9]
    return np.concatenate([np.sqrt(share), [np.log1p(len(words)) / 10, width, repeated_lines, np.sqrt(repeated_words), np.sqrt(odd)]])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Logistic weights (bias last) by Newton's method with a small ridge; zeros without rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(FEATURES + 1)
    ridge = np.eye(FEATURES + 1) * 0.05
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, those whose ids hash lowest."""
    chosen = labels.where("quality IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: ``rows`` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = found.mapInArrow(run, "id long, y double, x array<double>").orderBy("id").collect()
    return np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([r.y for r in got])


def document_evidence(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "p_doc") -> DataFrame:
    """Add the classifier's probability; one narrow pass, whole texts."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            x = np.array([np.append(features(t.as_py()), 1.0) for t in column]).reshape(-1, FEATURES + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def _strength(rate: Column, var: Column, n: Column) -> Column:
    """Strength of a beta prior with mean ``rate`` whose spread is ``var`` less what sampling explains."""
    between = F.greatest(var - rate * (1 - rate) / F.greatest(n, F.lit(1.0)), F.lit(1e-9))
    return F.least(F.greatest(rate * (1 - rate) / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def site_posteriors(evidence: DataFrame, host: str, path: str, p: str = "p_doc") -> DataFrame:
    """``host``, ``path``, ``p_global``, ``p_host``, ``p_path``, ``n_host``, ``n_path``.

    Grouped sums only, combined before each shuffle; a host's documents never meet in one task.
    """
    paths = evidence.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.sum(p).alias("s"), F.count(p).cast("double").alias("n_path"))
    hosts = paths.groupBy("host").agg(
        F.sum("s").alias("s_host"),
        F.sum("n_path").alias("n_host"),
        F.coalesce(F.var_pop(F.col("s") / F.col("n_path")), F.lit(0.0)).alias("var_paths"),
        F.avg("n_path").alias("n_mean"),
    )
    whole = hosts.agg(
        (F.sum("s_host") / F.sum("n_host")).alias("p_global"),
        F.coalesce(F.var_pop(F.col("s_host") / F.col("n_host")), F.lit(0.0)).alias("var_hosts"),
        F.avg("n_host").alias("hosts_mean"),
    )
    m = _strength(F.col("p_global"), F.col("var_hosts"), F.col("hosts_mean"))
    hosts = (
        hosts.crossJoin(F.broadcast(whole))  # one row
        .withColumn("p_host", (F.col("s_host") + m * F.col("p_global")) / (F.col("n_host") + m))
        .withColumnRenamed("host", "_h")
    )
    k = _strength(F.col("p_host"), F.col("var_paths"), F.col("n_mean"))
    return (
        paths.join(hosts, F.col("host").eqNullSafe(F.col("_h")))
        .withColumn("p_path", (F.col("s") + k * F.col("p_host")) / (F.col("n_path") + k))
        .select("host", "path", "p_global", "p_host", "p_path", "n_host", "n_path")
    )


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", train_rows: int = TRAIN_ROWS, keep_text: bool = True) -> DataFrame:
    """Add ``p_doc``, ``p_host``, ``p_path``, ``score`` (posterior) and ``keep`` (score >= 0.5) to every row.

    Without ``keep_text`` the column ``text`` is left out of the result, and texts are read once:
    the evidence is written beside the other columns. Else they are read twice, as writing them costs more.
    Rows without a text, host or path count as said above; rows that repeat are rows of their own;
    without rows the result has none; columns of the five names are replaced.
    """
    docs = docs.drop("p_doc", "p_host", "p_path", "score", "keep")
    scratch = Scratch(docs.sparkSession, "sites")
    weights = fit(*training_rows(docs, labels, train_rows))
    scored = document_evidence(docs, weights)
    if keep_text:
        sites = site_posteriors(document_evidence(docs.select(host, path, "text"), weights), host, path)
    else:
        scored = scratch.settle(scored.drop("text"), "evidence")
        sites = site_posteriors(scored.select(host, path, "p_doc"), host, path)
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "p_global", "p_host", "p_path")
    sites = scratch.settle(sites, "sites")
    if sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)  # else the rows are shuffled by site

    def odds(c: str) -> Column:
        held = F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(held / (1 - held))

    logit = odds("p_doc") + SITE_WEIGHT * (odds("p_path") - odds("p_global"))
    return (
        scored.join(sites, scored[host].eqNullSafe(F.col("_host")) & scored[path].eqNullSafe(F.col("_path")), "left")
        .withColumn("score", 1 / (1 + F.exp(-logit)))
        .withColumn("keep", F.col("score") >= 0.5)
        .drop("_host", "_path", "p_global")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, score, keep for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_doc", "p_host", "p_path", "score")], "keep")
