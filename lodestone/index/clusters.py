"""Exact vector search that skips what cannot hold a result.

Vectors of length 1 lie around centres that are fitted to a bounded sample. A cell holds the
vectors of one centre whose distances from it fall between two bounds, and lies in a folder by its
centre. By the triangle inequality a query at distance ``d`` from the centre is no nearer to any of
them than ``lo - d`` and ``d - hi``, and no farther than ``d + hi``. A query first visits the
nearest cells with enough vectors; the distance of the ``k``-th best found there is a limit, and of
the other cells only those that can be nearer than the limit are visited. The result is that of
comparing each query with every vector, by cosine in double precision.

Queries stay a table: each is sent to the centres whose cells it visits, once with all of them. Cells are cut into parts of
some ``PART_ROWS`` vectors and queries into slices, so neither gathers in one task. Vectors that are null, zero, of another
length or hold null or non-finite components are not found, queries like that find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.index.shared import Steps, Tables, if_few

#: Rows of the sample that centres are fitted to, centres at most, and rounds of fitting.
SAMPLE_ROWS, MOST_CENTRES, ROUNDS = 20_000, 512, 8
#: Width of a cell in distance from its centre: 20 cells a centre at most, so all bounds fit in every task.
WIDTH = 0.1
PART_ROWS, SLICE_QUERIES = 8192, 50_000
#: Distances or scores that a task has in memory at a time, and rows of a batch that it gives.
BLOCK_SCORES, GIVEN_ROWS = 1 << 19, 4096
SLACK = 1e-9


def unit_rows(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch can be searched, and these with length 1 as rows of a matrix."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    valid = np.flatnonzero(lengths == d)
    rows = column.take(pa.array(valid)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(valid), d)
    norm = np.linalg.norm(rows, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return valid[good], rows[good] / norm[good][:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of length 1."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of length 1 for the rows of a sample, at most one a row."""
    n = min(n, len(sample))
    centres = sample[(np.arange(n) * len(sample)) // n].copy()
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        moved = norm > 1e-12
        centres[moved] = sums[moved] / norm[moved][:, None]
    return centres


class Clusters(Tables):
    """An index in a folder: ``vectors`` (centre, cell, part, id, v), ``cells`` (bounds and sizes), ``centres``."""

    @property
    def vectors(self) -> DataFrame:
        return self.read("vectors")

    @property
    def cells(self) -> DataFrame:
        return self.read("cells")

    def centres(self) -> np.ndarray:
        rows = self.read("centres").orderBy("centre").collect()  # MOST_CENTRES at most
        return np.array([r.v for r in rows])


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", centres: int | None = None) -> Clusters:
    """Write the vectors by cells below ``path``. Their length is that of most of a sample."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n = rows.count()
    few = rows if n <= SAMPLE_ROWS else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(SAMPLE_ROWS / n * (1 << 20))))
    sample = few.select("v").limit(2 * SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    lengths = pc.list_value_length(sample).to_numpy(zero_copy_only=False)
    d = int(np.bincount(lengths).argmax()) if len(lengths) else 1
    _, unit = unit_rows(sample, d)
    wanted = centres or max(1, min(MOST_CENTRES, round(np.sqrt(n))))
    middle = fitted(unit, wanted) if len(unit) else np.eye(1, d)
    shared = spark.sparkContext.broadcast(middle)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, own = unit_rows(batch.column(1), d)
            cosine = own @ shared.value.T
            near = cosine.argmax(axis=1) if len(own) else np.zeros(0, np.int64)
            apart = np.sqrt(np.maximum(2.0 - 2.0 * cosine[np.arange(len(own)), near], 0.0))
            columns = [pa.array(near.astype(np.int32)), pa.array((apart / WIDTH).astype(np.int32)), pa.array(apart), batch.column(0).take(pa.array(valid)), batch.column(1).take(pa.array(valid))]
            yield pa.RecordBatch.from_arrays(columns, names=["centre", "cell", "apart", "id", "v"])

    steps = Steps(spark, "clusters")
    found = steps.keep(rows.mapInArrow(placed, "centre int, cell int, apart double, id long, v array<double>"), "placed")
    cells = found.groupBy("centre", "cell").agg(F.min("apart").alias("lo"), F.max("apart").alias("hi"), F.count("*").alias("n"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    index = Clusters(spark, path)
    index.write("cells", cells.coalesce(1))
    out = found.join(F.broadcast(index.cells.select("centre", "cell", "parts")), ["centre", "cell"])  # 21 cells a centre at most
    out = out.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("centre", "cell", "part", "id", "v")
    index.write("vectors", out.repartition("centre", "cell", "part").sortWithinPartitions("centre", "cell", "part"), "centre")
    index.write("centres", spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(middle)], "centre int, v array<double>").coalesce(1))
    return index


class Bounds:
    """Of each query the bounds of its distance to the vectors of each cell."""

    def __init__(self, centres: np.ndarray, cells: list):
        self.centres = centres
        self.centre, self.cell, self.n = (np.array([c[k] for c in cells], dtype=np.int64) for k in ("centre", "cell", "n"))
        self.lo, self.hi = (np.array([c[k] for c in cells]) for k in ("lo", "hi"))

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most distance, queries by cells."""
        d = distances(queries, self.centres)[:, self.centre]
        return np.maximum(np.maximum(self.lo - d, d - self.hi), 0.0), np.minimum(d + self.hi, 2.0)

    def first(self, most: np.ndarray, k: int) -> np.ndarray:
        """The cells that hold ``k + 1`` vectors sooner than others do, by the most distance."""
        order = np.argsort(most, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(most.shape, dtype=bool)
        np.put_along_axis(out, order, before < k + 1, axis=1)
        return out


def _visited(bounds: Bounds, k: int, d: int, limits: bool):
    """What ``_visits`` does to batches; only a bounded number of queries by cells is looked at at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_SCORES // max(1, len(bounds.cell)))
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            valid, own = unit_rows(batch.column(1), d)
            if not len(own):
                continue
            least, most = bounds.of(own)
            chosen = bounds.first(most, k)
            if limits:
                limit = batch.column(2).to_numpy(zero_copy_only=False)[valid]
                chosen = (least <= limit[:, None] + SLACK) & ~chosen
            q, c = np.nonzero(chosen)  # by query, then as cells are ordered
            centre, cell = bounds.centre[c], bounds.cell[c]
            new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (centre[1:] != centre[:-1])])) if len(q) else q
            ends = np.append(new, len(q))
            for start in range(0, len(new), GIVEN_ROWS):
                at, cut = new[start : start + GIVEN_ROWS], ends[start : start + GIVEN_ROWS + 1]
                cells = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(cell[cut[0] : cut[-1]].astype(np.int32)))
                rows = pa.array(valid[q[at]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(centre[at].astype(np.int32)), cells], names=["qid", "q", "centre", "cells"])

    return run


def _visits(index: Clusters, queries: DataFrame, k: int, d: int, bounds: Bounds, limits: bool) -> DataFrame:
    """qid, v, centre and its cells that a query visits: at first, or within ``limit`` and not at first."""
    shared = index.spark.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _visited(shared.value, k, d, limits)(batches)

    return queries.mapInArrow(run, "qid long, q array<double>, centre int, cells array<int>")


def _scored(index: Clusters, visits: DataFrame, k: int, d: int, slices: int) -> DataFrame:
    """qid, id, score of the best ``k`` of each part of a cell that a query visits, itself left out."""
    parts = index.cells.groupBy("centre").agg(F.max("parts").alias("parts")).select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = visits.join(if_few(parts), "centre").withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int"))
    wanted = asked.select("centre", "part", "slice").distinct()
    held = index.vectors.join(if_few(wanted), ["centre", "part"]).select(*[F.col(c).alias(c) for c in ("centre", "part", "slice", "cell", "id", "v")])  # columns of its own
    keys = ["centre", "part", "slice"]

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            _, rows = unit_rows(right.column("v").combine_chunks(), d)
            _, queries = unit_rows(left.column("q").combine_chunks(), d)
            ids, cell, qids = right.column("id").to_numpy(), right.column("cell").to_numpy(), left.column("qid").to_numpy()
            lists = left.column("cells").combine_chunks()
            cells, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            for c in np.unique(cell):
                here, asking = np.flatnonzero(cell == c), who[cells == c]
                own, near = ids[here], rows[here]
                keep, step = min(k, len(own)), max(1, BLOCK_SCORES // len(own))
                for start in range(0, len(asking), step):
                    at = asking[start : start + step]
                    score = queries[at] @ near.T
                    score[qids[at][:, None] == own[None, :]] = -np.inf
                    kth = np.partition(score, len(own) - keep, axis=1)[:, len(own) - keep]
                    a, b = np.nonzero((score >= kth[:, None] - SLACK) & np.isfinite(score))  # ties at the edge are kept for the final ranking
                    out.append((qids[at][a], own[b], score[a, b]))
        qid, i, s = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, t) for n, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"qid": pa.array(qid), "id": pa.array(i), "score": pa.array(s)})

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(compared, "qid long, id long, score double")


def _ranked(scored: DataFrame, k: int, digits: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Search:
    """Results, and what the search has visited: qid, centre, cell."""

    results: DataFrame
    visited: DataFrame


def search(index: Clusters, queries: DataFrame, k: int, digits: int = 9) -> Search:
    """``qid``, ``id``, ``score``, ``rank`` of the ``k`` best vectors for each query (``qid``, ``qvec``), itself left out; equal scores (to ``digits``) rank by id."""
    steps, centres = Steps(index.spark, "nearest"), index.centres()
    bounds, d = Bounds(centres, index.cells.orderBy("centre", "cell").collect()), centres.shape[1]  # 21 cells a centre at most
    asked = steps.keep(queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("q")).where("q IS NOT NULL"), "asked")
    slices = max(1, -(-asked.count() // SLICE_QUERIES))
    first = steps.keep(_visits(index, asked, k, d, bounds, False), "first")
    seen = steps.keep(_scored(index, first, k, d, slices), "seen")
    # the k-th best so far, as a distance; queries with fewer have no limit
    kth = _ranked(seen, k, digits).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    limit = F.when(F.coalesce("n", F.lit(0)) < k, 2.0).otherwise(F.sqrt(F.greatest(2.0 - 2.0 * (F.col("score") - SLACK), F.lit(0.0))))
    limited = steps.keep(asked.join(kth, "qid", "left").select("qid", "q", limit.alias("limit")), "limited")
    rest = steps.keep(_visits(index, limited, k, d, bounds, True), "rest")
    found = seen.unionByName(_scored(index, rest, k, d, slices))
    visited = first.unionByName(rest).select("qid", "centre", F.explode("cells").alias("cell"))
    return Search(_ranked(found, k, digits), visited)


def share_read(index: Clusters, found: Search, n_queries: int) -> float:
    """Share of all pairs of query and vector that a search has compared."""
    sizes = index.cells.select("centre", "cell", "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    read = found.visited.join(sizes, ["centre", "cell"]).agg(F.sum("n")).first()[0] or 0
    return read / max(total * n_queries, 1)
