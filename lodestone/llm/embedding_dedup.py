"""Near-duplicate embeddings: iterative quantisation and multi-index Hamming tables.

Rotations learnt on a bounded sample turn vectors into balanced binary codes (the rotation
and the codes are fitted to each other in turn). The code is cut into substrings, each the
key of a table; vectors that share a key in some table are compared on their whole codes
and, where these are near enough, on the original vectors. Key length follows the number
of vectors, and there are so many tables that a pair at the limit shares a key in one of
them with probability ``RECALL``.

A large group of near copies is not compared pair by pair. Every vector joins the ball
around the first vector that it meets within half the limit's angle: members of a ball are
all linked with each other, as angles obey the triangle inequality, and are counted, not
listed. Small balls are dissolved. Only balls that are near each other without all their members being linked have
their members compared.

Equal vectors are one vector with a weight. Vectors that are null, zero, or that hold
null or non-finite components are linked with nothing; the others are searched by length.
Rows that repeat an id and its vector link with each other; rows without an id are
linked as rows with an id of the same vector are, with nothing if there are none of these; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import NUMBER_ROWS, Scratch, components, let, table

LIMIT = 0.9
RECALL = 0.997
#: Bound of the sample that rotations are learnt on.
SAMPLE_ROWS = 10_000
KEY_SPARE = 4  #: keys are so many bits shorter than the number of vectors is long
LEAST_KEY, MOST_KEY = 6, 32
ROUNDS = 25
MARGIN = 1e-9
LEAST_BALL = 32  #: vectors; the members of smaller balls stand alone, as their few pairs cost less than a radius


def rotations(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` orthogonal matrices, each fitted to the signs that it gives."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS if len(sample) else 0):
            z = sample @ r
            u, _, vt = np.linalg.svd(sample.T @ np.where(z >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return np.array(out)


class Codes:
    """Tables and their keys for so many vectors of ``d`` components."""

    def __init__(self, n: int, d: int, limit: float):
        self.key_bits = min(max(math.ceil(math.log2(max(n, 2))) - KEY_SPARE, LEAST_KEY), MOST_KEY, d)
        agree = (1 - math.acos(limit) / math.pi) ** self.key_bits
        self.tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree))
        self.per_rotation = d // self.key_bits
        self.count = -(-self.tables // self.per_rotation)
        self.bits = self.tables * self.key_bits
        self.words = -(-self.bits // 64)

    def reach(self, degrees: Column) -> Column:
        """Hamming distance that codes so far apart stay within: five deviations above the mean."""
        p = F.least(degrees / 180, F.lit(0.5))
        return p * self.bits + 5 * F.sqrt(p * (1 - p) * self.bits) + 8

    def encode(self, unit: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (a column for each table) and whole codes, packed."""
        bits = np.concatenate([(unit @ m >= 0)[:, : self.per_rotation * self.key_bits] for m in r], axis=1)[:, : self.bits]
        weights = 1 << np.arange(self.key_bits)
        keys = bits.reshape(len(unit), self.tables, self.key_bits) @ weights
        padded = np.zeros((len(unit), self.words * 64), dtype=np.uint8)
        padded[:, : self.bits] = bits
        return keys.astype(np.int32), np.packbits(padded, axis=1).view(np.int64)


def _coded(codes: Codes, r: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                keys, whole = codes.encode(unit, r)
                as_lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(keys), as_lists(whole)], names=["id", "keys", "code"])

    return run


def dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def unit(v: Column) -> Column:
    """A vector of length one; scaled first so that squares neither vanish nor overflow."""
    scaled = lambda most: F.transform(v, lambda x: x / most)
    return let(F.array_max(F.transform(v, F.abs)), lambda most: let(scaled(most), lambda u: let(F.sqrt(dot(u, u)), lambda norm: F.transform(u, lambda x: x / norm))))


def _degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def _hamming(x: str, y: str, words: int) -> Column:
    return sum((F.bit_count(F.col(x)[j].bitwiseXOR(F.col(y)[j])) for j in range(1, words)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def near_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", limit: float = LIMIT) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("row"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v")))
    lengths = [r.d for r in rows.where("v IS NOT NULL").select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    out = reduce(DataFrame.unionAll, [linked_vectors(rows.where(F.size("v") == d), d, limit) for d in lengths or [1]])
    # rows without a vector meet nothing and don't travel
    found = rows.where("v IS NOT NULL").join(out, "v", "left").select("row", "n_links", "component_id")
    found = found.unionAll(rows.where("v IS NULL").select("row", F.lit(None).cast("long"), F.lit(None).cast("long")))
    return found.select(
        F.col("row").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "row").alias("component_id"),
        (F.coalesce("component_id", "row") == F.col("row")).alias("kept"),
    )


def linked_vectors(rows: DataFrame, d: int, limit: float) -> DataFrame:
    """``v``, ``n_links``, ``component_id`` of the distinct vectors of ``rows``, which are all of length ``d``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    half = math.acos(limit) / 2
    wide = math.degrees(2 * half)
    kinds = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("row").alias("id"), F.count("*").alias("weight"))
    kinds = scratch.settle(kinds.select("id", "weight", "v", unit(F.col("v")).alias("unit")), "kinds")
    units = kinds.select("id", "unit")
    n = kinds.count()
    sample = [r.unit for r in units.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).collect()]
    codes = Codes(n, d, limit)
    r = rotations(np.array(sample).reshape(len(sample), d), codes.count)
    coded = scratch.settle(units.mapInArrow(_coded(codes, r), "id long, keys array<int>, code array<bigint>"), "codes", NUMBER_ROWS)
    entries = coded.select("id", "code", F.posexplode("keys").alias("t", "key"))

    # balls: around the first vector of a bucket, for those within half the angle of it
    centres = entries.groupBy("t", "key").agg(F.min(F.struct("id", "code")).alias("c"), F.count("*").alias("n")).where("n > 1")
    centres = centres.select("t", "key", F.col("c.id").alias("centre"), F.col("c.code").alias("c_code"))
    close = entries.join(centres, ["t", "key"]).where((F.col("id") != F.col("centre")) & (_hamming("code", "c_code", codes.words) <= codes.reach(F.lit(math.degrees(half)))))
    close = close.select("id", "centre").distinct()
    measured = close.join(units, "id").join(units.select(F.col("id").alias("centre"), F.col("unit").alias("c_unit")), "centre").withColumn("cosine", dot("unit", "c_unit"))
    joined = measured.where(F.col("cosine") >= math.cos(half) + MARGIN).groupBy("id").agg(F.min(F.struct("centre", "cosine")).alias("b"))
    joined = joined.select("id", "b.centre", "b.cosine")
    joined = scratch.settle(joined, "joined")
    large = scratch.settle(joined.groupBy("centre").count().where(F.col("count") >= LEAST_BALL).select("centre"), "large")
    balls = kinds.select("id", "weight").join(joined.join(large, "centre"), "id", "left")
    balls = balls.select("id", "weight", F.coalesce("centre", "id").alias("ball"), F.when(F.col("cosine").isNotNull(), _degrees(F.col("cosine"))).otherwise(F.lit(0.0)).alias("off"))
    balls = scratch.settle(balls, "balls")
    sizes = balls.groupBy("ball").agg(F.sum("weight").alias("ball_weight"), F.max("off").alias("radius"), F.min("id").alias("least"))

    # balls that meet: all linked, none linked, or to be compared member by member
    around = coded.select(F.col("id").alias("ball"), "code").join(sizes.select("ball", "radius"), "ball")
    met = entries.select("t", "key", "id").join(balls.select("id", "ball"), "id").select("t", "key", "ball").distinct().join(around, "ball")
    a, b = met.toDF("a", "t", "key", "a_code", "a_radius"), met.toDF("b", "t", "key", "b_code", "b_radius")
    near = _hamming("a_code", "b_code", codes.words) <= codes.reach(F.lit(wide) + F.col("a_radius") + F.col("b_radius"))
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b", "a_radius", "b_radius").distinct()
    pairs = pairs.join(units.toDF("a", "ua"), "a").join(units.toDF("b", "ub"), "b").withColumn("apart", _degrees(dot("ua", "ub")))
    spread = F.col("a_radius") + F.col("b_radius")
    pairs = pairs.where(F.col("apart") <= wide + spread + 1e-6).select("a", "b", (F.col("apart") + spread <= wide - 1e-6).alias("every"))
    pairs = scratch.settle(pairs, "pairs")
    both = pairs.where("every").select(F.explode(F.array(F.struct(F.col("a").alias("ball"), F.col("b").alias("other")), F.struct(F.col("b").alias("ball"), F.col("a").alias("other")))).alias("p")).select("p.*")
    counted = both.join(sizes.select(F.col("ball").alias("other"), "ball_weight"), "other").groupBy("ball").agg(F.sum("ball_weight").alias("more"))
    members = balls.select("id", "weight", "ball").join(units, "id")
    left = pairs.where("NOT every").join(members.toDF("a_id", "a_weight", "a", "a_unit"), "a")
    links = left.join(members.toDF("b_id", "b_weight", "b", "b_unit"), "b").where(dot("a_unit", "b_unit") >= limit).select("a", "b", "a_id", "b_id", "a_weight", "b_weight")
    links = scratch.settle(links, "links")
    single = links.select(F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("b_weight").alias("w")), F.struct(F.col("b_id").alias("id"), F.col("a_weight").alias("w")))).alias("p"))
    single = single.groupBy("p.id").agg(F.sum("p.w").alias("single"))
    linked = components(scratch, links.select("a", "b").distinct().unionAll(pairs.where("every").select("a", "b")))
    named = sizes.join(linked.withColumnRenamed("id", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_ball = scratch.settle(named.join(least, "component").select("ball", "ball_weight", "component_id").join(counted, "ball", "left"), "of_ball")
    out = balls.join(of_ball, "ball").join(single, "id", "left")
    out = out.select("id", (F.col("ball_weight") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("n_links"), "component_id")
    return scratch.settle(out.join(kinds.select("id", "v"), "id").select("v", "n_links", "component_id"), "out")


def op10_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``."""
    return near_links(table(spark, sf_dir, "embeddings"))
