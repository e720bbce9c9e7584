"""As-of joins: for each point the last mark at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, values: list[str], width: float, ties: list[str] | None = None) -> DataFrame:
    """``points`` with the ``values`` of the last mark of the same ``keys`` whose ``at`` is not later, null before the first.

    Marks and points are put in one order and the last mark is carried on; neither side is
    compared with the other. The line of each key is cut into stretches of ``width``: what the last mark of
    earlier stretches leaves is carried in by a window over stretches, so the stretches of a key that
    holds most rows are dealt to many tasks. Of marks at one place the last by ``ties``, then by
    its values, counts. Null keys are one key; points and marks without a place have no mark
    and are none.
    """
    held = F.struct(*[F.col(v) for v in values])
    order = F.struct(F.col(at).alias("at"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(ties or [])], held.alias("held"))
    stretch = F.floor(F.col(at) / F.lit(width)).alias("_stretch")
    m = marks.where(F.col(at).isNotNull()).select(*keys, stretch, F.col(at).alias("_at"), order.alias("_order"))
    p = points.withColumn("_row", F.struct(*[F.col(c) for c in points.columns])).select(*keys, stretch, F.col(at).alias("_at"), "_row")
    last = m.groupBy(*keys, "_stretch").agg(F.max("_order").alias("_last"))
    # a row for each stretch with a mark or a point
    every = last.unionByName(p.select(*keys, "_stretch", F.lit(None).cast(last.schema["_last"].dataType).alias("_last")).distinct())
    every = every.groupBy(*keys, "_stretch").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_stretch").alias("_s"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))

    lines = m.withColumn("_row", F.lit(None).cast(p.schema["_row"].dataType)).unionByName(p.withColumn("_order", F.lit(None).cast(m.schema["_order"].dataType)))
    here = Window.partitionBy(*keys, "_stretch").orderBy("_at", F.col("_row").isNotNull(), "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = lines.withColumn("_own", F.last("_order", ignorenulls=True).over(here)).where("_row IS NOT NULL")
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    met = found.join(carried, [*same, F.col("_stretch") == F.col("_s")], "left")
    chosen = F.when(F.col("_at").isNotNull(), F.coalesce("_own", "_carried"))
    return met.select("_row.*", *[chosen["held"][v].alias(v) for v in values])
