"""Mirrors of changing sources: streams of changes and of whole listings kept as a versioned table.

Each key has one row: the change with the highest sequence number that has been seen, with a hash
of its content. A removal is a change too and leaves a tombstone, so that an older change that comes
later doesn't bring the row back. The last change by (sequence, hash) wins, whichever
order and however often changes come, so replayed and reordered batches end in the same table.
Batches carry their number as the name of the version: a batch that ran before its checkpoint
was written is not done twice. Keys of a table grow with its source, so joins with it come by shuffle
at every size, never through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.versions import BUCKETS, VersionedTable

ORDER = ["seq", "hash"]


def mirror(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    return VersionedTable(spark, path, ["key"], buckets)


def changes(rows: DataFrame, key: str, seq: str, content: list[str], gone: Column | None = None) -> DataFrame:
    """Rows as changes: ``key``, ``seq``, ``hash``, ``gone`` and the content, which is null in tombstones."""
    gone = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    body = F.sha2(F.to_json(F.struct(*[F.col(c) for c in content]), {"ignoreNullFields": "false"}), 256)
    kept = [F.when(~F.col("gone"), F.col(c)).alias(c) for c in content]
    # of a removal and a change with one number the removal wins: its hash comes after all hexadecimal ones
    marked = rows.withColumn("gone", gone).withColumn("hash", F.when(F.col("gone"), "~").otherwise(body))
    return marked.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), "hash", "gone", *kept)


def news(table: VersionedTable, batch: DataFrame) -> DataFrame:
    """The last change of each key in a batch, where the table has none as late."""
    last = batch.groupBy("key").agg(F.max_by(F.struct(*batch.columns), F.struct(*ORDER)).alias("r")).select("r.*")
    if table.version() is not None:
        known = table.read().select(F.col("key").alias("_key"), F.struct("seq", "hash").alias("_last"))
        last = last.join(known.hint("merge"), F.col("key") == F.col("_key"), "left").where(F.col("_last").isNull() | (F.col("_last") < F.struct("seq", "hash"))).drop("_key", "_last")
    return last


def apply(table: VersionedTable, batch: DataFrame, name: str | None = None) -> bool:
    """Apply changes in one version; False if a version of that name is there. Changes that are no news write nothing."""
    if name is not None and name in table.names():
        return False
    table.upsert(news(table, batch), ORDER, name)
    return True


def apply_listing(table: VersionedTable, listing: DataFrame, seq: int, name: str | None = None) -> bool:
    """Apply a whole listing of a source, numbered ``seq``: what it hasn't got is removed, what is in it as before keeps its number."""
    if name is not None and name in table.names():
        return False
    fresh = listing.withColumn("seq", F.lit(seq).cast("long"))
    if table.version() is None:
        return apply(table, fresh, name)
    known = table.read()
    same = known.where("NOT gone").select("key", "hash")
    changed = fresh.join(same.hint("merge"), ["key", "hash"], "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields if f.name not in ("key", "seq", "hash", "gone")]
    vanished = known.where((F.col("seq") < seq) & ~F.col("gone")).join(fresh.select("key").hint("merge"), "key", "left_anti").select("key", F.lit(seq).cast("long").alias("seq"), F.lit("~").alias("hash"), F.lit(True).alias("gone"), *empty)
    return apply(table, changed.select(known.columns).unionByName(vanished.select(known.columns)), name)


def current(table: VersionedTable) -> DataFrame:
    """The rows that are there, without tombstones."""
    return table.read().where("NOT gone").drop("gone")


def follow(stream: DataFrame, table: VersionedTable, checkpoint: str, source: str = "changes"):
    """A stream of ``changes`` into the table: each batch is one version, named by source and number."""
    return stream.writeStream.foreachBatch(lambda batch, number: apply(table, batch, f"{source}/{number}") and None).option("checkpointLocation", checkpoint)
