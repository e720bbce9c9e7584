"""What the indexes share: checks of size, and tables in a folder."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.places import shared_folder

#: Rows of a side that may be broadcast; beyond it the same join comes by shuffle.
FEW_ROWS = 100_000
#: Files of an index that are told apart by a hash of the key.
BUCKETS = 32


def if_few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucket_of(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


class Tables:
    """The tables of an index in a folder, with their schemas, so that empty ones can be read too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._schemas: dict[str, str] = {}

    def write(self, name: str, df: DataFrame, by: str | None = None) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}-schema")
        self._schemas[name] = schema

    def read(self, name: str) -> DataFrame:
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.text(f"{self.path}/{name}-schema").first().value
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}")


class Steps:
    """Tables that one search writes: each step is worked out once and outlives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_folder(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


@contextlib.contextmanager
def held_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings that hold inside the block only."""
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
