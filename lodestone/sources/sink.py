"""Chunk tables, evaluation output and stages that are not done twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.versions import VersionedTable

CHUNK_SCHEMA = "id string, chunk_text string, chunk_tokens int, doc_title string, doc_url string, doc_section string, chunk_index int, embedding array<float>"


def create_chunk_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CHUNK_SCHEMA}) USING parquet")


def chunk_id() -> F.Column:
    """A stable id of a chunk, so that a task that runs again writes the same rows."""
    return F.sha2(F.concat_ws("|", "doc_url", "doc_title", F.col("chunk_index").cast("string"), "chunk_text"), 256)


def chunk_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["id"])


def write_chunks(chunks: DataFrame, path: str, dimension: int, replace: bool = True) -> tuple[int, int]:
    """Write chunks with their vectors as a version of the table at ``path``; rows and tokens written.

    Chunks are worked out once: what has been written is checked and summed up, and only then
    becomes the table that readers see. A missing or misshapen vector leaves it as it was.
    """
    seen: dict[str, int] = {}

    def check(written: DataFrame) -> None:
        bad = F.col("embedding").isNull() | (F.size("embedding") != dimension)
        n, tokens, wrong = written.agg(F.count("*"), F.sum("chunk_tokens"), F.count_if(bad)).first()
        if wrong:
            raise ValueError(f"every chunk needs a vector of {dimension} components")
        seen.update(n=n, tokens=tokens or 0)

    table, rows = chunk_table(chunks.sparkSession, path), chunks.withColumn("id", chunk_id())
    (table.replace if replace else table.append)(rows, check=check)
    return seen["n"], seen["tokens"]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return chunk_table(spark, path).read()


def count_rows(spark: SparkSession, path: str) -> int:
    return read_chunks(spark, path).count()


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_scores(scores: DataFrame, path: str, kind: str = "csv") -> None:
    """Evaluation rows as CSV or JSON, floats to four places."""
    rounded = scores.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes])
    writer = rounded.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)


def once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written only if it isn't complete yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_corpus(docs: DataFrame, qa: DataFrame, path: str) -> None:
    """Evaluation corpora: parsed texts under the name ``contents``, and questions."""
    docs.withColumnRenamed("texts", "contents").write.mode("overwrite").parquet(f"{path}/corpus")
    qa.write.mode("overwrite").parquet(f"{path}/qa")
