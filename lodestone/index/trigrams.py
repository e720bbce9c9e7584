"""Substring search by an index of runs of three characters.

Rows fall to blocks of 64. For each run of three lower-cased characters and each block the index
holds one number whose bits tell which rows of the block have that run. A pattern's runs meet the
index by a join, a bitwise *and* over them leaves the rows that hold all of them, and the texts of
these alone are read and looked through. Texts lie in folders by block, so folders without a
candidate are not read.

The rows found are those that ``ILIKE '%pattern%'`` finds, with every sign of the pattern taken
literally. Patterns of fewer than three characters have no runs: for these all texts are looked
through, in one scan for up to ``SHORT_PATTERNS`` of them. Null texts hold nothing, the empty pattern is in every text
that isn't null, null patterns find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.index.shared import Steps, Tables, bucket_of, if_few

#: Folders that the texts lie in, and blocks of a bucket that one task writes.
PARTS, SLICE_BLOCKS = 64, 4096
SHORT_PATTERNS = 1000
#: Characters of a text that are cut into runs at a time.
STRIP = 1 << 20
#: Runs of texts that a task has in memory before it gives what they come to.
HELD_RUNS = 1 << 18


class Trigrams(Tables):
    """An index in a folder: ``texts`` (part, block, slot, id, text) and ``runs`` (bucket, run, block, rows)."""

    @property
    def texts(self) -> DataFrame:
        return self.read("texts")

    @property
    def runs(self) -> DataFrame:
        return self.read("runs")


def runs_of(text: str) -> np.ndarray:
    """The distinct runs of three characters of a text, as numbers of 63 bits."""
    out = []
    for start in range(0, max(len(text) - 2, 0), STRIP):
        points = np.frombuffer(text[start : start + STRIP + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out.append(np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _merged_rows(places: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    place = np.repeat(np.array(places, dtype=np.int64), [len(f) for f in found])
    run, block, bit = np.concatenate(found), place >> 6, np.int64(1) << (place & 63)
    order = np.lexsort((block, run))
    run, block, bit = run[order], block[order], bit[order]
    new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (block[1:] != block[:-1])]))
    return pa.RecordBatch.from_arrays([pa.array(run[new]), pa.array(block[new]), pa.array(np.bitwise_or.reduceat(bit, new))], names=["run", "block", "rows"])


def _rows_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, block, rows: one number for each run and block of some texts of a batch of (place, lower-cased text)."""
    for batch in batches:
        places, found, held = [], [], 0
        for n in range(batch.num_rows):
            runs = runs_of(batch.column(1)[n].as_py())
            if len(runs):
                places.append(batch.column(0)[n].as_py())
                found.append(runs)
                held += len(runs)
            if held >= HELD_RUNS:
                yield _merged_rows(places, found)
                places, found, held = [], [], 0
        if held:
            yield _merged_rows(places, found)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> Trigrams:
    """Write texts by blocks and the runs that they hold below ``path``."""
    spark = docs.sparkSession
    steps = Steps(spark, "trigrams")
    # numbers of rows are given once and written, as a task that runs again may see other rows
    placed = steps.keep(docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("place", F.monotonically_increasing_id()), "placed")
    block = F.shiftright("place", 6)
    texts = placed.select(F.pmod(F.xxhash64(block), F.lit(PARTS)).cast("int").alias("part"), block.alias("block"), F.col("place").bitwiseAND(63).cast("int").alias("slot"), "id", "text")
    index = Trigrams(spark, path)
    index.write("texts", texts.repartition("part", F.floor(F.col("block") / SLICE_BLOCKS)).sortWithinPartitions("part", "block", "slot"), "part")
    runs = placed.select("place", F.lower("text").alias("text")).mapInArrow(_rows_of_runs, "run long, block long, rows long")
    runs = runs.groupBy("run", "block").agg(F.bit_or("rows").alias("rows")).withColumn("bucket", bucket_of("run"))
    index.write("runs", runs.repartition("bucket", F.floor(F.col("block") / SLICE_BLOCKS)).sortWithinPartitions("bucket", "run", "block"), "bucket")
    return index


def _pattern_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [runs_of(t) for t in batch.column(1).to_pylist()]
        sizes = np.array([len(f) for f in found])
        columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes)))]
        values = np.concatenate(found) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(values), pa.array(np.repeat(sizes, sizes).astype(np.int32))], names=["pid", "run", "n"])


def candidates(index: Trigrams, patterns: DataFrame) -> DataFrame:
    """pid, block, part and the rows of the block that hold every run of a pattern (``pid``, lower-cased ``pattern``)."""
    kind = patterns.schema["pid"].dataType.simpleString()
    asked = patterns.select("pid", "pattern").mapInArrow(_pattern_runs, f"pid {kind}, run long, n int").withColumn("bucket", bucket_of("run"))
    met = index.runs.join(if_few(asked), ["run", "bucket"]).groupBy("pid", "block").agg(F.count("*").alias("met"), F.max("n").alias("n"), F.bit_and("rows").alias("rows"))
    return met.where("met = n AND rows <> 0").select("pid", "block", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int").alias("part"), "rows")


def holding(index: Trigrams, patterns: DataFrame) -> DataFrame:
    """``pid`` and ``id`` of every row that holds a pattern of ``patterns`` (``pid``, ``pattern``), whatever the case."""
    steps = Steps(index.spark, "substrings")
    lowered = steps.keep(patterns.where("pattern IS NOT NULL").select("pid", F.lower("pattern").alias("pattern")), "patterns")
    long, short = lowered.where(F.length("pattern") >= 3), lowered.where(F.length("pattern") < 3)
    found = steps.keep(candidates(index, long).join(if_few(long), "pid"), "candidates")
    read = index.texts.join(if_few(found), ["part", "block"])
    has = lambda p: F.contains(F.lower("text"), p)
    # the bit is looked at before the text is
    hit = F.when(F.expr("shiftrightunsigned(rows, slot) & 1L") == 1, has(F.col("pattern"))).otherwise(F.lit(False))
    out = read.where(hit).select("pid", "id")
    listed = short.limit(SHORT_PATTERNS + 1).collect()
    if len(listed) > SHORT_PATTERNS:
        raise ValueError(f"more than {SHORT_PATTERNS} patterns of fewer than three characters")
    if listed:
        kind = patterns.schema["pid"].dataType.simpleString()

        def tried(p) -> Column:
            return F.when(has(F.lit(p.pattern)), F.lit(p.pid).cast(kind))

        scanned = index.texts.select("id", F.explode(F.array_compact(F.array(*map(tried, listed)))).alias("pid"))
        out = out.unionByName(scanned)
    return out


def holding_any(index: Trigrams, patterns: list[str]) -> DataFrame:
    """``id`` of the rows that hold one of the patterns at least."""
    asked = index.spark.createDataFrame(list(enumerate(patterns)), "pid int, pattern string")
    return holding(index, asked).select("id").distinct()
