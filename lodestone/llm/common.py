"""What the corpus operators share: reading tables, cutting lineage, graph components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
AUTO_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of an Arrow batch: texts have no bound on length, so few of them; more of rows that are a few numbers each. And its bytes.
BATCH_ROWS, NUMBER_ROWS, BATCH_BYTES = 500, 4000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few hundred rows, and to some bytes, from now on: for results over whole texts that are run after the call that returns them."""
    spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a folder of our own: of this machine if all runs in one process on it, else in the warehouse."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        found = tempfile.mkdtemp(prefix="lodestone-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lodestone"
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors. They go when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def settle(self, df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
        """Write ``df`` as table ``name``, free the shuffle files behind it and read it back.

        Only sides that are marked for it are broadcast, so that plans are alike at every size.
        Arrow batches hold ``rows`` rows meanwhile, and ``BATCH_BYTES`` bytes or one row.
        """
        with held_conf(self.spark, {CLEANUP: "true", AUTO_BROADCAST: "-1", ARROW_ROWS: str(rows), ARROW_BYTES: str(BATCH_BYTES)}):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        gc.collect()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            fs, path = self._at(self.path(name))
            fs.delete(path, True)


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: ``a``, ``b`` (long), undirected, self-loops and repeats allowed.
    Returns ``id``, ``component`` (the smallest id of the component) for every id
    in an edge with another id. Each step is linear in the edges and the number
    of steps grows with the logarithm of the diameter.
    """
    edges = scratch.settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0"
    )
    turn, print_before = 0, None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # settled, so that the rows of a hub can be split between tasks in the join
        least = scratch.settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}_least_{turn}")
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        turn += 1
        edges = scratch.settle(small, f"{name}_{turn}")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == print_before:
            break
        print_before = tuple(mark)
        scratch.drop(f"{name}_{turn - 1}", f"{name}_least_{turn - 1}")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of a batch as numpy arrays; lists of one length become rows of a matrix."""
    out = []
    for column in batch.columns:
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))
        else:
            out.append(column.to_numpy(zero_copy_only=False))
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The groups of rows that agree in the first ``keys`` columns, of a partition sorted by these."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns_of(batch)
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        changed = np.zeros(len(now[0]) - 1, dtype=bool)
        for column in now[:keys]:
            changed |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield [c[start:end] for c in now]
        held = [c[cuts[-1] :] for c in now]
    if held is not None:
        yield held


#: A key of so many rows in one batch of texts is hot.
HOT_ROWS = 16
#: Tasks that the rows of a hot key are dealt to.
SALTS = 64


def hot_rows(keys: np.ndarray, docs: np.ndarray, stay: int, least_docs: int = 2) -> np.ndarray:
    """Which rows of a batch go to tasks of their own: those of hot keys, but for one row of each of ``stay`` documents.

    With ``least_docs`` 1 a key may be hot by one document, and ``stay`` rows stay whatever their documents.
    """
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) < HOT_ROWS:
        return out
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_doc = new_key | np.concatenate([[True], d[1:] != d[:-1]])
    count = np.cumsum(new_doc)
    starts = np.flatnonzero(new_key)
    group = np.cumsum(new_key) - 1
    rank = count - count[starts][group]
    ends = np.append(starts[1:], len(k)) - 1
    hot = (ends - starts + 1 >= HOT_ROWS) & (rank[ends] + 1 >= least_docs)
    stays = new_doc & (rank < stay) if least_docs > 1 else np.arange(len(k)) - starts[group] < stay
    out[order] = hot[group] & ~stays
    return out


def salts(hot: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """0 for rows that stay with their key, else one of ``SALTS`` numbers that the document decides."""
    return np.where(hot, 1 + (mixed(docs.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), 0).astype(np.int32)


def dealt(run, shown: list[str]):
    """``run`` over the rows without a salt; those with one go out as they are, with the columns ``shown``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart: list[pa.RecordBatch] = []

        def together() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                salted = pc.greater(batch.column("salt"), 0)
                part = batch.filter(salted)
                apart.append(pa.RecordBatch.from_arrays([part.column(n) for n in shown], names=shown))  # without what its schema says of nulls
                yield batch.filter(pc.invert(salted)).select([n for n in batch.schema.names if n != "salt"])

        for out in run(together()):
            yield out
            yield from apart
            apart.clear()
        yield from apart

    return go


def ids_repeat(texts: DataFrame) -> bool:
    """Whether some ``doc`` stands in several rows; hot keys are not dealt out then, as rows that repeat must meet."""
    return not texts.groupBy("doc").count().where("count > 1").isEmpty()


class Hashes(dict):
    """64-bit hashes of byte strings, kept for those seen lately."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers of the positions in a window.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive hashes."""
    n = len(hashes) - k + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        total += hashes[j : j + n] * FACTORS[j]
    return mixed(total)


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of an odd factor and of its inverse, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 2 * n + 1
            one = np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size, _FACTOR, dtype=np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(size, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
        return self.up, self.down

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Sums before each byte, of which differences times ``down`` name stretches by their bytes."""
        up, _ = self.upto(len(data))
        return np.concatenate([[np.uint64(0)], np.cumsum(_OF_BYTE[data] * up[: len(data)], dtype=np.uint64)])


def sliding(values: np.ndarray, span: int, best) -> np.ndarray:
    """The best of each stretch of ``span`` values."""
    if len(values) < span:
        return values[:0]
    width, out = 1, values
    while 2 * width <= span:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(out) - (span - width)], out[span - width :]) if width < span else out


def text_groups(batches: Iterator[pa.RecordBatch], most: int = 500_000, text: int | str = 1) -> Iterator[pa.RecordBatch]:
    """Batches whose column ``text``, the second by default, holds about ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def word_hashes(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than ASCII white space) of all texts; the row of each; first word of each row, and the end."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = powers.sums(data)
    hashes = mixed((total[ends] - total[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))
    row_starts = np.searchsorted(starts, offsets)
    return hashes, np.repeat(np.arange(len(texts)), np.diff(row_starts)), row_starts
