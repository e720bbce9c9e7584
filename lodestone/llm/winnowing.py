"""Document fingerprints by winnowing.

Every run of ``gram`` code points has a rolling hash; of every ``window`` consecutive hashes the
smallest is chosen, the rightmost of equal ones, and kept with its position. Two texts that share
any stretch of ``gram + window - 1`` code points share a chosen hash of it, and none shorter than
``gram`` is ever seen (short of equal hashes of 64 bits). A text with fewer hashes than a window
keeps the smallest of all, one shorter than a run has one hash of the whole, the empty text none.

Nulls count as "". Texts are hashed as they are. Long texts are read in overlapping strips, so
that a task holds some MB whatever their length.

``with_next`` pairs each row with the next one by descending id, after the last the first. Ids
are cut into ranges of about ``BUCKET_BYTES`` of text by bounds from a sample, each range is one
group of tasks' rows in order, and the first row of each range also goes to the range before it:
texts are shuffled once. Rows that repeat an id follow each other by a hash of their texts, rows
without an id come last in the same way, and an id that fills whole ranges is cut by that hash.
A lone row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Powers, mixed, small_batches, table, text_groups

GRAM, WINDOW = 16, 32
#: Code points of a strip of a long text, and of texts that are hashed together.
STRIP = 1 << 19
#: Bytes of text in a range of ids, and ranges at most; rows of the sample that bounds come from, for each.
BUCKET_BYTES, MOST_BUCKETS, SAMPLE = 4 << 20, 20_000, 20
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)

FINGERPRINT = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("position", T.IntegerType())]))


class Winnower:
    """Fingerprints of many texts at once, as hashes, positions and the bounds of each text's share."""

    def __init__(self, gram: int = GRAM, window: int = WINDOW, strip: int = STRIP):
        if gram < 1 or window < 1 or strip < 1:
            raise ValueError("gram, window and strip must be positive")
        self.gram, self.window, self.strip, self.powers = gram, window, strip, Powers()

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Chosen hashes and their positions, in order of position, for each text."""
        parts, whose, begins, out, held = [], [], [], [], 0
        chosen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]

        def flush() -> None:
            for k, begin, found in zip(whose, begins, self._strips(parts), strict=True):
                chosen[k].append((found[0], found[1] + begin))
            parts.clear(), whose.clear(), begins.clear()

        for k, text in enumerate(texts):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            for begin in range(0, len(points), self.strip):
                if begin and len(points) - begin < self.gram + self.window - 1:
                    break  # the strip before has all windows
                part = points[begin : begin + self.strip + self.gram + self.window - 2]
                parts.append(part), whose.append(k), begins.append(begin)
                held += len(part)
                if held >= self.strip:
                    flush()
                    held = 0
        flush()
        for found in chosen:
            hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
            places = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
            new = np.concatenate([[True], places[1:] != places[:-1]]) if len(places) else np.zeros(0, bool)
            out.append((hashes[new], places[new]))
        return out

    def _strips(self, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not parts:
            return []
        lengths = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        points = np.concatenate(parts).astype(np.uint64)
        up, down = self.powers.upto(len(points))
        values = mixed((points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(points)], dtype=np.uint64)])
        # a strip has a hash for each of its runs, or one of the whole, and then places without a hash up to a window
        run = np.minimum(lengths, self.gram)
        n_runs = lengths - run + 1
        width = np.maximum(n_runs, self.window)
        row = np.repeat(np.arange(len(parts)), width)
        first = np.concatenate([[0], np.cumsum(width)])
        place = np.arange(int(first[-1])) - first[row]
        real = place < n_runs[row]
        at = np.where(real, starts[row] + place, starts[row])
        hashes = mixed((total[at + run[row]] - total[at]) * down[at] + run[row].astype(np.uint64))
        hashes = np.where(real, np.minimum(hashes, NO_HASH - np.uint64(1)), NO_HASH)
        best = self._rightmost_least(hashes)
        whole = place[: len(best)] + self.window <= width[row[: len(best)]]
        best, row_of = best[whole], row[: len(whole)][whole]
        new = np.concatenate([[True], best[1:] != best[:-1]])
        best, row_of = best[new], row_of[new]
        cuts = np.searchsorted(row_of, np.arange(len(parts) + 1))
        return [(hashes[best[a:b]], place[best[a:b]].astype(np.int64)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _rightmost_least(self, hashes: np.ndarray) -> np.ndarray:
        """For each window the place of its smallest hash, the rightmost of equal ones."""
        least, at, width = hashes, np.arange(len(hashes)), 1

        def joined(shift: int) -> None:
            nonlocal least, at
            n = len(least) - shift
            right = least[shift:] <= least[:n]
            least, at = np.where(right, least[shift:], least[:n]), np.where(right, at[shift:], at[:n])

        while 2 * width <= self.window:
            joined(width)
            width *= 2
        if width < self.window:
            joined(self.window - width)
        return at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of two fingerprints that are in both; 1 for two without any."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


RECORD = np.dtype([("hash", ">u8"), ("position", ">u4")])


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as text: 16 hexadecimal digits of each hash and 8 of its position."""
    record = np.empty(len(hashes), RECORD)
    record["hash"], record["position"] = hashes, places
    return record.tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out``, an array of structs of hash and position in order of position; a column of that name is replaced. One narrow pass."""
    small_batches(df.sparkSession)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, FINGERPRINT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(gram, window)
        for batch in text_groups(batches, STRIP, text):
            found = winnower.of([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(h) for h, _ in found])]).astype(np.int32)
            hashes, places = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            values = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(places.astype(np.int32))], names=["hash", "position"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def shared_places(left: DataFrame, right: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """left_id, left_position, right_id, right_position of every chosen hash that texts of both sides have, by an equi-join."""

    def places(df: DataFrame, side: str) -> DataFrame:
        found = df.select(F.col(doc_id).alias(f"{side}_id"), F.explode(fingerprint).alias("f"))
        return found.select(f"{side}_id", F.col("f.position").alias(f"{side}_position"), F.col("f.hash").alias("hash"))

    return places(left, "left").join(places(right, "right"), "hash").drop("hash")


class Ranges:
    """Which range of ids a row falls to; ranges follow the order of rows."""

    def __init__(self, bounds: np.ndarray, n_nameless: int):
        self.rising, self.n_nameless = np.sort(bounds), n_nameless

    def of(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        known = np.asarray(ids.is_valid())
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
        larger = len(self.rising) - np.searchsorted(self.rising, keys, side="right")
        same = len(self.rising) - np.searchsorted(self.rising, keys, side="left") - larger
        share = (hashes.astype(np.int64).astype(np.float64) + 2.0**63) / 2.0**64  # in order of the signed hash
        inside = np.minimum((share * np.maximum(same, 1)).astype(np.int64), np.maximum(same, 1) - 1)
        last = np.minimum((share * self.n_nameless).astype(np.int64), self.n_nameless - 1)
        return np.where(known, larger + inside, len(self.rising) + 1 + last)


def ranges(keys: DataFrame, total: int, n_bytes: int, bucket_bytes: int) -> Ranges:
    """Bounds between ranges of ids, from a sample of rows of a stated size that hashes decide."""
    wanted = max(1, min(MOST_BUCKETS, n_bytes // bucket_bytes, total))
    share = min(1.0, SAMPLE * wanted / max(total, 1))
    chosen = keys if share == 1.0 else keys.where(F.pmod(F.xxhash64("_id", "_hash", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    seen = [r[0] for r in chosen.select("_id").collect()]
    ids = np.sort(np.array([x for x in seen if x is not None], dtype=np.int64))
    cuts = ids[(np.arange(1, wanted) * len(ids)) // wanted] if len(ids) else ids
    return Ranges(cuts, max(1, round(wanted * (len(seen) - len(ids)) / max(len(seen), 1))))


def with_next(df: DataFrame, run: Callable, schema: str, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``run(rows)`` over pairs of a row and the text of the next one by descending id.

    ``run`` is given an iterator of lists of ``(id, text, next text)``, nulls read as "", and yields record batches of ``schema``.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    total, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    found = ranges(rows.select("_id", "_hash"), total, n_bytes, bucket_bytes)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = found.of(batch.column("_id"), batch.column("_hash").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int64())], names=[*batch.schema.names, "_bucket"])

    def placed(of: DataFrame) -> DataFrame:
        return of.mapInArrow(dealt, T.StructType([*of.schema.fields, T.StructField("_bucket", T.LongType())]))

    # ids fall, those missing come last: the order of rows is that of these three
    order = F.struct(F.col("_id").isNull().alias("nameless"), F.bitwise_not("_id").alias("fall"), F.col("_hash").alias("hash"))
    firsts = placed(rows.select("_id", "_hash")).groupBy("_bucket").agg(F.min(order).alias("o")).orderBy("_bucket").collect()  # one row a range
    before = {firsts[k]._bucket: firsts[k - 1]._bucket for k in range(len(firsts))}  # the first range stands before none, so it follows the last
    heads = [(r._bucket, None if r.o.nameless else ~r.o.fall, r.o.hash, before[r._bucket]) for r in firsts]
    known = spark.createDataFrame(heads, "_bucket long, _first_id long, _first_hash long, _before long")
    # a row for each range; where rows repeat id and text, each stands for the same next text
    marked = placed(rows).join(F.broadcast(known), "_bucket")
    is_first = F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_hash") == F.col("_first_hash"))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("guest"))
    spread = marked.select("_id", "_hash", "_text", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    spread = spread.select(F.col("p.bucket").alias("bucket"), F.col("p.guest").alias("guest"), "_id", "_hash", "_text")
    ordered = spread.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("_id").desc_nulls_last(), "_hash")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held = None  # a row that waits for its next one
        for batch in text_groups(batches, STRIP, "_text"):
            out = []
            columns = (batch.column(n).to_pylist() for n in ("bucket", "guest", "_id", "_text"))
            for bucket, is_guest, i, t in zip(*columns, strict=True):
                if held is not None and held[0] == bucket:
                    out.append((held[1], held[2], t))
                held = None if is_guest else (bucket, i, t)
            if out:
                yield out

    return ordered.mapInArrow(lambda batches: run(pairs(batches)), schema)


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(df: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are.

    The last third of the code points is replaced by the first as many of the next document, or by
    all that it has. Rows keep nulls in their ids; other columns are not returned.
    """

    def run(rows: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(gram, window)
        last: tuple | None = None  # text and fingerprint of what came as next one last
        for part in rows:
            edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, after in part]
            texts: dict[str, int] = {}
            for _, t, after in part:
                texts.setdefault(t, len(texts)), texts.setdefault(after, len(texts))
            names = [t for t in texts if last is None or t != last[0]]
            known = dict(zip(names, winnower.of(names), strict=True)) | ({last[0]: last[1]} if last else {})
            changed = winnower.of(edited)
            last = (part[-1][2], known[part[-1][2]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in part], pa.int64()),
                    pa.array([len(t) for _, t, _ in part], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([written(*known[t]) for _, t, _ in part], pa.string()),
                    pa.array([written(*c) for c in changed], pa.string()),
                    pa.array([likeness(known[t][0], c[0]) for (_, t, _), c in zip(part, changed, strict=True)], pa.float64()),
                    pa.array([likeness(known[t][0], known[after][0]) for _, t, after in part], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(df, run, EDITS, doc_id, text, bucket_bytes)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document of ``documents`` and of its edited text, and their likeness."""
    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))
