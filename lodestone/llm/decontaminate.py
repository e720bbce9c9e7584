"""Benchmark decontamination: which documents hold which test items.

A document holds an item if it holds at least 80 % of the item's distinct five-word
shingles. Items are partitioned by size. All items of a partition get MinHash sketches
of one length, the smallest hash values of their shingles, so long that a document which
holds enough of an item must share one value at least with its sketch: the search loses
nothing, however long the document. Candidates are then verified on the shingles
themselves.

Words are maximal runs of letters, marks and digits, in lower case. Items shorter than
five words have one shingle, all their words. Null or wordless items and documents match
nothing. Repeated rows count once; rows without an id are one document or item of no name.
Without items or documents the result has no rows. Only the id and text columns are read.

Only built-in functions are used. The sketches are broadcast where their number is proven
small and joined by shuffle otherwise; nothing about documents is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, let, table

SHINGLE_WORDS = 5
PERCENT = 80
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, k: int, hashed: bool) -> Column:
    """Runs of ``k`` words, in order, as strings or as hashes; none if there are fewer words."""

    def at(w: Column, i: Column) -> Column:
        run = [F.get(w, i + j) for j in range(k)]
        return F.xxhash64(*run) if hashed else F.concat_ws(" ", *run)

    empty = F.array().cast("array<bigint>" if hashed else "array<string>")
    return let(w, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: at(w, i))).otherwise(empty))


def item_shingles(w: Column, k: Column, hashed: bool) -> Column:
    """The distinct shingles of an item; ``k`` is the smaller of five and its number of words."""
    by_length = F.when(k == 1, shingles(w, 1, hashed))
    for n in range(2, SHINGLE_WORDS + 1):
        by_length = by_length.when(k == n, shingles(w, n, hashed))
    return F.array_distinct(by_length)


def is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def item_sketches(scratch: Scratch, items: DataFrame, item_id: str, text: str, percent: int) -> DataFrame:
    """item, k, item_shingles (strings), n_item, needed (shared sketch values), sketch (hashes)."""
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    out = (
        items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("k", F.least(F.lit(SHINGLE_WORDS), F.size("w")))
        .withColumn("item_shingles", item_shingles(F.col("w"), F.col("k"), False))
        .withColumn("n_item", F.size("item_shingles"))
        .withColumn("sketch_size", F.least(F.col("n_item"), F.floor(upper * (100 - percent) / 100).cast("int") + 1))
        .withColumn("needed", F.expr(f"sketch_size - (n_item - CAST(ceil({percent} * n_item / 100) AS int))"))
        .withColumn("sketch", F.slice(F.array_sort(item_shingles(F.col("w"), F.col("k"), True)), F.lit(1), F.col("sketch_size")))
        .drop("w", "sketch_size")
        .dropDuplicates(["item", "item_shingles"])
    )
    return scratch.settle(out, "items")


def document_hashes(w: Column, lengths: list[int]) -> Column:
    """Hashes of all shingles of the given lengths."""
    return let(w, lambda w: F.concat(*[shingles(w, k, True) for k in lengths]))


def shared_shingles(w: Column) -> Column:
    """How many of ``item_shingles`` stand in the document of words ``w``."""
    padded = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return let(padded, lambda p: F.size(F.filter("item_shingles", lambda s: F.contains(p, F.concat(F.lit(" "), s, F.lit(" "))))))


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every document that holds an item.

    Hashes alone meet the sketches; texts are read again for the pairs that these find, and each
    pair is verified once. Sketches, and pairs, of a proven small number are broadcast, so that no
    text is shuffled; beyond that bound they meet by shuffle.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    known = item_sketches(scratch, items, item_id, item_text, percent)
    lengths = sorted(r[0] for r in known.select("k").distinct().collect()) or [SHINGLE_WORDS]  # five values at most
    sketch = known.select("item", "needed", F.explode("sketch").alias("h"))
    known = known.select("item", "item_shingles", "n_item")
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where("text IS NOT NULL")
    hashes = texts.select("doc", F.explode(F.array_distinct(document_hashes(words(F.col("text")), lengths))).alias("h"))
    found = hashes.join(F.broadcast(sketch) if is_small(sketch) else sketch, "h").groupBy("doc", "item", "h").agg(F.max("needed").alias("needed"))
    pairs = found.groupBy("doc", "item").agg(F.count("*").alias("n"), F.max("needed").alias("needed")).where("n >= needed")
    pairs = scratch.settle(pairs.select(F.col("doc").alias("_doc"), F.col("item").alias("_item")), "pairs")
    # nameless documents and items are one each, so names meet null-safe
    held = texts.join(F.broadcast(pairs) if is_small(pairs) else pairs, F.col("doc").eqNullSafe(F.col("_doc")))
    held = held.join(F.broadcast(known) if is_small(known) else known, F.col("_item").eqNullSafe(F.col("item")))
    verified = held.select("doc", "item", "n_item", shared_shingles(words(F.col("text"))).alias("n_shared"))
    verified = verified.groupBy("doc", "item").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    verified = verified.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return verified.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        F.col("n_shared").cast("long").alias("n_shared"),
        F.col("n_item").cast("long").alias("n_item"),
        F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ik)))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, round(count(*) / any_value(n_item), 6) AS containment
FROM dsh JOIN ish USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)"""
