"""Ranked word search (BM25) by postings with upper bounds.

A document falls to one of many blocks. The index holds the words of all documents by the order
of their hashes, with the block, how often the document has the word, and how long it is. A search
picks the postings of its words once, works out what a word adds to the score of each document, and
the most it adds to any of a block. The bounds of a query's words, summed up, bound every score in a block:

1. the blocks with the highest bounds are scored first; their ``k``-th best score is a floor that
   every result must reach,
2. blocks whose bound is below the floor are never opened,
3. words that together cannot reach the floor do not make a document a candidate: a document that
   shares only those with the query is never looked at,
4. what the other words add, plus the most that the weak ones can add in that block, must reach
   the floor too; the ``k`` best by the other words are scored in full and raise the floor, and
   only documents that can reach the raised one are scored in full.

The result is that of scoring every document. Ids are unique; null texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, tokens
from lodestone.index.shared import Steps, Tables, held_conf, if_few

BLOCK_DOCS = 64
#: Blocks that one task counts, sorts and writes.
PART_BLOCKS = 32
#: Scores this near to each other may change places when sums are taken in another order.
SLACK = 1e-9


class Postings(Tables):
    """An index in a folder: ``postings`` (h: hash of w, w, block, id, tf, len) and ``whole``, a row (n documents, mean length, k1, b)."""

    @property
    def postings(self) -> DataFrame:
        return self.read("postings")


def counted(words: Column) -> Column:
    """Each word of a list once, with its count and the list's length: array<struct<w, tf, len>>, from the places in the sorted list where another word begins."""

    def runs(s: Column) -> Column:
        places = F.slice(F.sequence(F.lit(0), F.size(s)), F.lit(1), F.size(s))
        begins = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"), F.size(s).alias("len"))))

    return let(F.sort_array(words), runs)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> Postings:
    """Write the postings of all documents below ``path``.

    Texts are shuffled by block and nothing else is: a document's words are counted in its row, and a task has whole blocks.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    n_blocks = max(1, -(-n_docs // BLOCK_DOCS))
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).alias("block")
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), block).repartition(-(-n_blocks // PART_BLOCKS), "block")
    tf = dealt.select("block", "id", F.inline(counted(tokens(F.lower("text")))))
    index = Postings(spark, path)
    index.write("postings", tf.select(F.xxhash64("w").alias("h"), "w", "block", "id", "tf", "len").sortWithinPartitions("h"))
    total = index.postings.agg(F.sum("tf")).first()[0]
    index.write("whole", spark.createDataFrame([(n_docs, total / n_docs if total else 1.0, k1, b)], "n long, mean double, k1 double, b double").coalesce(1))
    return index


def _read(index: Postings, queries: DataFrame, query: str, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words of queries that some document has (qid, w, most: what w adds at most), their postings (w, block, id, part) and the bounds of these (w, block, bound)."""
    whole = index.read("whole").first()
    asked = steps.keep(queries.select("qid", F.explode(F.array_distinct(tokens(F.lower(query)))).alias("w")), "words")
    words = asked.select(F.xxhash64("w").alias("h"), "w").distinct()
    met = steps.keep(index.postings.join(if_few(words), ["h", "w"]).drop("h"), "met")
    df = met.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("idf") * F.col("tf") * (whole.k1 + 1) / (F.col("tf") + whole.k1 * (1 - whole.b + whole.b * F.col("len") / whole.mean))
    read = steps.keep(met.join(if_few(df.select("w", idf.alias("idf"))), "w").select("w", "block", "id", part.alias("part")), "read")
    limits = steps.keep(read.groupBy("w", "block").agg(F.max("part").alias("bound")), "limits")
    most = limits.groupBy("w").agg(F.max("bound").alias("most"))
    return steps.keep(asked.join(if_few(most), "w"), "asked"), read, limits


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidates(index: Postings, queries: DataFrame, k: int, query: str = "query", steps: Steps | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents that are scored in full: qid, block, id and ``got``, what the strong words add; the words asked for; their postings."""
    steps = steps or Steps(index.spark, "search")
    asked, read, limits = _read(index, queries, query, steps)
    few = if_few(asked.select("qid", "w"))
    bounds = steps.keep(limits.join(few, "w").groupBy("qid", "block").agg(F.sum("bound").alias("bound")), "bounds")

    first = bounds.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block"))).where(F.col("n") <= k).select("qid", "block")
    begun = if_few(asked.select("qid", "w").join(if_few(first), "qid"))  # by word and block at once: a word of many queries isn't met by all of them in all blocks
    seen = read.join(begun, ["w", "block"]).groupBy("qid", "id").agg(F.sum("part").alias("score"))
    floors = _ranked(seen, k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))
    floors = steps.keep(floors, "floors")

    rising = Window.partitionBy("qid").orderBy("most", "w")
    told = asked.join(floors, "qid").withColumn("together", F.sum("most").over(rising))
    told = steps.keep(told.withColumn("strong", F.col("together") >= F.col("floor") - SLACK), "told")
    opened = bounds.join(if_few(floors), "qid").where(F.col("bound") >= F.col("floor") - SLACK).select("qid", "block", "floor")
    weak = limits.join(if_few(told.where("NOT strong").select("qid", "w")), "w")
    weak = weak.groupBy("qid", "block").agg(F.sum("bound").alias("weak"))
    opened = steps.keep(opened.join(weak, ["qid", "block"], "left").select("qid", "block", "floor", F.coalesce("weak", F.lit(0.0)).alias("weak")), "opened")
    strong = _postings(read, if_few(told.where("strong").select("qid", "w")), if_few(opened))
    got = strong.groupBy("qid", "block", "id").agg(F.sum("part").alias("got"), F.max("floor").alias("floor"), F.max("weak").alias("weak"))
    got = steps.keep(got.where(F.col("got") + F.col("weak") >= F.col("floor") - SLACK).select("qid", "block", "id", "got", "weak"), "hopeful")

    best = steps.keep(_ranked(got.withColumnRenamed("got", "score"), k).select("qid", "block", "id", "score"), "best")
    others = best.select("qid", "block", "id").join(if_few(told.where("NOT strong").select("qid", "w")), "qid")
    more = read.join(if_few(others), ["w", "block", "id"]).groupBy("qid", "id").agg(F.sum("part").alias("more"))
    whole = best.join(more, ["qid", "id"], "left").select("qid", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    raised = whole.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("raised"))
    got = got.join(if_few(raised), "qid").where(F.col("got") + F.col("weak") >= F.col("raised") - SLACK).select("qid", "block", "id", "got")
    return steps.keep(got, "got"), told, read


def _postings(read: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """The documents of the words asked for in the given blocks of each query, with what each word adds."""
    met = read.join(asked, "w").join(blocks, ["qid", "block"])
    return met.select("qid", "block", *[c for c in blocks.columns if c not in ("qid", "block")], "id", "part")


def top_k(index: Postings, queries: DataFrame, k: int = 10, query: str = "query") -> DataFrame:
    """``qid``, ``id``, ``score``, ``rank`` of the ``k`` best documents of each query (``qid``, ``query``); equal scores (to nine places) rank by id.

    Queries are no more than share-outs of words: they are joined, never collected.
    """
    steps = Steps(index.spark, "search")
    got, told, read = candidates(index, queries, k, query, steps)
    tasks = -(-index.read("whole").first().n // (BLOCK_DOCS * PART_BLOCKS)) or 1
    with held_conf(index.spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):  # both sides stay dealt by block: only postings are shuffled, not what they are to each query
        weak = read.repartition(tasks, "block").join(if_few(told.where("NOT strong").select("qid", "w")), "w")
        met = weak.join(got.select("qid", "block", "id").repartition(tasks, "block").hint("shuffle_hash"), ["qid", "block", "id"])
        more = steps.keep(met.groupBy("qid", "block", "id").agg(F.sum("part").alias("more")).select("qid", "id", "more"), "more")
    scores = got.join(more, ["qid", "id"], "left").select("qid", "id", (F.col("got") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return _ranked(scores, k)
