"""Traversal of labelled graphs from many seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.index.shared import if_few
from lodestone.sources.places import shared_folder

#: Nodes that one task gathers, and that one row lists for a seed, about.
TASK_NODES, LIST_NODES = 1_000_000, 200_000


def both_ways(edges: DataFrame, undirected=None) -> DataFrame:
    """Edges (``source``, ``target`` and others) with those for which ``undirected`` holds, or all, also backwards."""
    back = edges if undirected is None else edges.where(undirected)
    return edges.unionByName(back.withColumns({"source": F.col("target"), "target": F.col("source")}))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """``seed``, ``node``, ``depth`` of what each seed reaches over ``edges`` (``source``, ``target``, ``kind``), nearest first.

    ``seeds``: ``seed``. ``kinds`` are the kinds of edges that are followed, all without. A seed
    counts itself at depth 0 and gathers ``budget`` nodes at most: whole levels while they fit,
    then of the level that doesn't the first by node; it goes no further. Breadth first, one
    join a step. Each frontier but the last is written and read again, so that a plan is as long for the
    last step as for the first, and a step that reaches nothing ends the walk; the last, which has most
    rows, is worked out when the result is read. While a frontier has few rows it is broadcast to the
    edges, which then aren't shuffled; a larger one meets lists of what nodes lead to (``_by_lists``).
    Nodes that are null lead nowhere; edges may repeat.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession, "walk")
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(kinds))
    steps = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("node"), F.col("target").alias("next"))

    def settled(df: DataFrame, level: int) -> DataFrame:
        """One level's rows beside those of the levels before."""
        path = f"{folder}/seen/depth={level}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    front = settled(seeds.select("seed").where("seed IS NOT NULL").distinct().select("seed", F.col("seed").alias("node"), F.lit(1).cast("long").alias("used")), 0)
    seen_schema = T.StructType([*front.schema.fields, T.StructField("depth", T.IntegerType())])
    seen = lambda: spark.read.schema(seen_schema).parquet(f"{folder}/seen")  # noqa: E731  (one scan, whatever the depth)

    def fresh(front: DataFrame) -> DataFrame:
        """What one more step reaches and no step before did: seed, node, used."""
        open_ = front if budget is None else front.where(F.col("used") < budget)
        known, near = seen().select("seed", "node"), if_few(open_)
        if near is open_:
            new = _by_lists(open_, steps, known, budget)
        else:
            reached = near.join(steps, "node").select("seed", F.col("next").alias("node"), "used", F.lit(False).alias("old"))
            met = reached.unionAll(known.select("seed", "node", F.lit(0).cast("long"), F.lit(True)))
            new = met.groupBy("seed", "node").agg(F.max("used").alias("used"), F.max("old").alias("old")).where("NOT old").select("seed", "node", "used")
        if budget is None:
            return new
        of_seed = Window.partitionBy("seed")
        new = new.withColumn("n", F.row_number().over(of_seed.orderBy("node"))).where((F.col("n") <= budget) & (F.col("used") + F.col("n") <= budget))
        return new.select("seed", "node", (F.col("used") + F.count("*").over(of_seed)).alias("used"))

    for level in range(1, depth):
        front = settled(fresh(front), level)
        if front.isEmpty():
            return seen().select("seed", "node", "depth")
    found = seen().select("seed", "node", "depth")
    return found.unionAll(fresh(front).select("seed", "node", F.lit(depth).alias("depth"))) if depth > 0 else found


def _by_lists(front: DataFrame, steps: DataFrame, seen: DataFrame, budget: int | None) -> DataFrame:
    """``seed``, ``node``, ``used`` of what a large frontier newly reaches: lists of nodes are shuffled, and cleared of what has been seen in one row a seed.

    A seed that meets more than ``LIST_NODES`` nodes makes all seeds' lists fall into slices by the
    node's hash. With a budget a slice keeps the first nodes that could fit.
    """
    near = steps.join(front.select("node").distinct(), "node", "left_semi")
    degrees = near.groupBy("node").agg(F.count("*").alias("n"))
    load = front.join(degrees, "node").groupBy("seed").agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    slices, tasks = 1 + (load["most"] or 0) // LIST_NODES, 1 + ((load["all"] or 0) + seen.count()) // TASK_NODES
    keys = ["seed", "slice"] if slices > 1 else ["seed"]
    part = lambda node: F.pmod(F.xxhash64(node), F.lit(slices)).alias("slice")

    lists = near.groupBy("node", part("next")).agg(F.collect_set("next").alias("new")).repartition(tasks, "node")
    none = F.lit(None).cast("array<string>")
    met = front.repartition(tasks, "node").join(lists, "node").select("seed", "slice", "new", none.alias("old"), "used")
    met = met.unionAll(seen.select("seed", part("node"), none, F.array("node"), F.lit(None).cast("long"))).repartition(tasks, *keys)
    rows = met.groupBy("seed", "slice").agg(F.flatten(F.collect_list("new")).alias("new"), F.flatten(F.collect_list("old")).alias("old"), F.max("used").alias("used"))
    fresh = F.array_except("new", "old")
    if budget is not None:
        fresh = F.slice(F.sort_array(fresh), F.lit(1), F.coalesce(F.lit(budget) - F.col("used"), F.lit(0)).cast("int"))
    return rows.select("seed", F.explode(fresh).alias("node"), "used")
