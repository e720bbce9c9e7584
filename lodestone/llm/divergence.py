"""Source divergence audit: how far the sources of a language differ in the terms they use.

Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z are lower-cased. Each
language keeps the terms that stand in at least ``min_docs`` of its documents. A group (language
and source, or a whole language) gives a kept term of ``c`` occurrences the probability
``1 + floor(SCALE * (c + 5) / (N + 5 * V))`` in units of 1 / ``SCALE``, where ``N`` counts its
occurrences of kept terms and ``V`` the kept terms.

That depends on ``c`` alone, so a pair of sources needs no list of terms: its joint histogram
holds each combination of counts ``(c, d)`` once, with the number of terms that show it. Terms
that both have come from a join; terms that one of them lacks follow from the histograms of
each source less those, and terms that both lack from ``V``. The distance is evaluated once a
combination, times its number.

Terms are told apart by hashes of 64 bits; their names come back for what is shown.

Null texts, languages and sources count as "". Each row is a document of its own, repeated or
not. A group without terms has probabilities like any other; a language without kept terms has
pairs of value 0. Without rows the result has none. Only the three columns are read. Everything
is whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Powers, Scratch, mixed, table, text_groups

MIN_DOCS, TOP_TERMS, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Entries of a task's table of counts, and bytes of its terms, after which it is sent on.
HELD, HELD_BYTES = 2_000_000, 24 << 20
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Parts that the sources of a language are dealt to when they are paired.
PARTS = 16

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: What is no part of a term becomes a space.
TERM_BYTES = np.array([c if c >= 0x80 or c in _LETTERS else c + 32 if c + 32 in _LETTERS and c < 0x60 else 0x20 for c in range(256)], dtype=np.uint8)


class Terms:
    """The terms of some bytes, as hashes and places; none crosses an edge between texts."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, powers: Powers):
        self.data = TERM_BYTES[data]
        inside = self.data != 0x20
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        met = edges[(edges > 0) & (edges < len(data))]
        first[met], last[met - 1] = inside[met], inside[met - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = powers.sums(self.data)
        self.hashes = mixed((total[self.ends] - total[self.starts]) * powers.down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def name(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in stretches of about ``PIECE`` bytes that end between terms."""
    start = 0
    while len(data) - start > PIECE:
        ahead = np.flatnonzero(TERM_BYTES[data[start + PIECE : start + 2 * PIECE]] == 0x20)
        end = start + PIECE + int(ahead[0]) if len(ahead) else start + 2 * PIECE
        while not len(ahead) and end < len(data) and TERM_BYTES[data[end]] != 0x20:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


class Counts:
    """What a task has counted: of each group and term the occurrences and documents, and the name of each term met."""

    def __init__(self):
        self.powers, self.groups = Powers(), {}
        self.clear()

    def clear(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.names: dict[int, bytes] = {}
        self.size = self.n_bytes = 0
        self.groups.clear()

    def take(self, groups: list[tuple[str, str]], texts: pa.Array) -> None:
        """Count texts, each of its group (language and source)."""
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], dtype=np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if len(texts) == 1 and len(data) > 2 * PIECE:
            parts = []
            for piece in stretches(data):
                terms = Terms(piece, np.zeros(0, np.int64), self.powers)
                found, first, n = np.unique(terms.hashes, return_index=True, return_counts=True)
                self._name(found, first, terms)
                parts.append((found, n))
            found, at = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(found)).astype(np.int64)
            self._hold(np.full(len(found), group[0]), found, n, np.ones(len(found), np.int64))
            return
        offsets = offsets - offsets[0]
        terms = Terms(data, offsets[1:-1], self.powers)
        found, first, code = np.unique(terms.hashes, return_index=True, return_inverse=True)
        self._name(found, first, terms)
        row = np.searchsorted(offsets, terms.starts, side="right") - 1
        kinds = max(len(found), 1)
        pair, at = np.unique(group[row] * kinds + code, return_inverse=True)
        n = np.bincount(at, minlength=len(pair))
        once = np.unique(row * len(pair) + at) % max(len(pair), 1)  # a document and a term of its group
        self._hold(pair // kinds, found[pair % kinds] if len(found) else found, n, np.bincount(once, minlength=len(pair)))

    def _name(self, found: np.ndarray, first: np.ndarray, terms: Terms) -> None:
        for h, k in zip(found.tolist(), first.tolist(), strict=True):
            if h not in self.names:
                self.names[h] = name = terms.name(k)
                self.n_bytes += len(name)

    def _hold(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    @property
    def full(self) -> bool:
        return self.size > HELD or self.n_bytes > HELD_BYTES

    def out(self) -> Iterator[pa.RecordBatch]:
        """What is held, summed up, and forget it; a row without a term for each group, a row without a group for each name."""
        group, term, n, n_docs = (np.concatenate([h[k] for h in self.held]) if self.held else np.zeros(0, np.int64) for k in range(4))
        order = np.lexsort((term, group))
        group, term = group[order], term[order].astype(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (term[1:] != term[:-1])])) if len(group) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x[order], new).astype(np.int64) if len(new) else np.zeros(0, np.int64) for x in (n, n_docs)]
        names = list(self.groups)
        every = np.concatenate([np.arange(len(names)), group[new]])
        langs, sources = (pa.array([g[k] for g in names], pa.string()).take(pa.array(every)) for k in (0, 1))
        no_term = np.concatenate([np.ones(len(names), bool), np.zeros(len(new), bool)])
        ids = pa.array(np.concatenate([np.zeros(len(names), np.int64), term[new].view(np.int64)]), mask=no_term)
        zero = np.zeros(len(names), np.int64)
        columns = [langs, sources, ids, *[pa.array(np.concatenate([zero, x])) for x in sums], pa.nulls(len(every), pa.string())]
        yield from pa.Table.from_arrays(columns, names=COUNT_COLUMNS).to_batches(max_chunksize=100_000)
        known = pa.array(np.fromiter(self.names, np.uint64, len(self.names)).view(np.int64))
        empty = pa.nulls(len(known), pa.string())
        columns = [empty, empty, known, *[pa.array(np.zeros(len(known), np.int64))] * 2, pa.array(list(self.names.values()), pa.binary()).cast(pa.string())]
        yield from pa.Table.from_arrays(columns, names=COUNT_COLUMNS).to_batches(max_chunksize=100_000)
        self.clear()


COUNT_COLUMNS = ["lang", "source", "term", "n", "n_docs", "name"]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term (a hash), n, n_docs, name of what a task reads, summed there."""
    counts = Counts()
    for batch in text_groups(batches, PIECE, "text"):
        groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        counts.take(groups, batch.column("text").cast(pa.binary()))
        if counts.full:
            yield from counts.out()
    yield from counts.out()


def probability(c: str, n: str, v: str) -> str:
    """SQL of the scaled probability of a term of ``c`` occurrences in a group of ``n``, among ``v`` kept terms."""
    return f"(1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({c} + {PRIOR} AS DECIMAL(20, 0))) div CAST({n} + {PRIOR} * {v} AS DECIMAL(20, 0)))"


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    ``pair``: each other source of the language, by the sum over all kept terms of the distance
    between the probabilities. ``term``: the terms a source has and uses more than its language
    does, by that distance, the first ``top`` of them. Ranks are by falling value, then by item.
    """
    scratch = Scratch(df.sparkSession, "divergence")
    read = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = scratch.settle(read.mapInArrow(count_terms, "lang string, source string, term long, n long, n_docs long, name string"), "found")
    counts = scratch.settle(found.where("name IS NULL").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    kept = scratch.settle(terms.select("lang", "source", "term", "n").join(kept.drop("n_docs"), ["lang", "term"]), "kept")

    of_lang = kept.select("lang", "term", "in_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = scratch.settle(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_group", "v", "n_lang")]), "groups")
    known = scratch.settle(kept.join(groups, ["lang", "source"]), "known")
    names = found.where("name IS NOT NULL").select("term", "name")

    result = ranked_terms(scratch, known, names, top).unionByName(ranked_pairs(scratch, groups, known))
    return result.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def ranked_terms(scratch: Scratch, known: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """The terms that stand out in each group."""
    gaps = known.select("lang", "source", "term", F.expr(f"{probability('n', 'n_group', 'v')} - {probability('in_lang', 'n_lang', 'v')}").alias("value")).where("value > 0")
    # names decide between equal values only, so most terms are told apart before they get one
    least = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = scratch.settle(gaps.withColumn("k", F.rank().over(least)).where(F.col("k") <= top).drop("k"), "first")
    names = names.join(first.select("term").distinct(), "term", "left_semi").distinct()
    named = first.join(names.withColumnRenamed("name", "item"), "term")
    return ranked(named.select("lang", "source", "item", "value")).where(F.col("rank") <= top).withColumn("part", F.lit("term"))


def ranked_pairs(scratch: Scratch, groups: DataFrame, known: DataFrame) -> DataFrame:
    """Each source against each other one of its language, from joint histograms of counts."""
    pair = ["lang", "a", "b", "n_a", "n_b", "v"]
    one = lambda df, x: df.select("lang", "v", F.col("source").alias(x), F.col("n_group").alias(f"n_{x}"), *[c for c in ("term", "part") if c in df.columns], *([F.col("n").alias(f"c_{x}")] if "n" in df.columns else []))
    # sources meet part by part, so that no task has all of a language
    left = one(groups.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(PARTS))), "a")
    right = one(groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>"))), "b")
    pairs = scratch.settle(left.join(right.drop("v"), ["lang", "part"]).where("a < b").select(pair), "pairs")

    both = one(known, "a").join(one(known, "b").drop("v"), ["lang", "term"]).where("a < b")
    both = scratch.settle(both.groupBy(*pair, "c_a", "c_b").agg(F.count("*").alias("m")), "both")
    alone = scratch.settle(known.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), "alone")

    def lacking(x: str) -> DataFrame:
        """Terms of each count in ``x``, as if the other had none of them."""
        own = alone.select("lang", F.col("source").alias(x), F.col("n").alias(f"c_{x}"), "m").hint("merge")
        return pairs.join(own, ["lang", x])

    def counted(df: DataFrame, *cells: tuple[Column, Column, Column]) -> DataFrame:
        """``cells`` of each row: both counts and how many terms more show them."""
        return df.select(*pair, F.explode(F.array(*[F.struct(a.alias("c_a"), b.alias("c_b"), m.alias("m")) for a, b, m in cells])).alias("c")).select(*pair, "c.*")

    a, b, m, zero = F.col("c_a"), F.col("c_b"), F.col("m"), F.lit(0).cast("long")
    # what both have is taken off where one was taken to lack it, and what one has where both were
    cells = counted(both, (a, b, m), (a, zero, -m), (zero, b, -m), (zero, zero, m))
    cells = cells.unionByName(counted(lacking("a"), (a, zero, m), (zero, zero, -m)))
    cells = cells.unionByName(counted(lacking("b"), (zero, b, m), (zero, zero, -m)))
    cells = cells.unionByName(counted(pairs, (zero, zero, F.col("v"))))
    cells = cells.groupBy(*pair, "c_a", "c_b").agg(F.sum("m").alias("m")).where("m <> 0")
    apart = F.expr(f"m * abs({probability('c_a', 'n_a', 'v')} - {probability('c_b', 'n_b', 'v')})")
    sums = cells.groupBy("lang", "a", "b").agg(F.sum(apart).alias("value"))
    values = scratch.settle(pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0)).alias("value")), "values")
    ways = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(values.select("lang", "b", "a", "value"))
    return ranked(ways).withColumn("part", F.lit("pair"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language of ``documents``, and the terms that stand out in each."""
    return divergence(table(spark, sf_dir, "documents"))


_P = f"1 + {SCALE}::HUGEINT * ({{c}} + {PRIOR}) // ({{n}} + {PRIOR} * {{v}})"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS n_lang FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n_group
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN langs USING (lang)),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, {_P.format(c='coalesce(n, 0)', n='n_group', v='v')} AS p, {_P.format(c='in_lang', n='n_lang', v='v')} AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
