"""Phrase collocation mining: which runs of words stand together more than their parts would.

First pass: each task counts its runs of one word up to the longest phrase into count-min
sketches, two rows of cells told by hashes, and sends the cells it touched; blocks of cells are
summed. A cell never counts less than any run in it, so a run with a cell below the least count
is not frequent. Second pass: runs whose cells all reach the least count are counted exactly, by
their words; what the sketch let through in error falls to the exact count, and nothing frequent
is lost. A longer run is only looked at where the shorter ones inside it are let through too.
Runs are named by the hashes of their words, of 64 bits each; words come back for the phrases that are shown.

A phrase is then cut into a first part and the rest at each place; the score of a cut is
``floor(SCALE * a * a / (l * r))`` with the counts of phrase, first part and rest, and the lowest
cut counts, the first of equal ones. Phrases inside a longer one that takes at least ``COVER``
percent of their occurrences are dropped.

A-Z are lower-cased, texts are split at ``. , ; : ! ?`` and at line ends and feeds, words are runs
of other than space and tab; no phrase crosses a split. Languages are apart; null is "und", null
texts are "". Rows that repeat count each. Without rows the result has none. Texts are read in
pieces that end at a split, so a task's memory follows the longest stretch without one.

The sketch has a cell for every ``BYTES_A_CELL`` bytes of text, ``MOST_CELLS`` at most. One bit a
cell is what tasks of the second pass get (64 MB at the bound); larger corpora let more runs
through to the exact count, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import FACTORS, Powers, Scratch, mixed, table, text_groups

LEAST, LONGEST, TOP, SCALE, COVER = 10, 3, 2000, 1_000_000, 50
BYTES_A_CELL, FEWEST_CELLS, MOST_CELLS, ROWS = 8, 1 << 20, 1 << 28, 2
#: Cells of a block, which is summed as one; cells stop counting at ``FULL``.
BLOCK, FULL = 1 << 20, 127
#: Runs that a task holds before it sends its cells; runs that it holds with their counts; bytes of words; bytes of text at a time.
HELD, PHRASES, NAME_BYTES, GROUP = 2_500_000, 800_000, 12 << 20, 1 << 20
#: Parts in which a language's phrases are ranked before they meet.
PARTS = 64

_WORD, _SPACE, _SPLIT = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _SPLIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Runs:
    """Words of some texts of one language, with the hash of every run of words that no split crosses."""

    def __init__(self, texts: pa.Array, lang: str, powers: Powers, longest: int):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
        edges = (offsets - offsets[0])[1:-1]
        kind = _KIND[data]
        inside = kind == _WORD
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        met = edges[(edges > 0) & (edges < len(data))]
        first[met], last[met - 1] = inside[met], inside[met - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        # a piece is what lies between splits of one text
        cut = kind == _SPLIT
        piece = np.cumsum(cut, dtype=np.int64)
        piece = piece[self.starts] + np.searchsorted(met, self.starts, side="right") if len(met) else piece[self.starts]
        total = powers.sums(data)
        words = mixed((total[self.ends] - total[self.starts]) * powers.down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.data, self.words, self.hashes, self.whole = data, words, [], []
        seed = mixed(np.array([hash_of(lang)], dtype=np.uint64))[0]
        for k in range(1, longest + 1):
            n = max(len(words) - k + 1, 0)
            run = np.full(n, seed + np.uint64(k), dtype=np.uint64)
            for j in range(k if n else 0):
                run += words[j : j + n] * FACTORS[j]
            self.hashes.append(mixed(run))
            self.whole.append(piece[:n] == piece[k - 1 : k - 1 + n])

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def hash_of(lang: str) -> int:
    """64 bits of a language's name."""
    raw = np.frombuffer(lang.encode(), np.uint8)
    return int(np.sum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(len(raw), FACTORS[0])), dtype=np.uint64)) if len(raw) else 1


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A text in stretches of some ``most`` bytes that each end at a split."""
    start = 0
    while len(text) - start > most:
        ahead = np.frombuffer(text, np.uint8, offset=start + most)
        for begin in range(0, len(ahead), most):
            found = np.flatnonzero(_KIND[ahead[begin : begin + most]] == _SPLIT)
            if len(found):
                break
        else:
            break
        end = start + most + begin + int(found[0]) + 1
        yield text[start:end]
        start = end
    yield text[start:]


def runs_of(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, Runs]]:
    """The runs of a task's texts, by language, some ``GROUP`` bytes at a time."""
    powers = Powers()
    for batch in text_groups(batches, GROUP, "text"):
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column("text").filter(pc.equal(langs, lang))
            if len(texts) == 1 and pc.binary_length(texts)[0].as_py() > 2 * GROUP:
                for piece in pieces(texts.cast(pa.binary())[0].as_py(), GROUP):
                    yield lang, Runs(pa.array([piece], pa.binary()), lang, powers, longest)
            else:
                yield lang, Runs(texts.cast(pa.binary()), lang, powers, longest)


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; ``cells`` is a power of two up to 2^32."""
    return (hashes >> np.uint64(32 * row)) & np.uint64(cells - 1)


def sketched(batches: Iterator[pa.RecordBatch], longest: int, cells: int) -> Iterator[pa.RecordBatch]:
    """row, block, packed: the cells that a task's runs touch, with their counts, by blocks."""
    held: list[np.ndarray] = []
    packer = zstandard.ZstdCompressor(level=1)

    def flushed() -> Iterator[pa.RecordBatch]:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        for row in range(ROWS):
            at = cells_of(hashes, row, cells)
            order = np.argsort(at, kind="stable")
            at, counts = at[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            counts, at = np.minimum(np.add.reduceat(counts, new), FULL).astype(np.uint8), at[new].astype(np.int64)
            cuts = np.searchsorted(at, np.arange(0, cells + BLOCK, BLOCK))
            blocks, packed = [], []
            for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    steps = np.diff(at[a:b] - block * BLOCK, prepend=0).astype(np.uint32)
                    blocks.append(block), packed.append(packer.compress(np.uint32(b - a).tobytes() + steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["row", "block", "packed"])

    size = 0
    for _, runs in runs_of(batches, longest):
        found = np.concatenate([h[w] for h, w in zip(runs.hashes, runs.whole, strict=True)])
        if len(found):
            held.append(found)
            size += len(found)
        if size > HELD:
            yield from flushed()
            size = 0
    if held:
        yield from flushed()


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """row, block, bits: the sum of each block's counts, told as whether it reaches ``least``; rows come sorted by row and block."""
    now, total = None, np.zeros(BLOCK, np.uint8)
    unpacker = zstandard.ZstdDecompressor()

    def done() -> pa.RecordBatch:
        bits = np.packbits(total >= min(least, FULL), bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary())], names=["row", "block", "bits"])

    for batch in batches:
        for row, block, packed in zip(*(batch.column(n) for n in ("row", "block", "packed")), strict=True):
            if now != (row.as_py(), block.as_py()):
                if now is not None:
                    yield done()
                now = (row.as_py(), block.as_py())
                total[:] = 0
            raw = unpacker.decompress(packed.as_py())
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T).view(np.uint32).ravel()
            at = np.cumsum(steps, dtype=np.int64)
            total[at] = np.minimum(total[at] + np.frombuffer(raw, np.uint8, n, 4 + 4 * n), FULL)  # 254 at most before
    if now is not None:
        yield done()


class Sketch:
    """Which cells reach the least count, one bit each."""

    def __init__(self, cells: int, blocks: list[tuple[int, int, bytes]]):
        self.cells, self.bits = cells, np.zeros((ROWS, cells // 8), np.uint8)
        for row, block, bits in blocks:
            here = self.bits[row, block * BLOCK // 8 : (block + 1) * BLOCK // 8]
            here[:] = np.frombuffer(bits, np.uint8)[: len(here)]

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for row in range(ROWS):
            at = cells_of(hashes, row, self.cells)
            out &= (self.bits[row, at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


class Counted:
    """Runs with their counts, summed up now and then, and the words that they are made of."""

    def __init__(self, longest: int):
        self.longest, self.langs = longest, {}
        self.clear()

    def clear(self) -> None:
        #: Hashes of runs, counts, hashes of words, words and language of each run, as lists of arrays.
        self.held: list[list[np.ndarray]] = [[], [], [], [], []]
        self.names: dict[int, bytes] = {}
        self.all_words: dict[str, int] = {}
        self.size = self.n_bytes = 0

    def take(self, lang: str, k: int, hashes: np.ndarray, starts: np.ndarray, runs: Runs) -> None:
        """Count runs of ``k`` words that begin at the words ``starts``."""
        found, first, n = np.unique(hashes, return_index=True, return_counts=True)
        at = starts[first]
        words = np.zeros((len(found), self.longest), np.uint64)
        for j in range(k):
            words[:, j] = runs.words[at + j]
        if k == 1:
            for h, start in zip(words[:, 0].tolist(), at.tolist(), strict=True):
                if h not in self.names:
                    self.names[h] = name = runs.word(start)
                    self.n_bytes += len(name)
        lang_no = self.langs.setdefault(lang, len(self.langs))
        for column, values in zip(self.held, (found, n.astype(np.int32), words, np.full(len(found), k, np.int8), np.full(len(found), lang_no, np.int16)), strict=True):
            column.append(values)
        self.size += len(found)
        if self.size > 2 * PHRASES:
            self._sum()

    def _sum(self) -> None:
        found, first, at = np.unique(np.concatenate(self.held[0]), return_index=True, return_inverse=True)
        self.held[0] = [found]
        self.held[1] = [np.bincount(at, np.concatenate(self.held[1]), len(found)).astype(np.int32)]
        for c in (2, 3, 4):  # one after the other, so that little is held twice
            self.held[c] = [np.concatenate(self.held[c])[first]]
        self.size = len(found)

    @property
    def full(self) -> bool:
        return self.size > PHRASES and len(self.held[0]) == 1 or self.n_bytes > NAME_BYTES

    def out(self) -> Iterator[pa.RecordBatch]:
        """lang, size, key, n: counts by the hashes of a run's words; size 0 counts all words; size -1 gives a word behind its hash."""
        langs = pa.array([*self.langs, ""], pa.string())
        if self.held[0]:
            self._sum()
            _, n, words, k, lang = (column[0] for column in self.held)
            order = np.argsort(k, kind="stable")
            n, words, k, lang = n[order].astype(np.int64), words[order], k[order].astype(np.int32), lang[order].astype(np.int32)
            raw = b"".join(words[a:b, :size].astype(">u8").tobytes() for size in range(1, self.longest + 1) for a, b in [np.searchsorted(k, [size, size + 1])])
            offsets = np.concatenate([[0], np.cumsum(8 * k.astype(np.int64))]).astype(np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield from pa.Table.from_arrays([langs.take(pa.array(lang)), pa.array(k), keys, pa.array(n)], names=COUNTED).to_batches(max_chunksize=100_000)
        rest = [(x, 0, b"", n) for x, n in self.all_words.items()] + [("", -1, h.to_bytes(8, "big") + name, 1) for h, name in self.names.items()]
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        yield from pa.Table.from_arrays([pa.array([r[c] for r in rest], kind) for c, kind in enumerate(kinds)], names=COUNTED).to_batches(max_chunksize=100_000)
        self.clear()


COUNTED = ["lang", "size", "key", "n"]


def counted(batches: Iterator[pa.RecordBatch], longest: int, sketch: Sketch) -> Iterator[pa.RecordBatch]:
    """lang, size, key, n: exact counts of the runs that the sketch lets through, summed in the task."""
    counts = Counted(longest)
    for lang, runs in runs_of(batches, longest):
        counts.all_words[lang] = counts.all_words.get(lang, 0) + len(runs.starts)
        shorter = None
        for k, (hashes, whole) in enumerate(zip(runs.hashes, runs.whole, strict=True), 1):
            passed = whole.copy()
            if shorter is not None:
                passed &= shorter[: len(passed)] & shorter[1 : len(passed) + 1]
            passed[passed] = sketch.frequent(hashes[passed])
            at = np.flatnonzero(passed)
            counts.take(lang, k, hashes[at], at, runs)
            shorter = passed
        if counts.full:
            yield from counts.out()
    yield from counts.out()


def phrase_counts(scratch: Scratch, texts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, key, n of every run of one to ``longest`` words with at least ``least`` occurrences, of size 0 for all words of a language, of size -1 for words by their hashes.

    A key holds eight bytes for each word. ``texts`` has the columns ``lang`` and ``text``, without nulls.
    """
    spark = texts.sparkSession
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cells = FEWEST_CELLS
    while cells < min(MOST_CELLS, n_bytes // BYTES_A_CELL):
        cells *= 2
    touched = texts.mapInArrow(lambda b: sketched(b, longest, cells), "row int, block int, packed binary")
    blocks = touched.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(lambda b: merged(b, least), "row int, block int, bits binary")
    bits = scratch.settle(blocks, "sketch", rows=64)
    shared = spark.sparkContext.broadcast(Sketch(cells, [tuple(r) for r in bits.collect()]))  # ROWS * MOST_CELLS bits at most
    exact = texts.mapInArrow(lambda b: counted(b, longest, shared.value), "lang string, size int, key binary, n long")
    exact = exact.groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") <= 0))
    return scratch.settle(exact, "counts")


def collocations(
    df: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language, by score, occurrences and phrase."""
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur")
    scratch = Scratch(df.sparkSession, "collocations")
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = phrase_counts(scratch, texts, longest, least)
    phrases = counts.where("size >= 2").select("lang", "key", "size", F.col("n").alias("a"))
    run = lambda start, n: F.substring("key", 8 * start - 7, 8 * n)  # noqa: E731  (words from 1)

    # both parts of every cut meet their counts in one join
    cuts = phrases.select("lang", "key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = [F.struct(F.lit(True).alias("first"), run(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))]
    sides = cuts.select("lang", "key", "a", "k", F.explode(F.array(*parts)).alias("p")).select("lang", "key", "a", "k", "p.first", "p.part")
    sides = sides.join(counts.where("size >= 1").select("lang", F.col("key").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    sides = scratch.settle(sides.drop("part"), "sides")
    cut = sides.groupBy("lang", "key", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    big = "CAST({0} AS DECIMAL(19, 0)) * CAST({1} AS DECIMAL(19, 0))".format
    scored = cut.withColumn("score", F.expr(f"({SCALE} * ({big('a', 'a')})) div ({big('l', 'r')})"))
    lowest = scored.groupBy("lang", "key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.where("size > 2").select("lang", "key", "size", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "key", "a", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", run(F.col("at"), F.col("m")).alias("key")).agg(F.max("a").alias("longer"))
    left = lowest.join(inner, ["lang", "key"], "left").where(f"longer IS NULL OR 100 * longer < {cover} * a")
    left = scratch.settle(left.select("lang", "key", "a", "cut.l", "cut.r", "cut.score"), "left")

    # words decide between equal scores and counts only, so what is far behind gets none
    order = [F.desc("score"), F.desc("a")]
    ahead = lambda df, *by: df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    first = scratch.settle(ahead(ahead(left.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))), "lang", "part"), "lang").drop("part"), "first")
    names = counts.where("size = -1").select(F.substring("key", F.lit(1), F.lit(8)).alias("word"), F.decode(F.substring("key", F.lit(9), F.octet_length("key")), "UTF-8").alias("name"))
    words = first.select("lang", "key", F.explode(F.sequence(F.lit(1), (F.octet_length("key") / 8).cast("int"))).alias("at")).withColumn("word", run(F.col("at"), F.lit(1)))
    named = words.join(names, "word").groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("w"))
    phrase = F.array_join(F.transform("w", lambda x: x["name"]), " ")
    best = first.join(named.select("lang", "key", phrase.alias("phrase")), ["lang", "key"])
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))).where(F.col("rank") <= top)
    all_words = counts.where("size = 0").select("lang", "n")
    return best.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of two and three words of each language of ``documents`` that stand together most."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
runs AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND n >= {LEAST}),
cut AS (SELECT lang, k, phrase, a, place, array_to_string(s[1:place], ' ') AS x, array_to_string(s[place + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS place FROM c)),
scored AS (SELECT cut.lang, cut.phrase, a, place, l.n AS l, r.n AS r, {SCALE}::HUGEINT * a * a // (l.n::HUGEINT * r.n) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x AND l.k = place JOIN f r ON r.lang = cut.lang AND r.phrase = y AND r.k = cut.k - place),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (
  SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < {COVER} * lowest.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= {TOP}"""
