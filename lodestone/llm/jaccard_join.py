"""Similarity join of documents on their sets of word shingles, by vertical partitioning.

All shingles stand in one global order, rare ones first; rarity is counted over the whole
corpus in a table of fixed size, so the order is the same for every document and costs no
join. (However large the corpus, what the order has to tell apart are the few shingles
that are far more common than all others; those go last.) Documents of equal sets are one node. Two nodes can only be similar enough if the
first few shingles of both, their prefixes, meet. Where they meet, pairs are ruled out by
size and by the parity of a small bitmap, which bounds the symmetric difference from
below; both filters are exact.

Pairs that are left are verified by vertical partitioning: the global order is cut into
fragments of equal weight, each node's shingles into one segment a fragment; overlaps are
counted in each fragment by itself and summed per pair.

A large group of near copies has a number of pairs that grows with its square, so not all
are looked at. A place where many nodes meet is cut into blocks; a few nodes, its anchors,
stand in every block. First every node is verified against its likeliest partner in its
block and against an anchor or the largest hub of the block; then, among what is still apart,
every pair that the filters leave, of nodes outside the largest component of the place with
all others. Links inside a component that is already known add nothing to it.

Shingles that are common in the whole corpus are dealt to many tasks by node.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Documents of fewer words than a
shingle have one, all their words; null, empty and blank texts have none and are linked
with nothing. Repeated rows are equal sets. Shingles are told apart by 64-bit hashes. Sets
are named by 63-bit hashes; names that sets of different second hashes share are found, and
these sets are named by their second hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import FACTORS, NUMBER_ROWS, SALTS, Hashes, Scratch, components, mixed, runs, table, windows

SHINGLE_WORDS = 5
PERCENT = 80
TABLE_BITS = 20  #: the table of counts has 2 ** TABLE_BITS entries whatever the corpus
CHUNK = 4096
BITMAP = 2048  #: bits of a node's bitmap
LEAST_FILTER, MOST_FILTER = 16, 28  #: bounds of the bits, as a power of two, of the filter of documents to be verified
FRAGMENTS = 8
COMMON, COMMON_TIMES = 256, 32  #: an entry of the table of counts is common if it has more than so many, and so many times the mean
PASSES = 2  #: groups of fragments that are counted one after the other
BLOCK = 512  #: nodes of a meeting place that one task compares with as many others
ANCHORS = 3  #: nodes of a large meeting place that are compared with all others there
NODE_BITS = 63
SEEN = 500_000  #: nodes that a task remembers so as to name each once


def shingle_set(text: str | None, k: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    h = hashes.of(words)
    if len(words) < k:
        return mixed((h * FACTORS[: len(h)]).sum(dtype=np.uint64)[None] + np.uint64(len(h)))
    return np.unique(windows(h, k))


def least_overlap_prefix(n: int, percent: int) -> int:
    """How many of the first of ``n`` shingles a set of similarity ``percent`` must meet."""
    return n - -(-percent * n // 100) + 1


def _sum_of(h: np.ndarray, by: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed((mixed(by + np.uint64(len(h))) * (h | np.uint64(1))).sum(dtype=np.uint64)[None])[0] >> np.uint64(1))


def second_name(h: np.ndarray) -> int:
    """Another 63-bit hash of the members of a set."""
    return _sum_of(h, h ^ np.uint64(0xA5A5A5A55A5A5A5A))


def node_of(h: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """The name of a set: a hash of its sorted members, or the second one where the first is ``shared`` by several sets."""
    name = _sum_of(h, h) >> (63 - NODE_BITS)
    return second_name(h) if name in shared else name


def bitmap_of(h: np.ndarray) -> np.ndarray:
    """Bit j: whether an odd number of members fall on j."""
    odd = np.bincount((h % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _inventory(k: int):
    """One pass over the texts: a row for each document, and the task's share of the table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(), np.zeros(1 << TABLE_BITS, dtype=np.int64)
        names = ["doc", "n", "node", "second", "bitmap", "chunk", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        for batch in batches:
            sets = [shingle_set(t.as_py(), k, hashes) for t in batch.column(1)]
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=1 << TABLE_BITS)
            n = len(sets)
            values = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([second_name(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([bitmap_of(s) for s in sets], kinds[4]),
                pa.nulls(n, kinds[5]),
                pa.nulls(n, kinds[6]),
            ]
            yield pa.RecordBatch.from_arrays(values, names=names)
        chunks = [(j, c) for j in range(len(counts) // CHUNK) if (c := counts[j * CHUNK : (j + 1) * CHUNK]).any()]
        n = len(chunks)
        packed = [zlib.compress(c.astype(np.int32).tobytes(), 1) for _, c in chunks]
        values = [*(pa.nulls(n, kind) for kind in kinds[:5]), pa.array([j for j, _ in chunks], kinds[5]), pa.array(packed, kinds[6])]
        yield pa.RecordBatch.from_arrays(values, names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the shares of a partition, by chunk."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for j, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            share = np.frombuffer(zlib.decompress(data), np.int32).astype(np.int64)
            totals[j] = totals[j] + share if j in totals else share
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int32()), pa.array([zlib.compress(np.minimum(t, 2**31 - 1).astype(np.int32).tobytes(), 1) for t in totals.values()], pa.binary())], names=["chunk", "data"]
    )


class Order:
    """The global order: where each entry of the table of counts ranks, and the fragment it falls in."""

    def __init__(self, counts: np.ndarray):
        by_count = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), dtype=np.uint32)
        self.rank[by_count] = np.arange(len(counts), dtype=np.uint32)
        weight = np.cumsum(counts[by_count])
        total = max(int(weight[-1]), 1)
        self.fragment = np.minimum((weight - counts[by_count]) * FRAGMENTS // total, FRAGMENTS - 1).astype(np.int8)  # by rank
        self.common = int(np.searchsorted(counts[by_count], max(COMMON, COMMON_TIMES * total // len(counts)), side="right"))  # ranks from here on

    def keys(self, h: np.ndarray) -> np.ndarray:
        """The members of a set as sorted positions in the order; no two hashes share one."""
        low = np.uint64(64 - TABLE_BITS)
        key = (self.rank[(h >> low).astype(np.int64)].astype(np.uint64) << low) | (h & ((np.uint64(1) << low) - np.uint64(1)))
        return np.sort(key)

    def fragments(self, keys: np.ndarray) -> np.ndarray:
        return self.fragment[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]


def _prefixes(order: Broadcast, k: int, percent: int, names: frozenset[int]):
    """gram, salt, node of the prefix of every set; common grams are dealt out by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), set()
        for batch in batches:
            grams, nodes = [], []
            for text in batch.column(0):
                h = shingle_set(text.as_py(), k, hashes)
                if not len(h) or (node := node_of(h, names)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                prefix = order.value.keys(h)[: least_overlap_prefix(len(h), percent)]
                grams.append(prefix)
                nodes.append(np.full(len(prefix), node, dtype=np.int64))
            if grams:
                gram, node = np.concatenate(grams), np.concatenate(nodes)
                common = (gram >> np.uint64(64 - TABLE_BITS)) >= np.uint64(order.value.common)
                salt = np.where(common, 1 + node % SALTS, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), salt, node)], names=["gram", "salt", "node"])

    return run


def _met_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_shared`` of rows sorted by gram and node; common grams go out without being looked for in a second node, each node once."""
    names = ["gram", "node"]
    apart: list[pa.RecordBatch] = []
    last: tuple[int, int] | None = None

    def together() -> Iterator[pa.RecordBatch]:
        nonlocal last
        for batch in batches:
            gram, salt, node = (c.to_numpy() for c in batch.columns)
            dealt = salt > 0
            g, x = gram[dealt], node[dealt]
            if len(g):
                fresh = np.concatenate([[(g[0], x[0]) != last], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
                last = (g[-1], x[-1])
                apart.append(pa.RecordBatch.from_arrays([pa.array(g[fresh]), pa.array(x[fresh])], names=names))
            yield pa.RecordBatch.from_arrays([pa.array(gram[~dealt]), pa.array(node[~dealt])], names=names)

    for out in _shared(together()):
        yield out
        yield from apart
        apart.clear()
    yield from apart


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram and node, those whose gram stands in two nodes at least, each once."""
    last: tuple[int, int] | None = None  # the row before, if it may still turn out to be shared
    told = False
    for batch in batches:
        gram, node = (c.to_numpy() for c in batch.columns)
        if not len(gram):
            continue
        if last is not None:
            gram, node = np.append(np.int64(last[0]), gram), np.append(np.int64(last[1]), node)
        fresh = np.ones(len(gram), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, node = gram[fresh], node[fresh]
        same = gram[1:] == gram[:-1]
        keep = np.zeros(len(gram), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        last_told = bool(keep[-1])
        if told:
            keep[0] = False  # it went out with the batch before
            last_told = last_told if len(gram) > 1 else True
        last, told = (int(gram[-1]), int(node[-1])), last_told
        yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(node[keep])], names=["gram", "node"])


def _similar(n: np.ndarray, bits: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Bound from above of the similarity of node i with every node, as a share; 0 where it can't reach the limit."""
    apart = np.bitwise_count((bits ^ bits[i]).view(np.uint64)).sum(axis=1).astype(np.int64)
    both = n + n[i]
    least = np.maximum(apart, np.abs(n - n[i]))
    # |x & y| <= (both - least) / 2 and |x | y| >= (both + least) / 2
    fits = 100 * (both - least) >= percent * (both + least)
    return np.where(fits, (both - least) / (both + least), 0.0)


class Pairs:
    """Pairs of nodes with the best bound of their similarity and the most that a hub met."""

    def __init__(self):
        self.found: dict[tuple[int, int], tuple[float, int]] = {}

    def tell(self, a: int, b: int, share: float, hub: int) -> None:
        pair = (min(a, b), max(a, b))
        known = self.found.get(pair, (0.0, 0))
        self.found[pair] = (max(known[0], share), max(known[1], hub))

    def flush(self) -> pa.RecordBatch:
        rows = [(*pair, *told) for pair, told in self.found.items()]
        self.found.clear()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["a", "b", "share", "hub"])

    def full(self) -> bool:
        return len(self.found) > 20_000


PAIR = "a long, b long, share double, hub int"
ANCHOR_MEETS = 1 << 30  #: an anchor goes before any hub of a block


def _likely(percent: int):
    """Of each node of a block the best partner, and the anchors and the hub of the block where similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Pairs()
        # columns: gram, block, whether an anchor of the place, node, n, bitmap
        for _, _, anchor, node, n, bits in runs(batches, 2):
            members = np.flatnonzero(anchor == 0)
            m, own_bits, own_node = n[members], bits[members], node[members]
            hub, most, hub_share = -1, 0, None
            for i in range(len(members)):
                share = _similar(m, own_bits, i, percent)
                share[i] = 0.0
                if share.any():
                    j = int(share.argmax())
                    out.tell(int(own_node[i]), int(own_node[j]), float(share[j]), 0)
                if (met := int((share > 0).sum())) > most:
                    hub, most, hub_share = i, met, share
                if out.full():
                    yield out.flush()
            if hub >= 0:
                for j in np.flatnonzero(hub_share > 0):
                    out.tell(int(own_node[hub]), int(own_node[j]), float(hub_share[j]), most)
            for a in np.flatnonzero(anchor):
                share = _similar(n, bits, a, percent)
                for j in members[(share[members] > 0) & (own_node != node[a])]:
                    out.tell(int(node[a]), int(node[j]), float(share[j]), ANCHOR_MEETS)
            if out.full():
                yield out.flush()
        yield out.flush()

    return run


def likely_pairs(places: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of nodes of one block of a meeting place, and of nodes and anchors; rows grow with the place, not with its square."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = places.select("gram", F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int").alias("block"), F.lit(0).alias("anchor"), "node", "n", "bitmap")
    one = F.struct("node", "n", "bitmap")
    large = places.where(F.col("size") > BLOCK).groupBy("gram", "size").agg(F.array(*[F.min_by(one, F.xxhash64("node", F.lit(100 + k))) for k in range(ANCHORS)]).alias("a"))
    anchors = large.select("gram", "size", F.explode(F.array_distinct("a")).alias("a")).select("gram", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("anchor"), "a.*")
    cut = rows.unionAll(anchors).repartition("gram", "block").sortWithinPartitions("gram", "block", "anchor", "node")
    found = cut.mapInArrow(_likely(percent), PAIR)
    return found.groupBy("a", "b").agg(F.max("share").alias("share"), F.max("hub").alias("hub"))


def _apart(percent: int):
    """Every pair across components of two blocks of a meeting place, or of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Pairs()
        # columns: gram, first block, second block, own block, node, n, component, bitmap
        for _, first, second, own, node, n, comp, bits in runs(batches, 3):
            crosses = first[0] != second[0]
            for i in np.flatnonzero(own == first[0]):
                share = _similar(n, bits, i, percent)
                share[i] = 0.0
                if crosses:
                    share[own == own[i]] = 0.0
                for j in np.flatnonzero((share > 0) & (comp != comp[i])):
                    out.tell(int(node[i]), int(node[j]), float(share[j]), 0)
                if out.full():
                    yield out.flush()
        yield out.flush()

    return run


def pairs_apart(scratch: Scratch, named: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of nodes that meet and are in different components.

    ``named``: places with the ``component`` of each node. The largest component of a place is
    not compared with itself, so that what is copied grows with what is outside of it.
    """
    counts = named.groupBy("gram", "component").agg(F.count("*").alias("count"))
    tops = counts.groupBy("gram").agg(F.max_by("component", F.struct("count", "component")).alias("top"), F.max("count").alias("inside"), F.sum("count").alias("total"))
    tops = scratch.settle(tops.where("total > inside").select("gram", "top", "inside", (F.col("total") - F.col("inside")).alias("outside")), "tops")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    cut = named.join(tops, "gram").withColumn("is_top", F.col("component") == F.col("top")).withColumn("x", blocks("inside")).withColumn("y", blocks("outside"))
    deal = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    cut = cut.withColumn("own", F.when(F.col("is_top"), deal(F.col("x"))).otherwise(F.col("x") + deal(F.col("y"))))
    last = F.col("x") + F.col("y") - 1
    cut = cut.withColumn("other", F.explode(F.when(F.col("is_top"), F.sequence("x", last)).otherwise(F.sequence(F.lit(0), last))))
    cut = cut.select("gram", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "node", "n", "component", "bitmap")
    sorted_ = cut.repartition("gram", "first", "second").sortWithinPartitions("gram", "first", "second", "node")
    return sorted_.mapInArrow(_apart(percent), PAIR).select("a", "b").distinct()


def best_partners(pairs: DataFrame) -> DataFrame:
    """Of each node the pair with the partner most like it and that with its largest hub."""
    sides = [F.struct(F.col(x).alias("node"), F.col(y).alias("other"), "share", "hub") for x, y in (("a", "b"), ("b", "a"))]
    both = pairs.select(F.explode(F.array(*sides)).alias("p")).select("p.*")
    best = both.groupBy("node").agg(
        F.max(F.struct("share", "other")).alias("like"), F.max(F.struct("hub", "share", "other")).alias("hub")
    )
    chosen = best.select("node", F.explode(F.array("like.other", "hub.other")).alias("other"))
    return chosen.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _filter_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of a partition's hashes, by chunk of the filter."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        for place in np.unique(batch.column(0).to_numpy()).tolist():
            bits.setdefault(place // CHUNK, np.zeros(CHUNK, dtype=np.uint8))[place % CHUNK] = 1
    yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([np.packbits(b).tobytes() for b in bits.values()], pa.binary())], names=["chunk", "data"])


def _places(h: Column, bits: int) -> list[Column]:
    """The two bits of a hash in a filter of 2 ** ``bits``."""
    mask = F.lit((1 << bits) - 1)
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - bits).bitwiseAND(mask)]


def document_filter(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the ids in ``doc`` and its size in bits, as a power of two.

    Some 16 bits for each id, 2 ** MOST_FILTER at most; false positives only cost work.
    """
    bits = min(max((16 * docs.count()).bit_length(), LEAST_FILTER), MOST_FILTER)
    places = docs.select(F.explode(F.array(*_places(F.xxhash64("doc"), bits))).alias("place"))
    chunks = places.repartition(F.floor(F.col("place") / CHUNK)).mapInArrow(_filter_chunks, "chunk int, data binary")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in chunks.toLocalIterator():
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.data, np.uint8)
    return out, bits


def _segments(order: Broadcast, wanted: Broadcast, k: int, names: frozenset[int]):
    """Segments of the documents that the filter lets through: columns text and two places in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), set()
        for batch in batches:
            nodes, parts, segments = [], [], []
            x, y = (batch.column(c).to_numpy() for c in (1, 2))
            bits = wanted.value
            through = ((bits[x >> 3] >> (7 - (x & 7))) & (bits[y >> 3] >> (7 - (y & 7))) & 1).astype(bool)
            for row in np.flatnonzero(through).tolist():
                h = shingle_set(batch.column(0)[row].as_py(), k, hashes)
                if not len(h) or (node := node_of(h, names)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                keys = order.value.keys(h)
                at = order.value.fragments(keys)
                for f in np.unique(at):
                    nodes.append(node)
                    parts.append(int(f))
                    segments.append(keys[at == f].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), pa.array(segments, pa.list_(pa.int64()))], names=["node", "fragment", "segment"])

    return run


def cut_segments(texts: DataFrame, needed: DataFrame, order: Broadcast, k: int, names: frozenset[int]) -> DataFrame:
    """``node``, ``fragment``, ``segment`` of the documents in ``needed``; a few others may come along."""
    found, bits = document_filter(needed)
    wanted = texts.sparkSession.sparkContext.broadcast(found)
    asked = texts.select("text", *[c.alias(f"place{j}") for j, c in enumerate(_places(F.xxhash64("doc"), bits))])
    return asked.mapInArrow(_segments(order, wanted, k, names), "node long, fragment int, segment array<bigint>")


def verified(scratch: Scratch, pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int, name: str) -> DataFrame:
    """``a``, ``b`` of the pairs that are similar enough: overlaps counted in each fragment, then summed.

    Fragments are counted in ``PASSES`` groups, one after the other, so that only a part of the
    segments is on shuffle disks at a time.
    """
    counted = []
    for turn in range(PASSES):
        some = segments.where(F.col("fragment") % PASSES == turn)
        left = pairs.join(some.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("x")), "a")
        right = some.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("y"))
        partial = left.join(right, ["b", "fragment"]).select("a", "b", "fragment", F.size(F.array_intersect("x", "y")).alias("part"))
        # a set may stand in several documents, and so its segments
        part = partial.groupBy("a", "b", "fragment").agg(F.max("part").alias("part")).groupBy("a", "b").agg(F.sum("part").alias("part"))
        counted.append(scratch.settle(part, f"{name}_overlap_{turn}"))
    overlap = counted[0]
    for more in counted[1:]:
        overlap = overlap.unionAll(more)
    overlap = overlap.groupBy("a", "b").agg(F.sum("part").alias("both"))
    n_a, n_b = sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    return overlap.join(n_a, "a").join(n_b, "b").where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "join")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    schema = "doc long, n long, node long, second long, bitmap array<bigint>, chunk int, data binary"
    found = scratch.settle(texts.mapInArrow(_inventory(k), schema), "inventory")
    shares = found.where("chunk IS NOT NULL").select("chunk", "data").repartition("chunk").mapInArrow(_summed, "chunk int, data binary")
    counts = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    for r in shares.collect():  # 2 ** TABLE_BITS counts at most
        counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(zlib.decompress(r.data), np.int32)
    order = spark.sparkContext.broadcast(Order(counts))

    members = found.where("chunk IS NULL").select("doc", "n", "node", "second", "bitmap")
    named = members.where("node IS NOT NULL").groupBy("node").agg(F.min("second").alias("x"), F.max("second").alias("y"))
    # names that several sets share: of n sets about n ** 2 / 2 ** 64
    names = frozenset(r.node for r in named.where("x <> y").select("node").toLocalIterator())
    if names:
        taken = F.broadcast(spark.createDataFrame([(x,) for x in sorted(names)], "node long").withColumn("taken", F.lit(True)))
        members = members.join(taken, "node", "left").withColumn("node", F.when(F.col("taken"), F.col("second")).otherwise(F.col("node"))).drop("taken")
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    nodes = scratch.settle(nodes, "nodes")
    members = scratch.settle(members.select("doc", "n", "node"), "members")
    scratch.drop("inventory")
    index = texts.select("text").mapInArrow(_prefixes(order, k, percent, names), "gram long, salt int, node long")
    index = index.repartition("gram", "salt").sortWithinPartitions("gram", "node")
    shared = scratch.settle(index.mapInArrow(_met_grams, "gram long, node long"), "shared")
    # of meeting places of the same nodes one is enough
    stats = shared.groupBy("gram").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t"))
    chosen = scratch.settle(stats.where("size > 1").groupBy("size", "s", "t").agg(F.min("gram").alias("gram")).select("gram", "size"), "chosen")
    places = shared.join(chosen, "gram").join(nodes.select("node", "n", "bitmap"), "node").select("gram", "size", "node", "n", "bitmap")
    places = scratch.settle(places, "places")
    nodes = scratch.settle(nodes.drop("bitmap"), "named")
    scratch.drop("shared", "nodes", "chosen")

    pairs = scratch.settle(best_partners(likely_pairs(places, percent)), "pairs", NUMBER_ROWS)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc"), "node")
    segments = scratch.settle(cut_segments(texts, needed, order, k, names), "segments")
    sizes = nodes.select("node", "n")
    links = scratch.settle(verified(scratch, pairs, segments, sizes, percent, "first"), "links")
    first = components(scratch, links, "first")
    # what is still apart: every pair that the filters leave
    named = places.join(first.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = scratch.settle(named, "components")
    rest = scratch.settle(pairs_apart(scratch, named, percent).join(pairs, ["a", "b"], "left_anti"), "rest", NUMBER_ROWS)
    # a block names one partner a node, so some nodes have their first pair here and no segments yet
    late = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(needed.select("node"), "node", "left_anti").join(nodes.select("node", "doc"), "node")
    late = scratch.settle(late, "late")
    if not late.isEmpty():
        segments = segments.unionAll(scratch.settle(cut_segments(texts, late, order, k, names), "late_segments"))
    more = scratch.settle(verified(scratch, rest, segments, sizes, percent, "second"), "more")
    last = components(scratch, links.unionAll(more), "last")
    owner = nodes.select("node", F.col("doc").alias("least"))
    classes = owner.join(last.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = scratch.settle(classes.join(top, "component").select("node", "component_id"), "classes")
    scratch.drop("places", "components", "segments", "late_segments", "pairs", "rest")
    return members.join(classes, "node", "left").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents``."""
    return similarity_classes(table(spark, sf_dir, "documents"))
