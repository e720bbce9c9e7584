"""Removal of repeated byte strings, by distributed prefix doubling.

Positions are ranked by the text that starts at them, at growing lengths: two positions
have one rank at length 2h if the pairs of their ranks at h and of the ranks h further on
agree. Spark sorts the positions by these pairs; positions of a rank of their own are
dropped, as nothing longer from there repeats, and positions are done when what is ranked
is past the length that every match must reach.

Lengths are counted in phrases, not bytes, and only phrase starts are positions: a start
is a place whose hash of 16 bytes is the least in some stretch of 72. Whether a place is a
start depends on the text around it alone, so equal strings are cut into equal phrases,
but for their edges. A string of 400 bytes holds a start 71 to 142 bytes after its own
beginning, its *lead*, and the phrases, two at least, that end in the 168 bytes after it.
The first ranks are those of four phrases, or of all where these are fewer. Strings whose
leads are not of one rank cannot be equal.

Exact matching follows among leads whose rank repeats. All strings of a lead hold its
*core*, 329 bytes at a fixed place around it, so only leads of one core have strings to
compare; the core spans what was ranked. The strings of a lead overlap in one stretch of
text. If two stretches are equal, all their strings are; where leads of one core have
different stretches, their strings are compared one by one, each stretch once.

What has many rows in one batch of documents is hot: it is known to repeat before anything
is shuffled, so two rows stay with their rank, stretch or string, for others to meet, and
the rest, which need to meet none, are dealt to all tasks.

Nulls are empty texts. Rows without an id lose and match nothing. Matches never cross rows; rows that repeat an id are one place each
time they agree. Ranks are named by 64-bit hashes, as ranks that fall together only cost
comparisons; stretches and strings are told apart by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import NUMBER_ROWS, Powers, Scratch, dealt, hot_rows, ids_repeat, mixed, sliding, small_batches, table, text_groups

LENGTH = 400
GRAM = 16
STRETCH = 72
FIRST = 4  #: phrases of the first ranks, if a lead has so many
GROUP = 1_000_000  #: bytes of texts that a task holds at a time
_FACTOR = 0x9E3779B97F4A7C15


def starts_of(gram_hashes: np.ndarray, stretch: int) -> np.ndarray:
    """Places whose hash is the least in some stretch that holds them."""
    least = sliding(gram_hashes, stretch, np.minimum)
    pad = np.zeros(stretch - 1, dtype=np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), stretch, np.maximum)
    return np.flatnonzero(most == gram_hashes)


def phrases(raw: bytes, powers: Powers, length: int, gram: int, stretch: int) -> tuple[np.ndarray, ...]:
    """Of each lead: name of its first phrases, place, bytes from its first string to it (0: it has no string), phrases to be ranked."""
    data = np.frombuffer(raw, np.uint8)
    total, down = powers.sums(data), powers.down
    n = len(data) - gram + 1
    starts = starts_of(mixed((total[gram:] - total[:n]) * down[:n]), stretch)
    reach = length - gram - 3 * stretch
    at = np.arange(len(starts))
    ranked = np.minimum(np.searchsorted(starts, starts + reach, side="right") - 1 - at, 255)
    ends = starts[at + np.minimum(ranked, FIRST)]
    names = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.concatenate([[0], np.maximum(starts[:-1] - stretch + 2, 0)])
    back = np.where(strings_at(starts, first, len(data), length, stretch) > 0, starts - first, 0)
    return names, starts, back, ranked


def strings_at(start: np.ndarray, first: np.ndarray, size: np.ndarray | int, length: int, stretch: int) -> np.ndarray:
    """How many strings from ``first`` on have the lead at ``start``, in a text of ``size`` bytes; none if under 1."""
    return np.minimum(start - stretch + 1, size - length) - first + 1


def spread(hot: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """0 for rows that stay with their key, else a number for each 64 places of a document, as one document may hold most rows of a key."""
    block = mixed(mixed(doc.view(np.uint64)) + (at >> 6).astype(np.uint64))
    return np.where(hot, 1 + (block >> np.uint64(34)).astype(np.int32), 0).astype(np.int32)


def _leads(length: int, gram: int, stretch: int, deal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in text_groups(batches, GROUP):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) < length:
                    continue
                names, start, back, ranked = phrases(raw, powers, length, gram, stretch)
                place = (start.astype(np.int64) << 16) | (back.astype(np.int64) << 8) | ranked
                keep = (ranked >= FIRST) | (back > 0)
                for column, values in zip(out, (names.view(np.int64), np.full(len(names), doc, np.int64), np.arange(len(names), dtype=np.int32), place), strict=True):
                    column.append(values[keep])
            if out[0]:
                rank, doc, idx, place = (np.concatenate(c) for c in out)
                salt = spread(hot_rows(rank, doc, 2, 1) if deal else np.zeros(len(rank), bool), doc, idx)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rank, salt, doc, idx, place)], names=["rank", "salt", "doc", "idx", "place"])

    return run


def _salted(deal: bool):
    """Add ``salt`` behind the first column, the key; the second is the document, the third the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, at = (batch.column(j).to_numpy() for j in range(3))
            salt = spread(hot_rows(key, doc, 2, 1) if deal else np.zeros(len(key), bool), doc, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(salt), *batch.columns[1:]], names=[batch.schema.names[0], "salt", *batch.schema.names[1:]])

    return run


def _repeated(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column those that share the first ``keys`` columns; each once, if they are sorted by all others too."""
    held: list[np.ndarray] | None = None  # of the last value of the first column, the last row of each key
    held_same = np.zeros(0, dtype=bool)
    names: list[str] = []
    for batch in batches:
        names = batch.schema.names
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        known = np.zeros(len(now[0]), dtype=bool)
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            known = np.concatenate([held_same, known])
        one = now[0][1:] == now[0][:-1]
        if any(np.any(one & (c[1:] < c[:-1])) for c in now[1:keys]):
            order = np.lexsort(now[:keys][::-1])
            now, known = [c[order] for c in now], known[order]
        again = np.all([c[1:] == c[:-1] for c in now], axis=0)
        if again.any():
            fresh = np.concatenate([[True], ~again])
            now, known = [c[fresh] for c in now], known[fresh]
        same = np.all([c[1:] == c[:-1] for c in now[:keys]], axis=0)
        known[1:] |= same
        known[:-1] |= same
        stays = np.concatenate([~same, [True]]) & (now[0] == now[0][-1])
        held, held_same = [c[stays] for c in now], known[stays]
        known[stays] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in now], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c[held_same]) for c in held], names=names)


def _whole(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by column ``key``, cut only between two of its values."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[key], now[key][-1]))
        if cut or (parts and parts[-1][key][-1] != now[key][-1]):
            parts.append([c[:cut] for c in now])
            yield [np.concatenate(c) for c in zip(*parts, strict=True)]
            parts.clear()
        parts.append([c[cut:] for c in now])
    if parts:
        yield [np.concatenate(c) for c in zip(*parts, strict=True)]


def block_bits(offset: int) -> int:
    """A document's leads are dealt by every 64 of them, or by twice the phrases that a lead looks ahead; the number's bits."""
    return max(6, offset.bit_length())


def dealt_by_blocks(rows: DataFrame, offset: int) -> DataFrame:
    """Each lead in its block and, where a lead of the block before can ask for it, in that one too; sorted by a hash of document and block."""
    own, before = (F.shiftright(x, block_bits(offset)) for x in (F.col("idx"), F.col("idx") - offset))
    blocks = F.when((before < 0) | (before == own), F.array(own)).otherwise(F.array(own, before))
    rows = rows.select("rank", "doc", "idx", "place", F.explode(blocks).alias("block"))
    return rows.select(F.xxhash64("doc", "block").alias("part"), "*").repartition("part").sortWithinPartitions("part")


def _doubled(offset: int, deal: bool):
    """Of leads dealt by blocks, ranked over ``offset`` phrases: each with the rank that it has over twice as many, or over all it is to be ranked by."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, 0):
            order = np.lexsort((rows[3], rows[5], rows[2]))
            rank, doc, idx, place, block = (c[order] for c in rows[1:])
            new = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
            at = np.cumsum(np.concatenate([[0], new])) << 32 | idx
            # a lead to be ranked over fewer than two lengths more is done with the pair that overlaps
            to = place & 255
            over = to < 2 * offset
            asks = np.flatnonzero((block == idx >> block_bits(offset)) & (~over | (place >> 8 & 255 > 0)))
            then = at[asks] + np.where(over, to - offset, offset)[asks]
            low = np.searchsorted(at, then)
            times = np.searchsorted(at, then, side="right") - low  # above 1 where ids repeat
            one = np.repeat(asks, times)
            two = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(one))
            last = np.where(over, to, -offset)[one].astype(np.uint64)
            rank = rank.view(np.uint64)
            pair = mixed(mixed(rank[one] * np.uint64(_FACTOR) + rank[two]) + last).view(np.int64)
            columns = (pair, doc[one], idx[one], place[one], over[one].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rank", "doc", "idx", "place", "done"])

    return lambda batches: _salted(deal)(pairs(batches))


RANKED = "rank long, doc long, idx int, place long, done int"


def ranked_leads(scratch: Scratch, leads: DataFrame, deal: bool) -> tuple[DataFrame, list[str]]:
    """``doc``, ``place`` of the leads whose text repeats, by doubling; and the tables that hold them."""

    names = [c.split(" ")[0] for c in RANKED.split(", ")]

    def reranked(rows: DataFrame, name: str) -> DataFrame:
        # rows differ unless ids repeat, and Spark sorts by one number much faster
        ordered = rows.repartition("rank", "salt").sortWithinPartitions(*names[: 1 if deal else None])
        return scratch.settle(ordered.mapInArrow(dealt(_repeated, names), RANKED), name, NUMBER_ROWS)

    done = F.col("place").bitwiseAND(F.lit(255)) < FIRST
    offset, tables = FIRST, ["rank_0"]
    current = reranked(leads.select("rank", "salt", "doc", "idx", "place", done.cast("int").alias("done")), "rank_0")
    out = current.where("done = 1").select("doc", "place")
    while offset < 256 and not (onward := current.where("done = 0")).isEmpty():
        pairs = dealt_by_blocks(onward, offset).mapInArrow(_doubled(offset, deal), RANKED.replace(",", ", salt int,", 1))
        offset *= 2
        tables.append(f"rank_{offset}")
        current = reranked(pairs, tables[-1])
        out = out.unionAll(current.where("done = 1").select("doc", "place"))
    return out, tables


REPEATED, OPEN = 1, 2  #: known of a stretch before it is shuffled
MANY_KINDS = 16  #: different stretches of one core in a batch


def _known(core: np.ndarray, stretch: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """What a batch shows of its own stretches: REPEATED for hot stretches, OPEN where a core has many; 0 for two of each and for the rest."""
    kind = mixed(core.view(np.uint64) * np.uint64(_FACTOR) + stretch.view(np.uint64)).view(np.int64)
    out = np.where(hot_rows(kind, docs, 2, 1), REPEATED, 0)
    left = np.flatnonzero(out == 0)
    out[left[hot_rows(core[left], kind[left], 2, MANY_KINDS)]] = OPEN
    return out


def _stretches(length: int, stretch: int, deal: bool):
    """The stretch of text of each lead: hash of its core, hash of the stretch in halves, doc, first string, number of strings."""
    names = ["core", "salt", "known", "stretch", "half", "doc", "first", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, GROUP):
            docs, firsts, counts, cores, pieces = [], [], [], [], []
            held = batch.column(2)
            ends = np.cumsum(held.value_lengths().to_numpy())
            place = held.flatten().to_numpy()
            for doc, text, begin, stop in zip(batch.column(0).to_pylist(), batch.column(1), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                raw = (text.as_py() or "").encode()
                start = place[begin:stop] >> 16
                first = start - (place[begin:stop] >> 8 & 255)
                count = strings_at(start, first, len(raw), length, stretch)
                fits = count > 0  # else of a row that repeats the id
                start, first, count = start[fits], first[fits], count[fits]
                docs.append(np.full(len(start), doc, dtype=np.int64))
                firsts.append(first)
                counts.append(count)
                # what all strings of a lead hold that have it as near to their beginning, and as far from it, as can be
                cores += [xxhash.xxh3_64_intdigest(raw[x - stretch + 1 : x - 2 * stretch + 2 + length]) for x in start.tolist()]
                pieces += [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(first.tolist(), (first + count - 1 + length).tolist(), strict=True)]
            if not pieces:
                continue
            docs, firsts, counts = (np.concatenate(x) for x in (docs, firsts, counts))
            core = np.array(cores, dtype=np.uint64).view(np.int64)
            both = np.frombuffer(b"".join(pieces), np.int64).reshape(-1, 2)
            one, half = both[:, 0].copy(), both[:, 1].copy()
            known = _known(core, one, docs) if deal else np.zeros(len(docs), np.int64)
            columns = [core, spread(known > 0, docs, firsts), known.astype(np.int32), one, half, docs, firsts.astype(np.int32), counts.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_sorted_out`` of stretches of which nothing is known; for the others ``open`` is what is."""
    names = ["doc", "first", "n", "open"]
    apart: list[pa.RecordBatch] = []

    def together() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known").to_numpy()
            some = np.flatnonzero(known)
            part = batch.take(pa.array(some)).select(names[:3])
            apart.append(pa.RecordBatch.from_arrays([*part.columns, pa.array((known[some] == OPEN).astype(np.int32))], names=names))
            yield batch.take(pa.array(np.flatnonzero(known == 0))).select(["core", "stretch", "half", "doc", "first", "n"])

    for out in _sorted_out(together()):
        yield out
        yield from apart
        apart.clear()
    yield from apart


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches sorted by rank, here the core, and stretch: repeated ones (open = 0), and one of each kind where a rank has several (open = 1)."""
    names = ["doc", "first", "n", "open"]
    held: list[np.ndarray] | None = None  # the last row
    held_same, held_new = False, False  # whether it repeats the row before; whether it begins a stretch that is not its rank's first
    lead: tuple | None = None  # first row of the current rank, until it is told as open

    def rows(doc, first, n, is_open) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(np.full(len(doc), is_open, np.int32))], names=names)

    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        fresh = np.ones(len(now[0]), dtype=bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in now], axis=0)
        rank, stretch, half, doc, first, n = (c[fresh] for c in now)
        same_rank = np.concatenate([[held is not None], rank[1:] == rank[:-1]])
        same = np.concatenate([[held_same], (rank[1:] == rank[:-1]) & (stretch[1:] == stretch[:-1]) & (half[1:] == half[:-1])])
        new = same_rank & ~same  # a further stretch of a rank
        new[0] = held_new
        repeated = same.copy()
        repeated[:-1] |= same[1:]
        if held is None:
            lead = (doc[0], first[0], n[0])
        # the first rows of ranks that turn out to have several stretches
        begins = np.flatnonzero(~same_rank)
        extra = []
        bounds = [0, *begins.tolist(), len(rank)] if held is not None else [*begins.tolist(), len(rank)]
        further = np.add.reduceat(np.concatenate([new.astype(np.int64), [0]]), np.minimum(bounds[:-1], len(rank)))
        if held_new and held is not None:
            further[0] -= 1  # told with the batch before
        for at, some in zip(bounds[:-1], further.tolist(), strict=True):
            if held is None or at > 0:
                lead = (doc[at], first[at], n[at])
            if some and lead is not None:
                extra.append(lead)
                lead = None
        if extra:
            yield rows(*zip(*extra, strict=True), 1)
        held, held_same, held_new = [c[-1:] for c in (rank, stretch, half, doc, first, n)], bool(same[-1]), bool(new[-1])
        repeated_last = bool(repeated[-1])
        repeated[-1] = new[-1] = False
        yield rows(doc[repeated], first[repeated], n[repeated], 0)
        yield rows(doc[new], first[new], n[new], 1)
        held_same = repeated_last
    if held is not None:
        if held_same:
            yield rows(*held[3:], 0)
        if held_new:
            yield rows(*held[3:], 1)


def _strings(length: int, deal: bool):
    """Every string of the open stretches: hash in halves, doc, place."""
    names = ["hash", "salt", "half", "doc", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, GROUP):
            hashes, docs, firsts = [], [], []
            for doc, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                first, n = (held.values.field(k).to_numpy() for k in (0, 1))
                places = np.concatenate([np.arange(f, min(f + m, len(raw) - length + 1)) for f, m in zip(first.tolist(), n.tolist(), strict=True)])
                hashes += [xxhash.xxh3_128_digest(raw[at : at + length]) for at in places.tolist()]
                docs.append(np.full(len(places), doc, dtype=np.int64))
                firsts.append(places.astype(np.int32))
            if not hashes:
                continue
            both, doc = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2), np.concatenate(docs)
            one, two, first = both[:, 0].copy(), both[:, 1].copy(), np.concatenate(firsts)
            salt = spread(hot_rows(one, doc, 2, 1) if deal else np.zeros(len(doc), bool), doc, first)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (one, salt, two, doc, first)], names=names)

    return run


def _same_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _repeated(batches, 2)


def repeated_strings(scratch: Scratch, texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc``, ``spans``: strings that occur elsewhere, by the place of the first (times 2 ** 16) and their number. ``texts``: ``doc``, ``text``."""
    deal = not ids_repeat(texts)
    leads = texts.mapInArrow(_leads(length, GRAM, STRETCH, deal), "rank long, salt int, doc long, idx int, place long")
    ranked, tables = ranked_leads(scratch, leads, deal)
    per_doc = ranked.groupBy("doc").agg(F.collect_list("place").alias("leads"))
    row = ["core long", "salt int", "known int", "stretch long", "half long", "doc long", "first int", "n int"]
    stretches = texts.join(per_doc.hint("merge"), "doc").select("doc", "text", "leads").mapInArrow(_stretches(length, STRETCH, deal), ", ".join(row))
    by = ["core", "stretch", "half", "doc", "first", "n"]
    stretches = stretches.repartition("core", "salt").sortWithinPartitions(*by[: 3 if deal else None])
    found = scratch.settle(stretches.mapInArrow(_told, "doc long, first int, n int, open int"), "stretches", NUMBER_ROWS)
    scratch.drop(*tables)
    still_open = found.where("open = 1").groupBy("doc").agg(F.collect_list(F.struct("first", "n")).alias("held"))
    strings = texts.join(still_open.hint("merge"), "doc").select("doc", "text", "held").mapInArrow(_strings(length, deal), "hash long, salt int, half long, doc long, first int")
    by = ["hash", "half", "doc", "first"]
    strings = strings.repartition("hash", "salt").sortWithinPartitions(*by[: 1 if deal else None])
    strings = strings.mapInArrow(dealt(_same_strings, by), "hash long, half long, doc long, first int")
    strings = scratch.settle(strings.select("doc", "first", F.lit(1).alias("n")), "strings", NUMBER_ROWS)
    every = found.where("open = 0").select("doc", "first", "n").unionAll(strings)
    spans = scratch.settle(every.groupBy("doc").agg(F.collect_list(F.shiftleft(F.col("first").cast("long"), 16) + F.col("n")).alias("spans")), "spans")
    scratch.drop("stretches", "strings")
    return spans


def _keep(length: int, text_at: int, spans_at: int):
    names = ["n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, runs_of, kept = [], [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at), strict=True):
                raw = (text.as_py() or "").encode()
                if not spans.is_valid:
                    totals.append(len(raw))
                    removed.append(0)
                    runs_of.append(0)
                    kept.append(raw)
                    continue
                packed = spans.values.to_numpy()
                first = packed >> 16
                end = np.minimum(first + (packed & 65535) - 1 + length, len(raw))
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(edge, first[first < end], 1)
                np.add.at(edge, end[first < end], -1)
                gone = np.cumsum(edge[:-1]) > 0
                totals.append(len(raw))
                removed.append(int(gone.sum()))
                runs_of.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            columns = [c for j, c in enumerate(batch.columns) if j != spans_at]
            old = [x for j, x in enumerate(batch.schema.names) if j != spans_at]
            numbers = [pa.array(x, pa.int64()) for x in (totals, removed, runs_of)]
            yield pa.RecordBatch.from_arrays([*columns, *numbers, pa.array(kept, pa.binary())], names=[*old, *names])

    return run


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "_doc", "_spans")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    spans = repeated_strings(scratch, texts, length).select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans"))
    small_batches(spark)
    joined = docs.join(spans.hint("merge"), F.col(doc_id) == F.col("_doc"), "left").drop("_doc")
    names = joined.columns
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["n_bytes long", "n_removed long", "n_spans long", "kept binary"])
    return joined.mapInArrow(_keep(length, names.index(text), names.index("_spans")), out)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
