"""Removal of repeated passages, by compaction of a de Bruijn graph of word windows.

Windows of 13 words are the edges of a de Bruijn graph whose nodes are runs of 12. Only
edges that may repeat are made: a window's anchor is the least hash among its runs of
five words, equal windows have equal anchors, and a window whose anchor stands in one
document only repeats nowhere else.

Edges that follow each other in every document in which either occurs form a nonbranching
path. Such paths are compacted by joins on source coordinates: the source of an edge is
its first occurrence in the document of the smallest id, edges of a path have consecutive
sources, and that all their occurrences agree shows in hashes over these. A join of each
edge with the one before it tells the links; further joins, over stretches of twice the
length each time, put linked pieces together. A path is then one row with its source, its
length and the starts of its occurrences, and each occurrence is verified against the
words at the source before anything is removed.

Anchors and windows that have many rows in one batch of documents are hot: these are
dealt to many tasks, which tell partial sums, and a second pass brings these together.

A word is removed if a window covers it that also starts in a document of a smaller id;
windows are those of the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; nulls and
blank texts have none. Rows without an id lose and remove nothing. Rows that repeat an id are versions of one document: they do not
remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import NUMBER_ROWS, Powers, Scratch, dealt, hot_rows, ids_repeat, mixed, salts, sliding, small_batches, table, text_groups, windows, word_hashes

WINDOW_WORDS = 13
ANCHOR_WORDS = 5
LISTED = 64  #: occurrences in a row, so that those of a common path can be dealt to many tasks


def _whole(rows: np.ndarray, k: int) -> np.ndarray:
    """Whether the ``k`` words from each on are of one row."""
    return rows[: len(rows) - k + 1] == rows[k - 1 :] if len(rows) >= k else np.zeros(0, dtype=bool)


def _anchors(k: int, q: int, deal: bool):
    """Places of the least run of ``q`` words in some window (all, where several are equal): key, salt, doc, pos.

    A hot key keeps a row of two documents, by which its task sees that it stands in several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, span = Powers(), k - q + 1
        for batch in text_groups(batches):
            h, rows, firsts = word_hashes(batch.column(1), powers)
            whole = _whole(rows, k)
            if not whole.any():
                continue
            runs_of = windows(h, q)
            least = np.where(whole, sliding(runs_of, span, np.minimum), np.uint64(0))
            pad = np.zeros(span - 1, dtype=np.uint64)
            at = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), span, np.maximum) == runs_of) & (runs_of > 0))
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            key, doc = runs_of[at].view(np.int64), docs[rows[at]]
            hot = hot_rows(key, doc, 2) if deal else np.zeros(len(key), dtype=bool)
            columns = [key, salts(hot, doc), doc, (at - firsts[rows[at]]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "salt", "doc", "pos"])

    return run


def _in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and doc, those whose key stands in several documents.

    Only rows of a key's first document wait to be told, so that the most common key
    takes no more memory than a document.
    """
    key, first, told = None, None, False
    waiting: list[np.ndarray] = []
    for batch in batches:
        keys, docs, places = (c.to_numpy() for c in batch.columns)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        firsts = docs[starts].copy()
        ends = np.append(starts[1:], len(keys)) - 1
        goes_on = key is not None and keys[0] == key
        if goes_on:
            firsts[0] = first
        several = docs[ends] != firsts
        keep = several[run_of]
        out_docs, out_places = [docs[keep]], [places[keep]]
        if waiting and goes_on and several[0] and not told:
            out_places.append(np.concatenate(waiting))
            out_docs.append(np.full(len(out_places[-1]), first, dtype=np.int64))
        if not goes_on or several[0] or len(starts) > 1:
            waiting = []
        last = len(starts) - 1
        was_told = told if goes_on and last == 0 else False
        key, first, told = keys[-1], firsts[last], was_told or bool(several[last])
        if not told:
            waiting.append(places[starts[last] :])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_docs)), pa.array(np.concatenate(out_places))], names=["doc", "pos"])


def _edges(k: int, q: int, deal: bool):
    """Windows whose anchor is among the places of the row: key, salt, mark, doc, pos.

    All rows of a hot key are dealt out; a row with a mark tells the task of the key itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, span = Powers(), k - q + 1
        for batch in text_groups(batches):
            h, rows, firsts = word_hashes(batch.column(1), powers)
            whole = _whole(rows, k)
            if not whole.any():
                continue
            runs_of = windows(h, q)
            held = batch.column(2)
            owner = np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            places = held.flatten().to_numpy(zero_copy_only=False) + firsts[owner]
            places = places[(places < firsts[owner + 1]) & (places < len(runs_of))]  # else of a row that repeats the id
            known = np.full(len(runs_of), np.iinfo(np.uint64).max, dtype=np.uint64)
            known[places] = runs_of[places]
            at = np.flatnonzero(whole & (sliding(known, span, np.minimum) == sliding(runs_of, span, np.minimum)))
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            key, doc, pos = windows(h, k)[at].view(np.int64), docs[rows[at]], (at - firsts[rows[at]]).astype(np.int32)
            hot = hot_rows(key, doc, 0) if deal else np.zeros(len(key), dtype=bool)
            told = np.unique(key[hot])
            none = np.zeros(len(told), dtype=np.int32)
            columns = [(key, told), (salts(hot, doc), none), (np.zeros(len(key), np.int32), none + 1), (doc, none.astype(np.int64)), (pos, none)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.astype(y.dtype), y])) for x, y in columns], names=["key", "salt", "mark", "doc", "pos"])

    return run


def _place(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mixed(mixed(docs.astype(np.uint64)) + places.astype(np.int64).astype(np.uint64))


EDGE_ROW = "source long, at int, n long, here long, before long, docs array<bigint>, places array<int>, key long, top long"


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by key, salt, mark (marked rows first), doc and pos: edges, or partial sums of hot ones.

    Rows of a hot key have its ``key``: partial sums with its largest document ``top``, and all its occurrences.
    """
    apart: list[pa.RecordBatch] = []
    last: tuple | None = None
    open_ = False

    def partial(key: np.ndarray, salt: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
        ends = np.append(starts[1:], len(key))
        here = np.bitwise_xor.reduceat(_place(doc, pos), starts).view(np.int64)
        before = np.bitwise_xor.reduceat(_place(doc, pos - 1), starts).view(np.int64)
        pieces = -(-(ends - starts) // LISTED)
        sizes = np.full(int(pieces.sum()), LISTED)
        sizes[np.cumsum(pieces) - 1] = (ends - starts) - (pieces - 1) * LISTED
        offsets, m, n = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), len(sizes), len(starts)
        names = ["source", "at", "n", "here", "before", "docs", "places", "key", "top"]
        numbers = [pa.array(x) for x in (doc[starts], pos[starts], (ends - starts).astype(np.int64), here, before)]
        apart.append(pa.RecordBatch.from_arrays([*numbers, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.array(key[starts]), pa.array(doc[ends - 1])], names=names))
        empty = [pa.nulls(m, x.type) for x in numbers]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (doc, pos)]
        apart.append(pa.RecordBatch.from_arrays([*empty, *lists, pa.array(np.repeat(key[starts], pieces)), pa.nulls(m, pa.int64())], names=names))

    def together() -> Iterator[pa.RecordBatch]:
        nonlocal last, open_
        for batch in batches:
            key, salt, mark, doc, pos = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            new = np.concatenate([[(key[0], salt[0]) != last], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            group = np.cumsum(new)  # 0: goes on from the batch before
            opened = np.zeros(group[-1] + 1, dtype=bool)
            opened[0] = open_
            opened[group[(mark > 0) | (salt > 0)]] = True
            last, open_ = (key[-1], salt[-1]), bool(opened[group[-1]])
            apart_now = opened[group] & (mark == 0)
            if apart_now.any():
                partial(key[apart_now], salt[apart_now], doc[apart_now], pos[apart_now])
            closed = ~opened[group]
            yield pa.RecordBatch.from_arrays([pa.array(x[closed]) for x in (key, doc, pos)], names=["key", "doc", "pos"])

    for out in _sources(together()):
        none = pa.nulls(out.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*out.columns, none, none], names=[*out.schema.names, "key", "top"])
        yield from apart
        apart.clear()
    yield from apart


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by key, doc and pos: a row for each repeated edge, and rows with its later occurrences.

    ``here`` and ``before`` are hashes over the places of all occurrences and over the
    places just before them. Occurrences go out as they come, so that an edge that stands
    in a third of all documents takes no memory.
    """
    names = ["source", "at", "n", "here", "before", "docs", "places"]
    key, row = None, None
    state: list = []  # source, at, n, here, before, several

    def edge_rows(rows: list[tuple]) -> list[pa.Array]:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return [pa.array(np.array(c), t) for c, t in zip(cols, kinds, strict=True)]

    for batch in batches:
        keys, docs, places = (c.to_numpy() for c in batch.columns)
        if not len(keys):
            continue
        fresh = np.ones(len(keys), dtype=bool)  # rows that repeat an id and its text
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])
        fresh[0] = (keys[0], docs[0], places[0]) != row
        row = (keys[-1], docs[-1], places[-1])
        keys, docs, places = keys[fresh], docs[fresh], places[fresh]
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        source, at, n = docs[starts].copy(), places[starts].copy(), (ends - starts).astype(np.int64)
        here = np.bitwise_xor.reduceat(_place(docs, places), starts).view(np.int64).copy()
        before = np.bitwise_xor.reduceat(_place(docs, places - 1), starts).view(np.int64).copy()
        several = docs[ends - 1] != source
        done: list[tuple] = []
        if key is not None and keys[0] == key:
            source[0], at[0] = state[0], state[1]
            n[0] += state[2]
            here[0] ^= state[3]
            before[0] ^= state[4]
            several[0] = docs[ends[0] - 1] != source[0]
        elif key is not None and state[5]:
            done.append(tuple(state[:5]))
        later = docs != np.repeat(source, ends - starts)
        counts = np.add.reduceat(later.astype(np.int64), starts)
        some = np.flatnonzero(counts)
        pieces = -(-counts[some] // LISTED)
        sizes = np.full(int(pieces.sum()), LISTED)
        sizes[np.cumsum(pieces) - 1] = counts[some] - (pieces - 1) * LISTED
        some = np.repeat(some, pieces)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        key, state = keys[-1], [source[-1], at[-1], n[-1], here[-1], before[-1], bool(several[-1])]
        whole = np.flatnonzero(several[:-1])
        head = edge_rows(done)
        size = len(done) + len(whole)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([h, pa.array(c[whole], h.type)]) for h, c in zip(head, (source, at, n, here, before), strict=True)] + [pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.list_(pa.int32()))],
            names=names,
        )
        m = len(some)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(source[some]),
                pa.array(at[some]),
                *[pa.nulls(m, pa.int64()) for _ in range(3)],
                pa.ListArray.from_arrays(offsets, pa.array(docs[later])),
                pa.ListArray.from_arrays(offsets, pa.array(places[later])),
            ],
            names=names,
        )
    if key is not None and state[5]:
        yield pa.RecordBatch.from_arrays([*edge_rows([tuple(state[:5])]), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32()))], names=names)


def whole_edges(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (source, at, n, here, before) and their occurrences (source, at, docs, places), hot ones put together."""
    sums = rows.where("key IS NOT NULL AND n IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("source", "at")).alias("first"), F.max("top").alias("top"), F.sum("n").alias("n"), F.bit_xor("here").alias("here"), F.bit_xor("before").alias("before")
    )
    sums = scratch.settle(sums.where("first.source <> top").select("key", "first.source", "first.at", "n", "here", "before"), "hot_edges")
    edge, place = ["source", "at", "n", "here", "before"], ["source", "at", "docs", "places"]
    hot = rows.where("key IS NOT NULL AND docs IS NOT NULL").select("key", "docs", "places").join(sums.select("key", "source", "at"), "key")
    own = rows.where("key IS NULL")
    return own.where("n IS NOT NULL").select(*edge).unionAll(sums.select(*edge)), own.where("docs IS NOT NULL").select(*place).unionAll(hot.select(*place))


def compacted(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Nonbranching paths: ``source``, ``at`` (of the first edge), ``length`` in edges.

    Pieces of a path are joined two by two: in each round a piece that is linked with what
    comes before it, and begins at an odd multiple of the width, is added to the piece that
    ends there. The width doubles from round to round, and at least half of what is left of
    a path goes in each.
    """
    named = edges.select("source", "at", F.xxhash64("here", "n").alias("here"), F.xxhash64("before", "n").alias("before"))
    previous = named.select("source", (F.col("at") + 1).alias("at"), F.col("here").alias("there"))
    linked = named.select("source", "at", "before").join(previous, ["source", "at"], "left")
    pieces = linked.select("source", "at", (F.col("at") + 1).alias("stop"), F.coalesce(F.col("there") == F.col("before"), F.lit(False)).alias("linked"))
    width, turn = 1, 0
    pieces = scratch.settle(pieces, "pieces_0")
    while not pieces.where("linked").isEmpty():
        goes = F.col("linked") & (F.col("at") % (2 * width) == width)
        added = pieces.where(goes).select("source", F.col("at").alias("stop"), F.col("stop").alias("further"))
        grown = pieces.where(~goes).join(added, ["source", "stop"], "left")
        width, turn = 2 * width, turn + 1
        pieces = scratch.settle(grown.select("source", "at", F.coalesce("further", "stop").alias("stop"), "linked"), f"pieces_{turn}")
        scratch.drop(f"pieces_{turn - 1}")
    return pieces.select("source", "at", (F.col("stop") - F.col("at")).alias("length"))


def _digest(words: list[bytes], start: int, length: int, k: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + length + k - 1]), digest_size=16).digest()


def _source_digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ats, lengths, digests = [], [], [], []
            for doc, text, paths in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                for p in paths:
                    docs.append(doc)
                    ats.append(p["at"])
                    lengths.append(p["length"])
                    digests.append(_digest(words, p["at"], p["length"], k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ats, pa.int32()), pa.array(lengths, pa.int32()), pa.array(digests, pa.binary())], names=["source", "at", "length", "digest"]
            )

    return run


def repeated_spans(scratch: Scratch, texts: DataFrame, k: int = WINDOW_WORDS, q: int = ANCHOR_WORDS) -> DataFrame:
    """``doc``, ``spans``: array of (``start``, ``length`` in edges, ``digest`` of the source's words) to remove.

    ``texts``: ``doc`` (long), ``text``.
    """
    spark, deal = texts.sparkSession, not ids_repeat(texts)
    anchors = texts.mapInArrow(_anchors(k, q, deal), "key long, salt int, doc long, pos int")
    several = anchors.repartition("key", "salt").sortWithinPartitions("key", "doc").mapInArrow(dealt(_in_several, ["doc", "pos"]), "doc long, pos int")
    several = scratch.settle(several, "anchors", NUMBER_ROWS)  # texts are held to some bytes a batch by their own passes
    held = several.groupBy("doc").agg(F.collect_list("pos").alias("held"))
    met = texts.join(held.hint("merge"), "doc").mapInArrow(_edges(k, q, deal), "key long, salt int, mark int, doc long, pos int")
    ordered = met.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("mark"), "doc", "pos")
    rows = scratch.settle(ordered.mapInArrow(_edge_rows, EDGE_ROW), "edges", NUMBER_ROWS)
    scratch.drop("anchors")
    edges, occurrences = whole_edges(scratch, rows)
    paths = compacted(scratch, edges)
    per_source = paths.groupBy(F.col("source").alias("doc")).agg(F.collect_list(F.struct("at", "length")).alias("paths"))
    told = texts.join(per_source.hint("merge"), "doc").mapInArrow(_source_digests(k), "source long, at int, length int, digest binary")
    told = scratch.settle(told, "digests")
    starts = told.join(occurrences, ["source", "at"]).select("source", "length", "digest", "docs", "places")
    starts = starts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = starts.select("source", "length", "digest", F.explode(F.arrays_zip("docs", "places")).alias("o")).where("o.docs <> source")
    spans = starts.groupBy(F.col("o.docs").alias("doc")).agg(F.collect_list(F.struct(F.col("o.places").alias("start"), "length", "digest")).alias("spans"))
    spans = scratch.settle(spans, "spans")
    scratch.drop("edges", "hot_edges", "digests")
    return spans


def _keep(k: int, text_at: int, spans_at: int):
    names = ["n_words", "n_removed", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words), dtype=bool)
                for s in spans or ():
                    end = s["start"] + s["length"] + k - 1
                    if end <= len(words) and _digest(words, s["start"], s["length"], k) == s["digest"]:
                        gone[s["start"] : end] = True
                totals.append(len(words))
                removed.append(int(gone.sum()))
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                kept.append(b" ".join(left).decode())
            columns = [c for j, c in enumerate(batch.columns) if j != spans_at]
            old = [x for j, x in enumerate(batch.schema.names) if j != spans_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*old, *names])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.drop("n_words", "n_removed", "kept_text", "_doc", "_spans")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    spans = repeated_spans(scratch, texts, k).select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans"))
    small_batches(spark)
    joined = docs.join(spans.hint("merge"), F.col(doc_id) == F.col("_doc"), "left").drop("_doc")
    names = joined.columns
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["n_words long", "n_removed long", "kept_text string"])
    return joined.mapInArrow(_keep(k, names.index(text), names.index("_spans")), out)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
