"""Byte-pair tokens from a vocabulary of ranks, without a tokenizer library.

Texts are cut into pieces by the vocabulary's pattern. A task looks up each distinct piece of a batch of
texts and keeps the ids of the pieces that it has merged, up to a bound; texts are encoded where they are read,
so nothing is shuffled or written for it.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern by which the default encoding cuts texts before it merges bytes.
CL100K_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
#: Pieces whose ids a task keeps, and characters of these at most; what is beyond is merged anew and has the same ids.
FEW_PIECES, KEPT_LENGTH = 200_000, 64
#: Rows of a batch whose tokens are in memory at a time.
SLICE_ROWS = 256

_loaded: dict[str, dict[bytes, int]] = {}


def ranks(vocabulary: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file (lines of a token in base 64 and its rank), loaded once a process."""
    if vocabulary not in _loaded:
        with open(vocabulary, "rb") as lines:
            _loaded[vocabulary] = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return _loaded[vocabulary]


def merged(piece: bytes, known: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of neighbours that make a token together those of the lowest rank merge first, the leftmost of equal ones.

    A heap keeps the pairs, so that long pieces take little more than time in proportion.
    """
    whole = known.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def pair(at: int) -> None:
        right = after[at]
        if right < n:
            rank = known.get(piece[at : end[right]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, end[right]))

    for at in range(n - 1):
        pair(at)
    while heap:
        _, at, stop = heapq.heappop(heap)
        right = after[at] if alive[at] else n
        if right >= n or end[right] != stop:
            continue  # a part of it has merged otherwise
        alive[right] = False
        end[at], after[at] = stop, after[right]
        if after[at] < n:
            before[after[at]] = at
        pair(at)
        if before[at] >= 0:
            pair(before[at])
    out, at = [], 0
    while at < n:
        out.append(known[piece[at : end[at]]])
        at = after[at]
    return out


class Pieces(dict):
    """The ids of pieces that a task has met; those of more than ``FEW_PIECES`` or of long ones are worked out each time."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__()
        self.known = known

    def __missing__(self, piece: str) -> list[int]:
        ids = merged(piece.encode(), self.known)
        if len(self) < FEW_PIECES and len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids

    def encoded(self, texts: pa.ListArray) -> pa.Array:
        """The ids of texts that are given as lists of their pieces."""
        values, ends = texts.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy())
        met = values.dictionary_encode()  # each distinct piece of a batch is looked up once
        ids = [self[p] for p in met.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, sizes.sum())
        at = met.indices.to_numpy()
        starts, lengths = (np.cumsum(sizes) - sizes)[at], sizes[at]
        before = np.cumsum(lengths) - lengths
        out = flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(start, SLICE_ROWS) for batch in batches for start in range(0, batch.num_rows, SLICE_ROWS))


def pieces_of(text: Column, pattern: str = CL100K_PATTERN) -> Column:
    """The pieces of a text in order, none for null; classes of characters are those of Unicode."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0)), F.array().cast("array<string>"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", pattern: str = CL100K_PATTERN) -> DataFrame:
    """``id_col`` and ``ids`` of every row whose text has tokens."""
    cut = docs.select(F.col(id_col), pieces_of(F.col(text), pattern).alias("_pieces")).where(F.size("_pieces") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks(vocabulary))
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pieces.encoded(batch.column(1))], names=[id_col, "ids"])

    return cut.mapInArrow(run, f"`{id_col}` {cut.schema[id_col].dataType.simpleString()}, ids array<int>")


def windows(docs: DataFrame, vocabulary: str, size: int = 512, overlap: int = 64, id_col: str = "doc_id", text: str = "text", pattern: str = CL100K_PATTERN) -> DataFrame:
    """Sliding windows of byte-pair tokens: ``id_col``, ``chunk_index``, ``chunk_tokens``, ``chunk_bytes`` (of the window's tokens), ``chunk_text``.

    A window that cuts a character shows a replacement mark there; its bytes are whole.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("a window has tokens, and more than it shares with the next one")
    stride = size - overlap
    t = encode(docs, vocabulary, id_col, text, pattern)
    last = F.greatest(F.ceil((F.size("ids") - size) / stride), F.lit(0)).cast("int")
    cut = t.select(id_col, "ids", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    cut = cut.select(id_col, "chunk_index", F.slice("ids", F.col("chunk_index") * stride + 1, F.lit(size)).alias("ids"))
    schema = f"`{id_col}` {t.schema[id_col].dataType.simpleString()}, chunk_index int, chunk_tokens int, chunk_bytes binary, chunk_text string"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in ranks(vocabulary).items()}
        for batch in _slices(batches):
            raw = [b"".join(map(token.__getitem__, ids)) for ids in batch.column(2).to_pylist()]
            n = pc.list_value_length(batch.column(2))
            texts = pa.array([r.decode(errors="replace") for r in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(raw, pa.binary()), texts], names=[id_col, "chunk_index", "chunk_tokens", "chunk_bytes", "chunk_text"])

    return cut.mapInArrow(decoded, schema)
