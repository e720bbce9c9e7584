"""Piece encoding and decoding, exactly as the sentencepiece library does for BPE models.

Encoding keeps, for every prefix of a text, the unique last token of that prefix's
encoding. An automaton lists the tokens that end at each position; token ``t`` is the
last token of a prefix if ``t`` may follow the last token of the prefix before it, that
is, if the two tokens side by side are what merging makes of their own text. The ids
are then read backwards from the end.

No token of such a model has a word mark after another character, and none holds a
character that the model spells in bytes, so a text falls into independent words; a
bounded cache keeps the encodings of words seen before.

Nulls count as empty texts; an empty text has only the end id and decodes to "". Rows that
repeat are coded alike, columns of the two new names are replaced, an empty table gives an
empty one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import small_batches, table, text_groups

MARK = "▁"
CACHE_WORDS = 200_000
GROUP = 1_000_000  #: bytes of texts that are coded at a time
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNSET, SPELT = -1, -2  #: last tokens: none yet; a character that is spelt in bytes, behind which an encoding begins anew


class Encoded(dict):
    """Packed ids of words, worked out when first asked for; the words of the last ``CACHE_WORDS`` or more are kept."""

    def __init__(self, model: PieceBpe):
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = np.array(self.model.word(word), dtype=np.int32).tobytes()
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class PieceBpe:
    """A BPE piece model with byte fallback, read from a sentencepiece model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        if any(p.type in (USER, UNUSED) for p in proto.pieces) or not trainer.byte_fallback:
            raise ValueError("only models with byte fallback and without user-defined or unused pieces are supported")
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans words")
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.out = []
        for p in proto.pieces:
            if p.type == NORMAL:
                self.out.append(p.piece.replace(MARK, " ").encode())
            elif p.type == BYTE:
                self.out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.out.append(b"" if p.type == CONTROL else " ⁇ ".encode())
        self.marked = {i for i, p in enumerate(proto.pieces) if p.type == NORMAL and p.piece.startswith(MARK)}
        self.chars = {c for p in self.ids for c in p}
        self.automaton = ahocorasick.Automaton()
        self.pieces = [p.piece for p in proto.pieces]
        for piece, k in self.ids.items():
            self.automaton.add_word(piece, (k, len(piece)))
        self.automaton.make_automaton()
        self.line_splits = "\n" not in self.chars
        self._follows: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._encoded = Encoded(self)
        self._length = np.array([len(x) for x in self.out], dtype=np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._bytes = np.frombuffer(b"".join(self.out), dtype=np.uint8)

    def merged(self, text: str) -> list[str]:
        """Merge by definition: the best-scored adjacent pair first, the leftmost among equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def alone(self, k: int) -> bool:
        """Whether a token is the encoding of its own text."""
        if (known := self._alone.get(k)) is None:
            known = self._alone[k] = self.merged(self.pieces[k]) == [self.pieces[k]]
        return known

    def may_follow(self, before: int, k: int) -> bool:
        """Whether two tokens side by side are the encoding of their own text."""
        if len(self._follows) > 4 * CACHE_WORDS:
            self._follows.clear()
        pair = [self.pieces[before], self.pieces[k]]
        known = self._follows[before * len(self.pieces) + k] = self.merged("".join(pair)) == pair
        return known

    def word(self, word: str) -> list[int]:
        """The ids of an independent stretch of text, by the table of last tokens.

        Matches come in the order of their ends, so that what a token may follow is known.
        """
        last = [UNSET] * (len(word) + 1)
        if not self.chars.issuperset(word):
            for end, c in enumerate(word, 1):
                if c not in self.ids:
                    last[end] = SPELT
        follows, size = self._follows, len(self.pieces)
        for end, (k, length) in self.automaton.iter(word):
            end += 1
            if last[end] != UNSET:
                continue
            before = last[end - length] if end > length else SPELT
            if before >= 0:
                fits = follows.get(before * size + k)
                if fits is None:
                    fits = self.may_follow(before, k)
            else:
                fits = before == SPELT and self.alone(k)
            if fits:
                last[end] = k
        out: list[int] = []
        at = len(word)
        while at:
            k = last[at]
            if k < 0:
                out += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
                at -= 1
            else:
                out.append(k)
                at -= len(self.pieces[k])
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """The ids of a text without the end id, as little-endian 32-bit integers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        lines = marked.split("\n") if self.line_splits else [marked]
        newline = np.array([self.byte_ids[10]], dtype=np.int32).tobytes()
        out: list[bytes] = []
        for k, line in enumerate(lines):
            if k:
                out.append(newline)
            out += map(self._encoded.__getitem__, WORDS.findall(line))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.append(np.frombuffer(self.packed(text or ""), dtype=np.int32), np.int32(self.end_id))

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of lists of ids, one after the other; the mark that encoding put in front is taken away."""
        length = self._length[ids]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self._start[ids] - (ends - length), length)
        raw, place = self._bytes[at].tobytes(), np.concatenate([[0], ends])
        out = []
        for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            first = start
            while first < stop and not length[first]:
                first += 1
            skip = 1 if first < stop and int(ids[first]) in self.marked else 0
            out.append(raw[int(place[start]) + skip : int(place[stop])].decode("utf-8", errors="replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0]


_loaded: dict[str, PieceBpe] = {}


def loaded(path: str) -> PieceBpe:
    """The model of this process; vocabulary files are installed alike on every machine."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = PieceBpe(f.read())
    return _loaded[path]


def encode_documents(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded_text") -> DataFrame:
    """Add the ids of ``text`` (array of int, end id last) and the text decoded from those ids.

    Every row is kept, with all its columns; columns of the two new names are replaced.
    Nulls count as "". One narrow pass: no shuffle, state bounded by the word cache.
    """
    small_batches(df.sparkSession)
    df = df.drop(ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_path)
        for batch in text_groups(batches, GROUP, text):
            coded = [model.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
            ids_of = np.concatenate(coded) if coded else np.array([], np.int32)
            values, texts = pa.array(ids_of), pa.array(model.decode_all(ids_of, offsets), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values), texts], names=[*batch.schema.names, ids, decoded]
            )

    return df.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, model_path or default_model())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )
