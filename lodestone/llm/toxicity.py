"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters the network as its own vector, if it is frequent enough in the training
sample, beside a vector made of its characters by place. Of a word longer than the places
for characters its parts between inner punctuation follow it, long ones in overlapping
pieces, so that texts without spaces are read whole. Two gated recurrent layers read
a window in either direction, attention pools their states, and a logistic unit scores the
window. A document is scored by the highest of all its overlapping windows, whatever its
length, calibrated on a part of the sample that the network is not fitted to.

Everything is trained here in numpy on at most ``TRAIN_ROWS`` labelled documents of
``TRAIN_BYTES`` bytes together, those whose ids hash lowest. Only documents are labelled, so training chooses windows: those of toxic documents that a count
of words and word beginnings, and later the network itself, finds most telling, against
windows of other documents, the hardest among them.

Null, empty and blank texts have no windows and the score of the calmest window. Without
labelled rows every score is 0. Rows that repeat score alike, rows without an id are never
held out nor learnt from, a column named as the score is replaced, and an empty table gives
an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import small_batches, table

#: Bounds of the labelled sample that the network is trained on: documents, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 5_000, 32_000_000
WINDOW, STRIDE = 32, 16
VOCABULARY, LEAST_DOCUMENTS = 20_000, 4
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 12, 12, 12
CHAR_PLACES, CHAR_KINDS = 10, 128
PIECE_STEP = 5  #: from piece to piece of a long word
EPOCHS, BATCH, RATE = 8, 128, 0.01
WORD_DROPOUT = 0.4
DECAY = 0.05  #: of word and character vectors, so that what is seen once is not learnt by heart
TELLING = 2.0  #: log odds below which a toxic document's window is not trained on as toxic
FIRST_GUESS, MOST_ODDS = 0.25, 6.0  #: word vectors begin with so much of a word's log odds as their first component
CALM = -8.0
CACHE_WORDS = 60_000
CUT = ".,;:!?\"'()[]|*#%&$"
JOINTS = re.compile("[" + re.escape(CUT + "_-/\\+=~<>{}@^`–—…、。，！？；：・（）「」") + "]+")


def tokens(text: str | None) -> list[str]:
    """Words, each followed by its pieces if it is long."""
    out = []
    for t in (text or "").lower().split():
        out.append(t)
        if len(t) > CHAR_PLACES:
            out += pieces(t)
    return out


def pieces(token: str) -> list[str]:
    """What a long word holds beyond its first characters: parts between punctuation, long ones in overlapping pieces."""
    word, out = stem(token), []
    if len(word) <= CHAR_PLACES:
        return out
    for part in filter(None, JOINTS.split(word)):
        last = len(part) - CHAR_PLACES
        if last <= 0:
            out.append(part)
        else:
            starts = [*range(0, last, PIECE_STEP), last]
            out += [part[k : k + CHAR_PLACES] for k in starts[part == word :]]  # the word itself shows its first characters
    return out


def stem(token: str) -> str:
    return token.strip(CUT) or token


def letters(word: str) -> np.ndarray:
    """Kinds of the first characters of a word; 0 behind its end."""
    out = np.zeros(CHAR_PLACES, dtype=np.int64)
    for k, c in enumerate(word[:CHAR_PLACES]):
        out[k] = 1 + ord(c) % (CHAR_KINDS - 1)
    return out


def window_index(n: int) -> np.ndarray:
    """Token places of all windows of ``n`` tokens, -1 behind the end."""
    if not n:
        return np.zeros((0, WINDOW), dtype=np.int64)
    starts = np.arange(0, max(n - STRIDE, 1), STRIDE)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, a forward pass from word features, and a backward pass for training."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {
            "words": (rng.normal(size=(len(vocabulary) + 1, WORD_DIM)) * 0.1).astype(np.float32),
            "chars": (rng.normal(size=(CHAR_PLACES * CHAR_KINDS, CHAR_DIM)) * 0.2).astype(np.float32),
            "wf": init(d, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32), "uf": init(HIDDEN, 3 * HIDDEN),
            "wb": init(d, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32), "ub": init(HIDDEN, 3 * HIDDEN),
            "a": init(2 * HIDDEN, ATTENTION), "a0": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION),
            "o": init(2 * HIDDEN), "o0": np.zeros(1, np.float32),
        }
        self.p["words"][0] = 0
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Word and character vectors; ``ids`` 0 for words out of the vocabulary."""
        places = chars + np.arange(CHAR_PLACES) * CHAR_KINDS
        summed = (self.p["chars"][places] * (chars > 0)[..., None]).sum(axis=-2)
        return np.concatenate([self.p["words"][ids], np.tanh(summed)], axis=-1)

    def projected(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """What both layers take from a word, side by side."""
        x = self.inputs(ids, chars)
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], axis=-1).astype(np.float32)

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        inner = h @ u
        gates = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])))
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, inner[:, 2 * HIDDEN :]

    def states(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both layers; ``x``: windows, places, two projections. Kept for the backward pass if asked."""
        size = len(x)
        out = np.zeros((WINDOW, size, 2 * HIDDEN), dtype=np.float32)
        for side, u, order in ((0, self.p["uf"], range(WINDOW)), (1, self.p["ub"], range(WINDOW - 1, -1, -1))):
            h = np.zeros((size, HIDDEN), dtype=np.float32)
            for t in order:
                m = mask[:, t : t + 1]
                new, z, r, n, inner = self.step(x[:, t, 3 * HIDDEN * side : 3 * HIDDEN * (side + 1)], h, u)
                if keep is not None:
                    keep.append((side, t, m, h, z, r, n, inner))
                h = np.where(m, new, h)
                out[t, :, HIDDEN * side : HIDDEN * (side + 1)] = h
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        u = np.tanh(states @ self.p["a"] + self.p["a0"])
        e = np.where(mask.T, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        context = (share[..., None] * states).sum(axis=0)
        return context @ self.p["o"] + self.p["o0"], u, share, context

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.pooled(self.states(x, mask), mask)[0]

    def gradients(self, ids: np.ndarray, chars: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        x = self.inputs(ids, chars)
        both = np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], axis=-1)
        keep: list = []
        states = self.states(both, mask, keep)
        logit, u, share, context = self.pooled(states, mask)
        d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["o0"] = context.T @ d_logit, d_logit.sum(keepdims=True)
        d_context = d_logit[:, None] * p["o"]
        d_states = share[..., None] * d_context
        d_share = (states * d_context).sum(axis=-1)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        d_u = d_e[..., None] * p["v"] * (1 - u * u)
        g["v"] = (d_e[..., None] * u).sum(axis=(0, 1))
        g["a"], g["a0"] = np.einsum("tbi,tbj->ij", states, d_u), d_u.sum(axis=(0, 1))
        d_states = d_states + d_u @ p["a"].T
        d_both = np.zeros_like(both)
        carry = {0: np.zeros((len(y), HIDDEN), np.float32), 1: np.zeros((len(y), HIDDEN), np.float32)}
        for side, t, m, h, z, r, n, inner in reversed(keep):
            u_name = "uf" if side == 0 else "ub"
            dh = carry[side] + d_states[t, :, HIDDEN * side : HIDDEN * (side + 1)]
            new = np.where(m, dh, 0)
            dz = new * (h - n) * z * (1 - z)
            dn = new * (1 - z) * (1 - n * n)
            dr = dn * inner * r * (1 - r)
            d_inner = np.concatenate([dz, dr, dn * r], axis=1)
            d_both[:, t, 3 * HIDDEN * side : 3 * HIDDEN * (side + 1)] = np.concatenate([dz, dr, dn], axis=1)
            g[u_name] += h.T @ d_inner
            carry[side] = np.where(m, 0, dh) + new * z + d_inner @ p[u_name].T
        flat_x, flat = x.reshape(-1, x.shape[-1]), d_both.reshape(-1, d_both.shape[-1])
        f, b = flat[:, : 3 * HIDDEN], flat[:, 3 * HIDDEN :]
        g["wf"], g["bf"], g["wb"], g["bb"] = flat_x.T @ f, f.sum(axis=0), flat_x.T @ b, b.sum(axis=0)
        dx = f @ p["wf"].T + b @ p["wb"].T
        np.add.at(g["words"], ids.reshape(-1), dx[:, :WORD_DIM])
        g["words"][0] = 0
        d_sum = dx[:, WORD_DIM:] * (1 - flat_x[:, WORD_DIM:] ** 2)
        places = (chars + np.arange(CHAR_PLACES) * CHAR_KINDS).reshape(-1, CHAR_PLACES)
        shown = chars.reshape(-1, CHAR_PLACES) > 0
        for k in range(CHAR_PLACES):
            np.add.at(g["chars"], places[shown[:, k], k], d_sum[shown[:, k]])
        return g


class Words(dict):
    """Rows of a table of projected words, for those met lately; row 0 is behind the end of a text."""

    def __init__(self, network: Network):
        self.network, self.fresh = network, []
        self.rows = np.zeros((1, 6 * HIDDEN), dtype=np.float32)

    def __missing__(self, token: str) -> int:
        self.fresh.append(token)
        found = self[token] = len(self.rows) + len(self.fresh) - 1
        return found

    def place(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        """Project the words met since the last call."""
        if self.fresh:
            stems = [stem(t) for t in self.fresh]
            ids = np.array([self.network.vocabulary.get(s, 0) for s in stems])
            self.rows = np.concatenate([self.rows, self.network.projected(ids, np.array([letters(s) for s in stems]))])
            self.fresh = []

    def trim(self) -> None:
        if len(self.rows) > CACHE_WORDS:
            self.clear()
            self.rows = self.rows[:1]


def document_logits(network: Network, texts: list[str | None], cache: Words, group: int = 2048) -> np.ndarray:
    """The highest logit of the windows of each text; CALM without any."""
    out = np.full(len(texts), CALM)
    at = [cache.place(tokens(t)) for t in texts]
    cache.settle()
    indices, owners = [], []
    for k, places in enumerate(at):
        index = window_index(len(places))
        if len(index):
            indices.append(np.where(index >= 0, places[index], 0))
            owners.append(np.full(len(index), k))
    if indices:
        every, owner = np.concatenate(indices), np.concatenate(owners)
        for start in range(0, len(every), group):
            part = every[start : start + group]
            np.maximum.at(out, owner[start : start + group], network.logits(cache.rows[part], part > 0))
    cache.trim()
    return out


def telling(texts: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """Log odds of words and of word beginnings by the documents that they stand in."""
    counts = (Counter(), Counter())
    for words, label in zip(texts, labels, strict=True):
        counts[int(label)].update({x for w in set(words) for x in (w, *(f"{w[:n]}~" for n in (4, 5, 6) if len(w) > n))})
    n0, n1 = max(int((labels == 0).sum()), 1), max(int((labels == 1).sum()), 1)
    return {w: float(np.log((c + 0.5) / (n1 + 1)) - np.log((counts[0][w] + 0.5) / (n0 + 1))) for w, c in counts[1].items() if c > 2}


def train(sample: list[tuple[str | None, int]], seed: int = 5) -> Network | None:
    """A network fitted to labelled texts; None without both labels."""
    labels = np.array([y for _, y in sample], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    stems: dict[str, str] = {}  # a word is held once however often it stands
    texts = [[stems.get(t) or stems.setdefault(t, stem(t)) for t in tokens(x)] for x, _ in sample]
    aside = np.arange(len(labels)) % 6 == 5  # for calibration only
    seen = Counter(w for words, a in zip(texts, aside, strict=True) if not a for w in set(words))
    vocabulary = {w: k + 1 for k, (w, c) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if c >= LEAST_DOCUMENTS}
    network = Network(vocabulary)
    odds = telling([words for words, a in zip(texts, aside, strict=True) if not a], labels[~aside])
    for word, k in vocabulary.items():
        network.p["words"][k, 0] = FIRST_GUESS * np.clip(odds.get(word, 0.0), 0, MOST_ODDS)
    kinds: dict[str, int] = {}
    coded = [np.array([kinds.setdefault(w, len(kinds) + 1) for w in words], dtype=np.int64) for words in texts]
    names = ["", *kinds]
    id_of = np.array([vocabulary.get(w, 0) for w in names])
    chars_of = np.array([letters(w) for w in names])
    weight = np.array([max(odds.get(w, 0.0), *(odds.get(f"{w[:n]}~", 0.0) for n in (4, 5, 6))) for w in names])
    windows, owner = [], []
    for k, c in enumerate(coded):
        index = window_index(len(c))
        if len(index):
            windows.append(np.where(index >= 0, c[index], 0))
            owner.append(np.full(len(index), k))
    if not windows:
        return None
    windows, owner = np.concatenate(windows), np.concatenate(owner)
    score = weight[windows].max(axis=1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    turn = 0

    def best(of: np.ndarray, per_document: int) -> np.ndarray:
        """The windows of the given documents with the highest scores."""
        order = np.lexsort((-score, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        return order[(rank < per_document) & of[owner[order]]]

    for epoch in range(EPOCHS):
        toxic, hard = best((labels == 1) & ~aside, 2), best((labels == 0) & ~aside, 1)
        toxic = toxic[weight[windows[toxic]].max(axis=1) >= TELLING]
        plain = np.flatnonzero((labels == 0)[owner] & ~aside[owner])
        plain = rng.choice(plain, min(len(plain), 4 * len(toxic)), replace=False) if len(plain) else plain
        chosen = np.concatenate([np.repeat(toxic, 3), hard, plain])
        rng.shuffle(chosen)
        for start in range(0, len(chosen), BATCH):
            part = windows[chosen[start : start + BATCH]]
            ids = np.where(rng.random(part.shape) < WORD_DROPOUT, 0, id_of[part])
            g = network.gradients(ids, chars_of[part], part > 0, labels[owner[chosen[start : start + BATCH]]])
            turn += 1
            rate = RATE * (0.3 if epoch >= EPOCHS - 2 else 1.0)
            for name, d in g.items():
                if name in ("words", "chars"):
                    network.p[name] *= np.float32(1 - rate * DECAY)
                m, v = state[name]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                network.p[name] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
        x = network.projected(id_of, chars_of)
        score = np.concatenate([network.logits(x[windows[s : s + 2048]], windows[s : s + 2048] > 0) for s in range(0, len(windows), 2048)])
    top = np.full(len(labels), CALM)
    np.maximum.at(top, owner, score)
    network.slope, network.shift = calibrated(top[aside], labels[aside])
    return network


def calibrated(top: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the documents' highest logits probabilities; a slope above 0."""
    x = np.column_stack([np.clip(top, CALM, -CALM), np.ones(len(top))])
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(200):
        q = sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (labels - q) - (w - prior))
        w = w + step * min(1.0, 0.5 / max(np.abs(step).max(), 1e-9))
    return max(float(w[0]), 0.05), float(w[1])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> list[tuple[str | None, int]]:
    """At most ``rows`` labelled documents that are not held out, of ``most`` bytes together, those whose ids hash lowest, in the order of ids.

    A document that would pass ``most`` is left out; smaller ones behind it still count.
    """
    known = labels.where("toxic IS NOT NULL").where(~held_out("doc_id")).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    chosen = known.orderBy("h", "doc_id").limit(rows)
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h").agg(F.sum("n").alias("n"))
    left, ids = most, []
    for r in sizes.orderBy("h", "doc_id").toLocalIterator():  # ``rows`` at most
        if r.n <= left:  # one that doesn't fit is left out, and those after it aren't
            left -= r.n
            ids.append((r.doc_id,))
    fits = docs.sparkSession.createDataFrame(ids, docs.select("doc_id").schema)
    found = docs.select("doc_id", "text").join(F.broadcast(fits.join(chosen.select("doc_id", "toxic"), "doc_id")), "doc_id").orderBy("doc_id", "text")
    return [(r.text, int(r.toxic)) for r in found.toLocalIterator()]


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, network: Network | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, a probability, to every row; one narrow pass over whole texts."""
    docs = docs.drop(out)
    if network is None:
        return docs.withColumn(out, F.lit(0.0))
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(network)  # bounded by the vocabulary
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        cache = Words(net)
        for batch in batches:
            found = [document_logits(net, part, cache) for part in _by_size(batch.column(batch.schema.get_field_index(text)))]
            logit = np.concatenate(found) if found else np.array([])
            p = sigmoid(np.clip(logit, CALM, -CALM) * net.slope + net.shift)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def _by_size(column: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Texts in lists of some total length, so that long ones don't add up."""
    part, size = [], 0
    for t in column:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = train(training_sample(docs, table(spark, sf_dir, "labels")))
    scored = score(docs, network).withColumn("score", F.round("score", 6))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
