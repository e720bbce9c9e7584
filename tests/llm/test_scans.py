"""Licences against their SQL, very long texts, and what the toxicity network computes."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, license_scan, queries, toxicity
from tests.llm import test_texts

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_license_scan", "op7_warc"])
def test_scans_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DIR)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(str, cursor.fetchall()))


def test_licences_against_sql(spark):
    """Licences as they are written, commented and cut in every way, by the operator and by its SQL."""
    known = license_scan.SENTENCES | {f"{v}/{k}": k for k, v in license_scan.MORE_SENTENCES.items()}
    whole = [getattr(test_texts, n) for n in ("GPL", "APACHE", "MIT", "BSD2", "BSD3", "MPL", "ISC", "LGPL", "EPL")]
    texts = [None, "", "nothing", "No rights are reserved.", "SPDX-License-Identifier: MIT", "/* x\nSPDX-License-Identifier: Apache-2.0 */ licence: y"]
    for text in whole:
        for first in ("", "    ", "# ", "// ", " * ", "dnl ", "-- ", "; ", "> "):
            texts.append("\n".join((first + line).rstrip() for line in text.split("\n")))
        texts += [text.replace("\n", "\r\n"), text.replace(". ", ".\n#\n"), f"Copyright X. All rights reserved.\n{text}\n\n{text.upper()}"]
    rng = random.Random(2)
    sentences = list(known.values())
    for _ in range(200):
        part = [rng.choice(sentences) for _ in range(rng.randint(1, 5))]
        texts.append("".join(p.replace(" the ", rng.choice([" the\n", " the ", "; the "]), 1) + rng.choice([".", ";", ":", "!", ""]) + rng.choice([" ", "\n", "\n\n", "\n# \n", "\n<!-- \n\n", "\r\n"]) for p in part))
    rows = list(enumerate(texts))
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": pa.array([k for k, _ in rows]), "text": pa.array([t for _, t in rows], pa.string())}))
    want = {r[0]: tuple(r[1:]) for r in duck.execute(license_scan.ORACLE).fetchall()}
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (len(r.sentence_ids), ",".join(r.sentence_ids), ",".join(r.licenses), r.license_class) for r in got.collect()}
    assert sum(n > 0 for n, *_ in want.values()) > 200
    assert got == want


def test_licences_in_long_texts(spark):
    n = 200_000
    begin = "Released under the MIT License.\n"
    texts = [begin + line * n for line in ("#\n", " * \n", "\n", " \t\n", "//\n# \n")] + [begin + "." * n + "x", "licence " + "; " * n + "\n" + begin]
    assert test_texts.licences(spark, texts) == [("MIT", "permissive")] * len(texts)


def test_leaks_in_long_texts(spark):
    """Twice the words take about twice the time, and what stands in the middle is found."""
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today"), (2, "other words that stand nowhere at all in it"), (None, "an item that has no name of its own here")], "item_id int, text string")
    rng, took = random.Random(1), []
    for n in (100_000, 400_000):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        words[n // 2 : n // 2] = "the quick brown fox jumps over the lazy dog today".split()
        rows = [(5, " ".join(words)), (None, "so an item that has no name of its own here it is"), (7, None)]
        docs = spark.createDataFrame(rows, "doc_id int, text string")
        start = time.time()
        assert sorted(map(tuple, decontaminate.find_leaks(docs, items).select("doc_id", "item_id", "n_shared").collect()), key=str) == [(5, 1, 6), (None, None, 6)]
        took.append(time.time() - start)
    assert took[1] < 3 * took[0] + 15


def test_sample_leaves_out_what_does_not_fit(spark):
    rows = [(k, f"text {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    whole = toxicity.training_sample(docs, labels)
    assert 100 < len(whole) < 200
    first = labels.where(~toxicity.held_out("doc_id")).orderBy(F.xxhash64("doc_id")).first().doc_id
    longer = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x"), 5000)).otherwise(F.col("text")))
    assert toxicity.training_sample(longer, labels, most=4000) == [x for x in whole if x[0] != f"text {first}"]


def plain_logits(net, text):
    """The highest logit of a text's windows, step by step as the network is described."""
    p, h = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    words, best = toxicity.tokens(text), toxicity.CALM
    starts = range(0, max(len(words) - toxicity.STRIDE, 1), toxicity.STRIDE) if words else []
    for start in starts:
        x = []
        for w in words[start : start + toxicity.WINDOW]:
            stem = toxicity.stem(w)
            chars = sum((p["chars"][k * toxicity.CHAR_KINDS + c] for k, c in enumerate(toxicity.letters(stem)) if c), np.zeros(toxicity.CHAR_DIM))
            x.append(np.concatenate([p["words"][net.vocabulary.get(stem, 0)], np.tanh(chars)]))
        sides = []
        for w, b, u, order in (("wf", "bf", "uf", x), ("wb", "bb", "ub", x[::-1])):
            state, out = np.zeros(h), []
            for v in order:
                own, inner = v @ p[w] + p[b], state @ p[u]
                z, r = sig(own[:h] + inner[:h]), sig(own[h : 2 * h] + inner[h : 2 * h])
                new = np.tanh(own[2 * h :] + r * inner[2 * h :])
                state = (1 - z) * new + z * state
                out.append(state)
            sides.append(out if w == "wf" else out[::-1])
        states = [np.concatenate(s) for s in zip(*sides, strict=True)]
        weight = np.exp([np.tanh(s @ p["a"] + p["a0"]) @ p["v"] for s in states])
        best = max(best, float((sum(a * s for a, s in zip(weight / weight.sum(), states, strict=True)) @ p["o"] + p["o0"])[0]))
    return best


def test_window_scores_against_a_plain_pass():
    rng = random.Random(3)
    vocabulary = {f"w{k}": k + 1 for k in range(30)}
    net = toxicity.Network(vocabulary, seed=4)
    texts = ["", None, "w1", *(" ".join(rng.choice([f"w{rng.randrange(60)}", "Some_long-word/of,parts", "W3,"]) for _ in range(n)) for n in (2, 15, 16, 17, 32, 33, 48, 49, 100))]
    got = toxicity.document_logits(net, texts, toxicity.Words(net), group=3)
    assert np.allclose(got, [plain_logits(net, t) for t in texts], atol=1e-4)
