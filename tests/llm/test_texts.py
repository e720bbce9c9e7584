"""Joins, passages and byte strings against brute force; edge cases of every operator on documents."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, embedding_dedup, jaccard_join, license_scan, piece_bpe, quality, substring_dedup, suffix_dedup, toxicity

EDGE = [(10001, None), (10002, ""), (10003, " \n"), (10004, "a b"), (10005, "A b"), (10006, "a b c d e f g"), (10007, "é" * 300)]
SCHEMA = "doc_id long, text string"


def copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 150]))]
        for _ in range(rng.choice([2, 5, 40])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(w)))
    return rows + EDGE


def classes(rows, k=5, percent=80):
    sets, seen = {}, collections.defaultdict(list)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        for g in sets[d]:
            seen[g].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = collections.Counter((a, b) for ds in seen.values() for a in ds for b in ds if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)  # so that large meeting places are cut
    rows = copies(5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(df).collect()}
    assert got == classes(rows)
    assert jaccard_join.similarity_classes(df.limit(0)).count() == 0


def stars(seed):
    """Sets of 20 words: two centres a family with leaves that are like their own centre alone, and one place where all meet."""
    rng, rows = random.Random(seed), []
    for family in range(12):
        word = lambda name: f"f{family}{name}"  # noqa: B023, E731
        rare, body = [word(f"g{k}") for k in range(3)], [word(f"b{k}") for k in range(16)]
        pairs = [(i, j) for i in range(2, 16) for j in range(i + 1, 16)]
        for centre, leaves in (("y", 10), ("z", 20)):
            rows.append((len(rows), " ".join([*rare, *body, word(centre)])))
            for i, j in rng.sample(pairs, leaves):
                own = [f"{len(rows)}own{k}" if k in (i, j) else w for k, w in enumerate(body)]
                rows.append((len(rows), " ".join([*rare, *own, word(centre)])))
        for _ in range(40):  # these make all but three words common, so that nothing meets at them
            rows.append((len(rows), " ".join([*body, word("y"), word("z"), *(f"{len(rows)}fill{k}" for k in range(60))])))
    return rows


def test_jaccard_join_of_stars_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # two blocks for each place of a family
    rows = stars(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, SCHEMA), k=1).collect()}
    assert got == classes(rows, k=1)


def passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pool = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(15)]
    rows = {}
    for i in range(200):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(pool)[: rng.randint(8, 60)] if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows[i * 2 + 1 if i % 7 else 1000 - i] = " ".join(["a"] * 30 if rng.random() < 0.05 else w)
    return [*rows.items(), *EDGE]


def test_substring_dedup(spark):
    rows, k, first, want = passages(5), 13, {}, {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, d), d)
    for d, w in split.items():
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        want[d] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    df = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("clash"))
    got = substring_dedup.remove_repeats(df)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == want
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, rows[0][1]), (None, None)], SCHEMA).withColumn("spans", F.lit(None).cast("string"))
    assert {(r.n_removed) for r in substring_dedup.remove_repeats(nameless).collect()} == {0}
    assert jaccard_join.similarity_classes(nameless).count() == 2 and suffix_dedup.remove_repeated_bytes(nameless).count() == 2
    twice = substring_dedup.remove_repeats(df.union(df))  # rows that repeat an id don't remove each other
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in twice.collect()} == want


def test_suffix_dedup(spark):
    rng, length = random.Random(5), 400
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    pool = [text(rng.randint(300, 1500)) for _ in range(8)] + ["a" * 900, "abcabcab" * 150]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 4)):
            q = rng.choice(pool)
            a = rng.randint(0, len(q) // 2)
            t += q[a : a + rng.randint(100, 1200)] if rng.random() < 0.6 else text(rng.randint(1, 500))
        rows.append((i, t))
    rows += [*EDGE, (2001, "x" * 399), (2002, "x" * 400), (2003, "x" * 401), (2004, "wxyz" * 900), (2005, "the same words " * 200 + text(300))]
    raw = {d: (t or "").encode() for d, t in rows}
    count = collections.Counter(r[i : i + length] for r in raw.values() for i in range(len(r) - length + 1))
    want = {}
    for d, r in raw.items():
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1]))
        want[d] = (len(r), sum(gone), runs, bytes(x for x, g in zip(r, gone, strict=True) if not g))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert got == want
    assert suffix_dedup.remove_repeated_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [200_000, 3])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 20, 60])))) for i in range(20)] + [(20, None), (21, "?!")]
    docs = list(EDGE)
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        item = rng.choice(items[:20])[1].split()
        if d % 2:
            item[rng.randrange(len(item))] = "changed" if d % 3 == 0 else item[0]
            w[5:5] = item
        docs.append((d, " ".join(w)))
    plain = lambda t: [w for w in __import__("regex").split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w]
    want = set()
    for i, t in items:
        q = plain(t)
        k = min(5, len(q))
        held = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)} if k else set()
        for d, x in docs:
            w = plain(x)
            n = len(held & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
            if held and 100 * n >= 80 * len(held):
                want.add((d, i, n, len(held)))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == want


def test_license_rules(spark):
    cases = [
        ("Prose here.\nReleased under the MIT License.", "MIT", "permissive"),
        ("licensed under the\napache license, version 2.0.", "Apache-2.0", "permissive"),
        ("Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.", "GPL-3.0,CC-BY-NC-4.0", "restricted"),
        ("See the License for the specific language governing permissions and\nlimitations under the License.", "", "unknown"),
        ("no such thing", "", "none"),
        (None, "", "none"),
        ("", "", "none"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: (r.l, r.license_class) for r in license_scan.scan(df).select("doc_id", F.array_join("licenses", ",").alias("l"), "license_class").collect()}
    assert got == {k: (names, kind) for k, (_, names, kind) in enumerate(cases)}
    for sentence in license_scan.SENTENCES.values():
        assert any(m in sentence for m in ("licen", "copyright", "redistribut", "warrant", "permission"))
        assert df.limit(1).select(license_scan.normalised(F.lit(sentence + "."))).first()[0] == sentence


def licences(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = license_scan.scan(df).select("doc_id", F.array_join("licenses", ",").alias("l"), "license_class").collect()
    return [(r.l, r.license_class) for r in sorted(rows)]


def test_reserved_rights(spark):
    reserved = ("LicenseRef-reserved", "restricted")
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + "".join(
        license_scan.SENTENCES[k] + ".\n" for k in ("bsd_source", "bsd_binary")
    )
    texts = ["Prose here.\nAll rights reserved.", "Copyright (c) X. All rights reserved.", "All Rights Reserved", "No rights are reserved.", f"Copyright X. All rights reserved.\n{bsd}"]
    assert licences(spark, texts) == [reserved, reserved, reserved, ("", "none"), ("BSD-2-Clause", "permissive")]


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD2 = """Copyright (c) 2020, X
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice,
       this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright
       notice, this list of conditions and the following disclaimer in the
       documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """
    3. Neither the name of X nor the names of its
       contributors may be used to endorse or promote products derived from
       this software without specific prior written permission."""


def test_licences_as_they_are_written(spark):
    gpl2 = GPL.replace("software: you", "software; you").replace("version 3", "version 2")
    whole = [
        (GPL, "GPL-3.0-or-later", "copyleft"), (gpl2, "GPL-2.0-or-later", "copyleft"), (APACHE, "Apache-2.0", "permissive"),
        (MIT, "MIT", "permissive"), (BSD2, "BSD-2-Clause", "permissive"), (BSD3, "BSD-3-Clause", "permissive"),
    ]
    cases = []
    for text, name, kind in whole:
        for first in ("", "    ", "# ", "// ", " * ", "dnl ", "-- "):
            cases.append(("\n".join((first + line).rstrip() for line in text.split("\n")), name, kind))
        cases.append((text.replace("\n", "\r\n"), name, kind))
    tags = [("MIT", "MIT", "permissive"), ("Apache-2.0", "Apache-2.0", "permissive"), ("GPL-3.0-only", "GPL-3.0-only", "copyleft"), ("GPL-3.0-or-later", "GPL-3.0-or-later", "copyleft"), ("BSD-3-Clause", "BSD-3-Clause", "permissive")]
    for tag, name, kind in tags:
        cases += [(f"// x\n// SPDX-License-Identifier: {tag}\npackage main", name, kind), (f"/* SPDX-License-Identifier: {tag} */", name, kind)]
    assert licences(spark, [t for t, _, _ in cases]) == [(name, kind) for _, name, kind in cases]


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""


def test_further_licences(spark):
    whole = [
        (MPL, "MPL-2.0", "copyleft"), (ISC, "ISC", "permissive"), (LGPL, "LGPL-2.1-or-later", "copyleft"), (EPL, "EPL-2.0", "copyleft"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense", "permissive"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0", "permissive"),
    ]
    cases = [("\n".join((first + line).rstrip() for line in text.split("\n")), name, kind) for text, name, kind in whole for first in ("", "# ", "// ", " * ")]
    assert licences(spark, [t for t, _, _ in cases]) == [(name, kind) for _, name, kind in cases]


def test_every_license_rule(spark):
    text = {v: k for k, v in license_scan.MORE_SENTENCES.items()} | license_scan.SENTENCES
    found = licences(spark, ["\n".join(f"{text[w]}." for w in wanted) for _, _, wanted in license_scan.EVERY_RULE])
    assert found == [(name, kind) for name, kind, _ in license_scan.EVERY_RULE]


def test_pieces_as_the_library(spark):
    import sentencepiece

    model, library = piece_bpe.loaded(piece_bpe.default_model()), sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    rng = random.Random(1)
    letters = list("ab  \n\t▁é日本\0😀<s>the ing 　\r")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [" " * k + "b" for k in range(40)] + [""]
    for t in texts:
        ids = model.encode(t).tolist()
        assert ids == library.encode(t, add_eos=True) and model.decode(ids) == library.decode(ids)
    df = spark.createDataFrame([(1, None, "x"), (2, "hi there", "y")], "doc_id int, text string, ids string")
    got = {r.doc_id: (r.ids, r.decoded_text) for r in piece_bpe.encode_documents(df, piece_bpe.default_model()).collect()}
    assert got == {1: ([2], ""), 2: (library.encode("hi there", add_eos=True), "hi there")}


def test_embedding_links(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(embedding_dedup, "LEAST_BALL", 3)
    rng = np.random.default_rng(3)
    x = []
    for _ in range(25):
        c = rng.normal(size=32)
        c /= np.linalg.norm(c)
        for _ in range(int(rng.integers(1, 20))):
            e = rng.normal(size=32)
            x.append([float(z) for z in (c + rng.uniform(0, 0.6) * e / np.linalg.norm(e)) * rng.uniform(0.5, 2)])
    x += [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 31, x[0], x[0]]
    ids = [int(i) for i in rng.permutation(len(x))]
    fine = np.array([v is not None and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v) for v in x])
    unit = np.array([v if ok else [0.0] * 32 for v, ok in zip(x, fine, strict=True)])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.array(ids)
    for _ in range(len(ids)):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
    want = {i: (int(link[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
    df = spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_links(df).collect()}
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found <= true and found >= 0.97 * true and set(got) == set(want)
    assert embedding_dedup.near_links(df.limit(0)).count() == 0


def test_embedding_links_of_every_length(spark):
    x = [[1.0, 0.0, 2.0]] * 3 + [[5.0, 1.0]] * 2 + [[-1.0, 5.0], [2.0], [3.0], [-4.0], [0.0, 0.0], None]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_links(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9), 10: (0, 10)}


def test_network_gradients():
    import numpy as np

    net = toxicity.Network({"a": 1, "b": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids, chars, y = rng.integers(0, 3, (3, toxicity.WINDOW)), rng.integers(0, 100, (3, toxicity.WINDOW, toxicity.CHAR_PLACES)), np.array([1, 0, 1])
    mask = np.ones((3, toxicity.WINDOW), bool)
    mask[1, 20:] = False

    def loss():
        x = net.inputs(ids, chars)
        both = np.concatenate([x @ net.p["wf"] + net.p["bf"], x @ net.p["wb"] + net.p["bb"]], -1)
        s = toxicity.sigmoid(net.pooled(net.states(both, mask), mask)[0])
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = net.gradients(ids, chars, mask, y)
    for k in net.p:
        at = (1, 3) if k == "words" else (int(chars[0, 0, 2]) + 2 * toxicity.CHAR_KINDS, 3) if k == "chars" else tuple(rng.integers(0, s) for s in net.p[k].shape)
        old, step = net.p[k][at], 1e-2
        net.p[k][at] = old + step
        up = loss()
        net.p[k][at] = old - step
        down = loss()
        net.p[k][at] = old
        assert abs(g[k][at] - (up - down) / (2 * step)) < 1e-4


def test_toxicity_reads_long_words_whole():
    net = toxicity.Network({})
    score = lambda *texts: toxicity.document_logits(net, list(texts), toxicity.Words(net)).tolist()
    rng = random.Random(3)
    for word in ("".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)), "今日はとても良い天気なので散歩に行きましょう", "one_two-three/four,five_six"):
        shown = toxicity.CHAR_PLACES
        ends = [k for k in range(shown, len(word)) if word[k].isalpha()]
        changed = [word[:k] + "ü" + word[k + 1 :] for k in ends]
        first, *rest = score(word, *changed)
        assert first not in rest
    assert "scum" in toxicity.tokens("some_kind_of_scum.")
    assert toxicity.tokens("short words only, (as before).") == ["short", "words", "only,", "(as", "before)."]


def test_toxicity_learns(spark):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in "lmnr"]
    text = lambda bad: " ".join([rng.choice(words) for _ in range(rng.randint(5, 60))] + (["scum"] if bad else []) + [rng.choice(words) for _ in range(5)])
    sample = [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    net = toxicity.train(sample)
    rows = [(k, text(k % 2 == 0)) for k in range(60)] + EDGE
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), net).collect()}
    assert sum((got[k] >= 0.5) == (k % 2 == 0) for k in range(60)) >= 57
    assert all(got[d] < 0.5 for d, _ in EDGE)
    assert toxicity.train([]) is None and toxicity.score(spark.createDataFrame(rows, SCHEMA), None).first().score == 0.0


def posteriors(rows):
    """Rates of sites as the docstring of ``quality`` has them: rows of host, path and probability."""

    def strength(rate, spread, n):
        between = max(spread - rate * (1 - rate) / max(n, 1.0), 1e-9)
        return min(max(rate * (1 - rate) / between - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    of_path, of_host = collections.defaultdict(list), collections.defaultdict(list)
    for host, path, p in rows:
        of_path[host, path].append(p)
        of_host[host].append(p)
    mean = lambda x: sum(x) / len(x)
    var = lambda x: sum((v - mean(x)) ** 2 for v in x) / len(x)
    whole = mean([p for _, _, p in rows])
    m = strength(whole, var([mean(x) for x in of_host.values()]), mean([len(x) for x in of_host.values()]))
    host_rate = {h: (sum(x) + m * whole) / (len(x) + m) for h, x in of_host.items()}
    out = {}
    for (h, path), x in of_path.items():
        paths = [y for (g, _), y in of_path.items() if g == h]
        k = strength(host_rate[h], var([mean(y) for y in paths]), mean([len(y) for y in paths]))
        out[h, path] = (host_rate[h], (sum(x) + k * host_rate[h]) / (len(x) + k))
    return whole, out


def test_quality_posteriors(spark):
    import math

    rng = random.Random(8)
    names = [None, "a", "b", "c"]
    rows = [(k, " ".join(rng.choice(["plain", "words", "of", "prose.", "###", "!!", "{}"]) for _ in range(rng.randint(0, 40))), rng.choice(names), rng.choice(names), "x") for k in range(300)] + [(300, None, "rare", "one", "x")]
    labels = spark.createDataFrame([(k, int("#" not in t), 0) for k, t, *_ in rows[:200]], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score string")
    for keep_text in (True, False):
        got = {r.doc_id: r for r in quality.classify(df, labels, keep_text=keep_text).collect()}
        assert len(got) == len(rows)
        whole, rates = posteriors([(r.source, r.lang, r.p_doc) for r in got.values()])
        odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        for r in got.values():
            host, path = rates[r.source, r.lang]
            score = 1 / (1 + math.exp(-(odds(r.p_doc) + quality.SITE_WEIGHT * (odds(path) - odds(whole)))))
            assert abs(r.p_host - host) < 1e-9 and abs(r.p_path - path) < 1e-9 and abs(r.score - score) < 1e-9 and r.keep == (r.score >= 0.5)


def test_quality_of_documents_not_learnt_from(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    got = quality.classify(docs, labels.where(~aside)).join(labels.where(aside), "doc_id").select("quality", "keep").collect()
    assert len(got) > 60 and sum(r.keep == (r.quality == 1) for r in got) / len(got) > 0.95


def test_toxicity_contract(spark):
    """What the query returns, and how it does on documents that it has not learnt from."""
    import zlib

    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, base).collect()}
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    clean = [p for p, t in held if not t]
    assert sum(clean) / len(clean) < 0.05 and sum(p for p, t in held if t) >= 3
    sample = toxicity.training_sample(docs, labels, most=20_000)
    assert 0 < sum(len((t or "").encode()) for t, _ in sample) <= 20_000


CLASH = ["n_bytes", "n_removed", "n_spans", "kept", "_doc", "_spans", "spans", "doc", "score", "keep", "p_doc", "p_host", "p_path", "ids", "decoded_text", "licenses", "license_class", "sentence_ids", "_seq", "_hits", "component_id", "node"]


def test_clashing_columns_and_empty_tables(spark):
    rows = [(1, "some words " * 60, "s", "en"), (2, "some words " * 60, None, None), (2, "some words " * 60, None, None), (3, None, "s", "en"), (4, "", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, "some words some words some words")], "item_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeated_bytes(df).select("n_removed").collect()) == [0, 0, 660, 660, 660]
    for one in (df, df.limit(0)):
        n = one.count()
        assert quality.classify(one, labels).count() == n
        assert license_scan.scan(one).count() == n
        assert piece_bpe.encode_documents(one, piece_bpe.default_model()).count() == n
        assert toxicity.score(one, toxicity.train(toxicity.training_sample(one, labels))).count() == n
        assert {r.doc_id for r in decontaminate.find_leaks(one, items).collect()} == ({1, 2} if n else set())
        assert decontaminate.find_leaks(one, items.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (None, [1.0, 2.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "row", "id", "n_links", "kept", "component_id")})
    assert sorted((r.vec_id or 0, r.n_links) for r in embedding_dedup.near_links(vectors).collect()) == [(0, 3), (1, 3), (2, 3), (2, 3), (3, 0)]


def test_sets_that_share_a_name(spark, monkeypatch):
    """Names of a few bits, so that almost all sets share theirs: the second hash tells them apart."""
    rows = copies(9)
    texts = [t for _, t in rows]
    hashes = jaccard_join.Hashes()
    sets = [s for s in (jaccard_join.shingle_set(t, 5, hashes) for t in texts) if len(s)]
    monkeypatch.setattr(jaccard_join, "NODE_BITS", 4)
    named = collections.defaultdict(set)
    for s in sets:
        named[jaccard_join.node_of(s)].add(jaccard_join.second_name(s))
    shared = frozenset(x for x, seconds in named.items() if len(seconds) > 1)
    assert len(named) <= 16 and shared
    told = collections.defaultdict(set)
    for s in sets:
        told[jaccard_join.node_of(s, shared)].add(tuple(s))
    assert all(len(x) == 1 for x in told.values())


def test_quality_keeps_good_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").select("quality", "keep").collect()
    right = sum(r.keep == (r.quality == 1) for r in got) / len(got)
    assert right > 0.97
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", None), (2, "", "s", None)], "doc_id long, text string, source string, lang string")
    assert quality.classify(odd, labels.limit(0)).count() == 3
