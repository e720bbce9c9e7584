"""Licence recognition by sentences and rules.

Texts are cut into passages, lines and sentences, these are normalised and looked up among the known
licence sentences, and the sequence of identifiers that a document shows is matched
against licence rules in their order: a rule of several sentences that matches takes these
out of the sequence, so a long licence is not also reported as the shorter one inside it.

Only built-in functions are used. Nulls and empty texts have no licence; rows that repeat
are rows of their own; without rows the result has none; long texts are read whole. Documents
without any of the marker words that every known sentence holds are answered without
cutting them up; that changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import let, table

#: Known licence sentences, normalised, by identifier.
SENTENCES: dict[str, str] = {
    "mit_short": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is_mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2_under": "licensed under the apache license version 2.0",
    "apache2_header": "licensed under the apache license version 2.0 the license",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_distributed": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl2_work": "this work is licensed under the gnu general public license version 2",
    "lgpl3_work": "this work is licensed under the gnu lesser general public license version 3",
    "agpl3_work": "this work is licensed under the gnu affero general public license version 3",
    "gpl3_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "cc_by_4": "licensed under cc by 4.0",
    "cc_by_sa_4": "licensed under cc by sa 4.0",
    "cc_by_nc_4": "licensed under cc by nc 4.0",
    "cc_by_nc_sa_4": "licensed under cc by nc sa 4.0",
    "cc_by_nd_4": "licensed under cc by nd 4.0",
    "cc0": "licensed under cc0 1.0",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache2": "spdx license identifier apache 2.0",
    "spdx_gpl3": "spdx license identifier gpl 3.0 only",
    "spdx_gpl3_later": "spdx license identifier gpl 3.0 or later",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "all_rights": "copyright all rights reserved",
}

#: Rules in order: licence, class, sequence of sentence identifiers.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", "permissive", ("mit_grant", "mit_notice", "as_is_mit")),
    ("MIT", "permissive", ("mit_grant", "mit_notice")),
    ("Apache-2.0", "permissive", ("apache2_header", "apache2_comply", "apache2_distributed", "apache2_see")),
    ("Apache-2.0", "permissive", ("apache2_header", "apache2_comply")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_program", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_program", "gpl_warranty", "gpl_copy")),
    ("BSD-2-Clause", "permissive", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_program",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_program",)),
    ("MIT", "permissive", ("mit_grant",)),
    ("MIT", "permissive", ("mit_short",)),
    ("MIT", "permissive", ("mit_under",)),
    ("Apache-2.0", "permissive", ("apache2_header",)),
    ("Apache-2.0", "permissive", ("apache2_under",)),
    ("GPL-3.0", "copyleft", ("gpl3_work",)),
    ("GPL-2.0", "copyleft", ("gpl2_work",)),
    ("LGPL-3.0", "copyleft", ("lgpl3_work",)),
    ("AGPL-3.0", "copyleft", ("agpl3_work",)),
    ("CC-BY-NC-SA-4.0", "restricted", ("cc_by_nc_sa_4",)),
    ("CC-BY-NC-4.0", "restricted", ("cc_by_nc_4",)),
    ("CC-BY-ND-4.0", "restricted", ("cc_by_nd_4",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa_4",)),
    ("CC-BY-4.0", "permissive", ("cc_by_4",)),
    ("CC0-1.0", "permissive", ("cc0",)),
    ("MIT", "permissive", ("spdx_mit",)),
    ("Apache-2.0", "permissive", ("spdx_apache2",)),
    ("GPL-3.0-only", "copyleft", ("spdx_gpl3",)),
    ("GPL-3.0-or-later", "copyleft", ("spdx_gpl3_later",)),
    ("BSD-3-Clause", "permissive", ("spdx_bsd3",)),
    ("LicenseRef-reserved", "restricted", ("all_rights",)),
]
#: Further ways to write sentences, by identifier.
MORE_SENTENCES: dict[str, str] = {
    "all rights reserved": "all_rights",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "this source code form is subject to the terms of the mozilla public license v": "mpl_terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2_copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license version 1.0": "bsl1",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": "epl2_terms",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21_library",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_library",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_program",
    "spdx license identifier mpl 2.0": "spdx_mpl2",
    "spdx license identifier isc": "spdx_isc",
    "spdx license identifier unlicense": "spdx_unlicense",
    "spdx license identifier bsl 1.0": "spdx_bsl1",
    "spdx license identifier epl 2.0": "spdx_epl2",
    "spdx license identifier lgpl 2.1 or later": "spdx_lgpl21",
    "spdx license identifier lgpl 3.0 or later": "spdx_lgpl3",
    "spdx license identifier agpl 3.0 or later": "spdx_agpl3",
    "spdx license identifier bsd 2 clause": "spdx_bsd2",
    "spdx license identifier gpl 2.0 only": "spdx_gpl2",
    "spdx license identifier gpl 2.0 or later": "spdx_gpl2_later",
    "spdx license identifier cc0 1.0": "spdx_cc0",
    "spdx license identifier cc by 4.0": "spdx_cc_by",
}
BSD3 = ("BSD-3-Clause", "permissive", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse"))
MPL2 = ("MPL-2.0", "copyleft", ("mpl_terms", "mpl2_copy"))  #: "v. 2.0" ends a sentence behind the "v"
#: These go before the others: a reservation right before a whole licence is part of its notice.
MORE_RULES = [(name, kind, ("all_rights", *wanted)) for name, kind, wanted in [BSD3, *RULES] if len(wanted) > 1] + [
    BSD3,
    MPL2,
    ("MPL-2.0", "copyleft", ("mpl2_copy",)),
    ("ISC", "permissive", ("isc_grant",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("BSL-1.0", "permissive", ("bsl1",)),
    ("EPL-2.0", "copyleft", ("epl2_terms",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21_library",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3_library",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_program",)),
    ("MPL-2.0", "copyleft", ("spdx_mpl2",)),
    ("ISC", "permissive", ("spdx_isc",)),
    ("Unlicense", "permissive", ("spdx_unlicense",)),
    ("BSL-1.0", "permissive", ("spdx_bsl1",)),
    ("EPL-2.0", "copyleft", ("spdx_epl2",)),
    ("LGPL-2.1-or-later", "copyleft", ("spdx_lgpl21",)),
    ("LGPL-3.0-or-later", "copyleft", ("spdx_lgpl3",)),
    ("AGPL-3.0-or-later", "copyleft", ("spdx_agpl3",)),
    ("BSD-2-Clause", "permissive", ("spdx_bsd2",)),
    ("GPL-2.0-only", "copyleft", ("spdx_gpl2",)),
    ("GPL-2.0-or-later", "copyleft", ("spdx_gpl2_later",)),
    ("CC0-1.0", "permissive", ("spdx_cc0",)),
    ("CC-BY-4.0", "permissive", ("spdx_cc_by",)),
]
EVERY_RULE = MORE_RULES + RULES
#: Every known sentence holds one of these.
MARKERS = "(?i)licen|copyright|redistribut|warrant|permission|rights[^a-z0-9]+reserved|public[^a-z0-9]+domain|of the mpl"
WRAPPED = r"([^.!?;:\n])\n([a-z])"
LEADER = r"(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--|-->|>+|\||dnl\b|REM\b)"  #: what comments begin their lines with
#: The lines of a gap are taken one by one and never given back, so that thousands of them need no stack.
GAP = rf"\n(?:[ \t]*{LEADER}?[ \t\r]*\n)"
PASSAGE_END = rf"(?<=[.!?])[ \t\r\n]+|{GAP}++"
WORD_LEADER = r"(?m)^[ \t]*(?:dnl|REM)\b[ \t]*"  #: of the leaders, those that normalising leaves
PART_END = r"(?<=[;:])[ \t\r\n]+"
TAG = r"(?im)^(.*spdx-license-identifier:.*)$"
ENDORSERS = "^neither the name of .+ nor the names of its contributors may be"
RANK = {"none": 0, "permissive": 1, "copyleft": 2, "restricted": 3}


def normalised(sentence: Column) -> Column:
    """Lower case, one space between runs of letters, digits and inner dots, no closing dot."""
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"(?<!\.)\.++( |$)", "$1"), r"^ +| +$", "")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order, as an array.

    A passage ends at a full stop or an empty line. It is looked up whole, over all its lines, as
    known sentences run across colons and semicolons. If that fails its lines are, and lines cut at
    these; or its parts between these, over all lines, where that finds more.
    """
    names = {v: k for k, v in SENTENCES.items()} | MORE_SENTENCES
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def named(s: Column) -> Column:
        return known[F.regexp_replace(normalised(s), ENDORSERS, "neither the name of the copyright holder nor the names of its contributors may be")]

    def each(parts: Column) -> Column:
        return F.filter(F.transform(F.filter(parts, lambda s: s.rlike(MARKERS)), named), lambda x: x.isNotNull())

    def one(s: Column, otherwise: Column) -> Column:
        return F.when(named(s).isNotNull(), F.array(named(s))).otherwise(otherwise)

    def passage(p: Column) -> Column:
        plain = F.regexp_replace(p, WORD_LEADER, "")
        lines = F.split(F.regexp_replace(p, WRAPPED, "$1 $2"), "\n")
        lines = F.flatten(F.transform(F.filter(lines, lambda s: s.rlike(MARKERS)), lambda s: one(s, each(F.split(s, PART_END)))))
        parts = each(F.split(plain, PART_END))
        return one(plain, F.when(F.size(parts) > F.size(lines), parts).otherwise(lines))

    passages = F.split(F.regexp_replace(text, TAG, "\n$1\n\n"), PASSAGE_END)
    found = F.flatten(F.transform(F.filter(passages, lambda p: p.rlike(MARKERS)), passage))
    return F.when(text.rlike(MARKERS), found).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sentence_ids``, ``licenses`` (array, in rule order, each once) and ``license_class``.

    The class is the most restrictive of the matched licences, ``unknown`` where sentences
    were recognised but no rule matched, ``none`` where there were none. Columns of these
    names are replaced. One narrow pass.
    """
    df = df.drop("sentence_ids", "licenses", "license_class")
    out = df.withColumn("sentence_ids", F.coalesce(sentence_ids(F.col(text)), F.array().cast("array<string>")))
    # the sequence is written with a mark on either side of each identifier
    seq = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    rule = lambda name, kind, wanted: F.struct(F.lit("|" + "||".join(wanted) + "|").alias("shown"), F.lit(len(wanted) > 1).alias("takes"), F.lit(name).alias("name"), F.lit(RANK[kind]).alias("rank"))
    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("worst"))

    def after(state: Column, r: Column) -> Column:
        """What is left of the sequence and what has matched, when one more rule is tried."""
        hit = F.contains(state["seq"], r["shown"])
        left = F.when(r["takes"], F.replace(state["seq"], r["shown"], F.lit("/"))).otherwise(state["seq"])
        return F.struct(left.alias("seq"), F.when(hit, F.array_append(state["names"], r["name"])).otherwise(state["names"]).alias("names"), F.when(hit, F.greatest(state["worst"], r["rank"])).otherwise(state["worst"]).alias("worst"))

    ended = F.aggregate(F.array(*[rule(*r) for r in EVERY_RULE]), start, after)
    kinds = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (v, k)])
    none = F.struct(F.array().cast("array<string>").alias("licenses"), F.lit("none").alias("license_class"))
    result = let(ended, lambda e: F.struct(F.array_distinct(e["names"]).alias("licenses"), F.when(F.size(e["names"]) == 0, "unknown").otherwise(kinds[e["worst"]]).alias("license_class")))
    found = F.when(F.size("sentence_ids") > 0, result).otherwise(none)
    return out.withColumns({"licenses": found["licenses"], "license_class": found["license_class"]})


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, license_class for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "license_class",
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _oracle() -> str:
    """The same in SQL, from the same sentences and rules; patterns that look behind are written by what they keep."""
    names = {v: k for k, v in SENTENCES.items()} | MORE_SENTENCES
    marked = lambda x: f"regexp_matches({x}, {_quoted(MARKERS)})"
    swapped = lambda x, old, new: f"regexp_replace({x}, {_quoted(old)}, {new}, 'g')"
    plain = swapped("lower({0})", "[^a-z0-9.+]+", "' '")
    plain = swapped(swapped(swapped(plain, r"\.+( |$)", r"'\1'"), "^ +| +$", "''"), ENDORSERS, "'neither the name of the copyright holder nor the names of its contributors may be'")
    named = lambda x: f"known[{plain.format(x)}]"
    passages = swapped(swapped(swapped("text", TAG, r"chr(10) || '\1' || chr(10) || chr(10)"), r"([.!?])[ \t\r\n]+", r"'\1' || chr(1)"), f"{GAP}+", "chr(1)")
    parts = lambda x: f"string_split({swapped(x, r'([;:])[ \t\r\n]+', chr(39) + chr(92) + '1' + chr(39) + ' || chr(1)')}, chr(1))"
    each = lambda x: f"list_filter(list_transform(list_filter({parts(x)}, lambda y: {marked('y')}), lambda y: {named('y')}), lambda y: y IS NOT NULL)"
    lines = f"list_filter(string_split({swapped('p', WRAPPED, chr(39) + chr(92) + '1 ' + chr(92) + '2' + chr(39))}, chr(10)), lambda s: {marked('s')})"
    lines = f"flatten(list_transform({lines}, lambda s: CASE WHEN {named('s')} IS NOT NULL THEN [{named('s')}] ELSE {each('s')} END))"
    left, taken, hits = "seq", [], []
    for name, kind, wanted in EVERY_RULE:
        shown = _quoted("|" + "||".join(wanted) + "|")
        hits.append(f"CASE WHEN contains({left}, {shown}) THEN {{'n': {_quoted(name)}, 'r': {RANK[kind]}}} END")
        if len(wanted) > 1:
            taken.append(f"replace({left}, {shown}, '/') AS s{len(taken)}")
            left = f"s{len(taken) - 1}"
    return f"""
WITH k AS (SELECT MAP([{', '.join(map(_quoted, names))}], [{', '.join(map(_quoted, names.values()))}]) AS known),
p AS (SELECT doc_id, i, s[i] AS p FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT doc_id, list_filter(string_split({passages}, chr(1)), lambda x: {marked('x')}) AS s FROM documents WHERE {marked('text')}))),
plain AS (SELECT doc_id, i, p, {swapped('p', WORD_LEADER, "''")} AS whole FROM p),
lists AS (SELECT doc_id, i, {named('whole')} AS one, {lines} AS lines, {each('whole')} AS parts FROM plain, k),
found AS (SELECT doc_id, flatten(list(CASE WHEN one IS NOT NULL THEN [one] WHEN len(parts) > len(lines) THEN parts ELSE lines END ORDER BY i)) AS ids FROM lists GROUP BY doc_id),
seqs AS (SELECT doc_id, ids, '|' || array_to_string(ids, '||') || '|' AS seq FROM found WHERE len(ids) > 0),
left_over AS (SELECT *, {', '.join(taken)} FROM seqs),
hits AS (SELECT doc_id, ids, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS h FROM left_over),
named AS (
  SELECT doc_id, ids, h, list_reduce(list_prepend('', list_transform(h, lambda x: x.n)),
    lambda a, x: CASE WHEN list_contains(string_split(a, ','), x) THEN a WHEN a = '' THEN x ELSE a || ',' || x END) AS names FROM hits)
SELECT d.doc_id, coalesce(len(ids), 0) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(names, '') AS licenses,
  CASE WHEN ids IS NULL THEN 'none' WHEN len(h) = 0 THEN 'unknown'
    ELSE ['none', 'permissive', 'copyleft', 'restricted'][list_max(list_transform(h, lambda x: x.r)) + 1] END AS license_class
FROM documents d LEFT JOIN named USING (doc_id)"""


ORACLE = _oracle()
