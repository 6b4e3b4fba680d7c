"""Licence scans with DataFrame functions only: phrases, and an exact set-similarity join with licence templates.

A text is cut into words (letters, digits and non-ASCII characters, A-Z lower-cased) once; only the words of the
templates' vocabulary are kept, with their places. Each template has blocks of its own size: stride is the least power of
two, 16 or more, that is not below its words, and a block is two strides long at every stride, so that any stride words in
a row lie in one block, whatever a template's length. A template is met where a block holds CONTAINMENT of its distinct
words at least:

* the vocabulary is ordered by how often its words stand in the whole corpus, rarest first;
* prefix filter: a block that holds ``need`` of a template's ``size`` words holds one of its ``size - need + 1`` rarest, so
  only texts with such a word are cut into blocks, and only around these words;
* length filter: the block has ``need`` vocabulary words at least;
* positional filter: from the first shared word on, template and block must both have ``need`` words left;
* what is left is compared word by word, so the result is exact.

A block is built once: its words are brought together by (text, stride, block), in time and space linear in the text. Only
labels are joined back to the documents. Texts are told apart by 128 bits of hash, so null or repeated ids and copies need
no case of their own. Null texts count as empty; a template or phrase without a word is an error.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import materialize, table
from driftlens.llm.decontamination import NON_WORD, text_key, words_of

LEAST_STRIDE, CONTAINMENT = 16, 0.85
#: Phrases whose words stand in a row, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Labels, and the statements and published licence texts by which they are known.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by": ("licensed under the creative commons attribution 4 0 international license",),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "mpl-2": (
        "subject to the terms of the mozilla public license v 2 0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "all-rights-reserved": ("all rights reserved",),
}


def template_words(text: str) -> list[str]:
    """The words of a template, by the rule of ``words_of``."""
    found = [w for w in re.split(NON_WORD, "".join(c.lower() if c.isascii() else c for c in text)) if w]
    if not found:
        raise ValueError(f"no word in {text!r}")
    return found


def stride_of(words: list[str]) -> int:
    return max(LEAST_STRIDE, 1 << (len(words) - 1).bit_length())


def vocabulary(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({w for texts in (*templates.values(), PHRASES) for t in texts for w in template_words(t)})


def known_words(docs: DataFrame, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """doc_id, h1, h2, n_words, known: array of (p, t), the vocabulary's words and their places in order."""
    kept = F.filter(F.transform("w", lambda t, p: F.struct(p.alias("p"), t.alias("t"))), lambda s: s["t"].isin(vocabulary(templates)))
    words = docs.select("doc_id", *text_key(F.col("text")), words_of(F.col("text").cast("string")).alias("w"))
    return words.select("doc_id", "h1", "h2", F.size("w").cast("long").alias("n_words"), kept.alias("known"))


def phrase_places(phrase: str) -> Column:
    """Places where a phrase's words stand in a row; all its words are in the vocabulary, so they are neighbours in known."""
    words = template_words(phrase)

    def stands(s: Column, k: Column) -> Column:
        here = s["t"] == words[0]
        for j, word in enumerate(words[1:], 1):
            other = F.get(F.col("known"), k + j)
            here &= F.coalesce((other["t"] == word) & (other["p"] == s["p"] + j), F.lit(False))
        return here

    return F.transform(F.filter("known", stands), lambda s: s["p"])


def frequency_order(words: DataFrame) -> list[str]:
    """The vocabulary's words that occur, rarest in the corpus first; as many rows as the vocabulary has words."""
    counts = words.select(F.explode("known.t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy("n", "t")
    return [r.t for r in counts.collect()]


def matching_blocks(words: DataFrame, order: list[str], templates: dict[str, tuple[str, ...]], containment: float = CONTAINMENT) -> DataFrame:
    """h1, h2, stride, block, label, containment of every block that meets a template."""
    spark = words.sparkSession
    # a word that occurs nowhere is the rarest of all
    rank = {w: k for k, w in enumerate([*sorted(set(vocabulary(templates)) - set(order)), *order])}
    prefixes, first = [], {}
    for label, texts in templates.items():
        for stride, own in ((stride_of(w), sorted({rank[x] for x in w})) for w in map(template_words, texts)):
            need = max(1, math.ceil(containment * len(own) - 1e-9))
            head = own[: len(own) - need + 1]
            prefixes += [(stride, r, label, own, need, place) for place, r in enumerate(head)]
            first[stride] = first.get(stride, set()) | set(head)
    by_rank = {r: w for w, r in rank.items()}
    # both tables have as many rows as the templates have words
    named = F.broadcast(spark.createDataFrame(list(rank.items()), "t string, r int"))
    heads = F.broadcast(spark.createDataFrame(prefixes, "stride int, r int, label string, own array<int>, need int, place int"))

    def span(stride: int) -> Column:
        at = F.transform(F.filter("known", lambda s: s["t"].isin(*[by_rank[r] for r in first[stride]])), lambda s: s["p"])
        return F.struct(F.lit(stride).alias("stride"), (F.array_min(at) - 2 * stride).alias("lo"), (F.array_max(at) + 2 * stride).alias("hi"))

    spans = F.filter(F.array(*map(span, sorted(first))), lambda x: x["lo"].isNotNull())
    cut = words.select("h1", "h2", "known", F.explode(spans).alias("x"))
    near = F.filter("known", lambda s: s["p"].between(F.col("x.lo"), F.col("x.hi")))
    each = cut.select("h1", "h2", "x.stride", F.explode(near).alias("s")).select("h1", "h2", "stride", "s.t", F.floor(F.col("s.p") / F.col("stride")).cast("int").alias("b"))
    each = each.select("h1", "h2", "stride", "t", F.explode(F.filter(F.array(F.col("b"), F.col("b") - 1), lambda b: b >= 0)).alias("block"))
    blocks = each.join(named, "t").groupBy("h1", "h2", "stride", "block").agg(F.array_sort(F.collect_set("r")).alias("held"))

    met = blocks.select("*", F.posexplode("held").alias("at", "r")).join(heads, ["stride", "r"])
    met = met.where((F.size("held") >= F.col("need")) & (F.least(F.size("held") - F.col("at"), F.size("own") - F.col("place")) >= F.col("need")))
    shared = F.size(F.array_intersect("own", "held"))
    return met.where(shared >= F.col("need")).select("h1", "h2", "stride", "block", "label", (shared / F.size("own")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    templates = TEMPLATES if templates is None else templates
    words = materialize(known_words(docs, templates), "known-words")
    blocks = matching_blocks(words, frequency_order(words), templates)
    # written first, so that adaptive execution may split the join where many rows have one text
    found = materialize(blocks.groupBy("h1", "h2").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best")), "licensed-texts")
    base = words.select("doc_id", "h1", "h2", "n_words", *[phrase_places(p).alias(f"at{k}") for k, p in enumerate(PHRASES)])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    base = base.select("doc_id", "h1", "h2", "n_words", F.concat(*[f"at{k}" for k in range(len(PHRASES))]).alias("at"), labels.alias("base"))
    none = F.array().cast("array<string>")
    joined = base.join(found, ["h1", "h2"], "left")
    return joined.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("met", none))), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))


def licence_phrases(spark, sf_dir: str) -> DataFrame:
    """The columns of op10_licenses that SQL has as well; -1 for no place."""
    places = [F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("first_word", "last_word")]
    return op10_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", *places, "base_labels")


PHRASES_SQL = (
    r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM cut
), ahead AS (
  SELECT doc_id, p, t || ' ' || lead(t, 1) OVER s || ' ' || lead(t, 2) OVER s AS three, t || ' ' || lead(t, 1) OVER s || ' ' || lead(t, 2) OVER s || ' ' || lead(t, 3) OVER s AS four
  FROM word WINDOW s AS (PARTITION BY doc_id ORDER BY p)
), hits AS (
  SELECT doc_id, p, label FROM ahead JOIN (VALUES """
    + ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    + r""") AS x(phrase, label) ON phrase = three OR phrase = four
), found AS (
  SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, coalesce(CAST(a AS BIGINT), -1) AS first_word, coalesce(CAST(b AS BIGINT), -1) AS last_word, coalesce(labels, '') AS base_labels
FROM cut LEFT JOIN found USING (doc_id)
"""
)
