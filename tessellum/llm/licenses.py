"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template of L words is looked for in blocks of about 1.25 * L consecutive words, one of which begins every L / 4 words,
so that any passage of L words lies in one; templates of fewer than 8 words have blocks of just L words, at every word.
A block meets a template if it holds at least ceil(THRESHOLD * n) of the template's n distinct words. All tokens
are ordered by their document frequency over the whole corpus, rarest first, and then, with a the least overlap,
- prefix: a block that meets a template of n tokens holds one of its first n - a + 1, so only blocks around those are looked at;
- length: it has at least a distinct words of the template's vocabulary;
- position: after the first common token, at place i of the template's, there are at least a - 1 left.
What passes is counted exactly. Templates are literals, so documents are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import ascii_lower, let

THRESHOLD = 0.85
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license notices and texts, the key's part before a dot is the label.
TEMPLATES = {
    "apache.short": "Licensed under the Apache License, Version 2.0.",
    "apache.header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc.long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "gpl.short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl.header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit.short": "Released under the MIT License.",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit.full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc.full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd.full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def _words(template: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in template.lower()).split()


def _tokens(template: str) -> list[str]:
    return list(dict.fromkeys(_words(template)))


def shape(template: str) -> tuple[int, int]:
    """(words from one block to the next, words of a block)."""
    n = len(_words(template))
    step = n // 4 if n >= 8 else 1
    return step, n + step - 1


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def token_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by the number of rows of `words` that have them, rarest first, ties by code point.

    Each row gives its distinct template tokens, counted by map-side sums; the result has as many rows as the
    templates have tokens.
    """
    have = words.select(F.explode(F.array_intersect(_strings(vocabulary), F.col("words"))).alias("token"))
    counts = {r["token"]: r["n"] for r in have.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def matches(words: Column, order: list[str], templates: Mapping[str, str], threshold: float) -> Column:
    """array of struct(label, containment): of each template that a block meets, the best; words is a lambda variable."""
    place = {t: i for i, t in enumerate(order)}
    none = F.array().cast("array<struct<label:string,containment:double>>")

    def of(name: str, template: str) -> Column:
        tokens = sorted(_tokens(template), key=place.__getitem__)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        prefix, (step, size) = _strings(tokens[: len(tokens) - need + 1]), shape(template)

        def overlap(start: Column) -> Column:
            held = F.array_intersect(_strings(tokens), F.slice(words, start + 1, F.lit(size)))
            left = lambda h: F.lit(len(tokens)) - F.array_position(_strings(tokens), F.get(h, 0)) + 1
            return let(held, lambda h: F.when((F.size(h) >= need) & (left(h) >= need), F.size(h)).otherwise(0))

        # the blocks that hold a token of the prefix
        around = lambda p: F.sequence(F.greatest(F.ceil((p - size + 1) / step), F.lit(0)), F.floor(p / step))
        places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(prefix, w), i)), lambda p: p.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(places, around)))
        best = F.array_max(F.transform(starts, lambda k: overlap((k * step).cast("int"))))
        hit = let(best, lambda n: F.when(n > 0, F.array(F.struct(F.lit(name.split(".")[0]).alias("label"), (n / len(tokens)).alias("containment")))).otherwise(none))
        return F.when(F.arrays_overlap(words, prefix), hit).otherwise(none)

    return F.concat(*[of(k, v) for k, v in templates.items()])


def phrase_places(words: Column) -> Column:
    """array of struct(at, label): where a phrase's words stand consecutively."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def here(i: Column) -> Column:
            found = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                found = found & F.coalesce(F.get(words, i + k) == part, F.lit(False))
            return found

        starts = F.filter(F.transform(words, lambda w, i: i), here)
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.when(F.array_contains(words, "license"), F.concat(*[of(p, x) for p, x in PHRASES.items()]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs.

    score: the largest containment of a template that a block meets, 0 if none does. Templates may be of any length, such
    as whole license texts: a template's blocks are about as long as it is. Null text counts as empty: no
    words, null places, empty labels; very long texts are taken whole. Templates that tie both give their label. Repeated
    rows each get their row, an empty table gives an empty one; columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("words"))
    order = token_order(rows, sorted({t for v in templates.values() for t in _tokens(v)}))

    def found(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w).alias("base"), matches(w, order, templates, threshold).alias("hits"))

    rows = rows.select("doc_id", let(F.col("words"), found).alias("f"))
    base = F.coalesce(F.col("f.base"), F.array().cast("array<struct<at:bigint,label:string>>"))
    hits = F.coalesce(F.col("f.hits"), F.array().cast("array<struct<label:string,containment:double>>"))
    rows = rows.select("doc_id", F.col("f.n_words").alias("n_words"), base.alias("base"), hits.alias("hits"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").alias("first_word"),
        F.array_max("base.at").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "hits.label")).alias("labels"),
        F.coalesce(F.array_max("hits.containment"), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    def row(key: str, text: str) -> str:
        tokens, (step, size) = _tokens(text), shape(text)
        return "('{}', [{}], {}, {}, {})".format(key.split(".")[0], ", ".join(f"'{t}'" for t in tokens), math.ceil(THRESHOLD * len(tokens) - 1e-9), step, size)

    rows = ", ".join(row(k, v) for k, v in TEMPLATES.items())
    phrases = ", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in PHRASES.items())
    return rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), t(label, tokens, need, step, size) AS (VALUES {rows}
), b AS (
  SELECT doc_id, label, tokens, need, list_distinct(ws[k * step + 1 : k * step + size]) AS block
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(ws) / step) AS BIGINT))) AS k FROM w, t WHERE len(list_intersect(list_distinct(ws), tokens)) >= need)
), hit AS (
  SELECT doc_id, label, len(list_intersect(block, tokens)) / len(tokens) AS c FROM b WHERE len(list_intersect(block, tokens)) >= need
), p(phrase, label, n) AS (VALUES {phrases}
), base AS (
  SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, 'license')), p
  WHERE array_to_string(ws[i:i+n-1], ' ') = phrase AND i + n - 1 <= len(ws)
), bs AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM base GROUP BY doc_id
), ls AS (
  SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM hit) GROUP BY doc_id
), sc AS (SELECT doc_id, max(c) AS score FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


ORACLE = _oracle()
