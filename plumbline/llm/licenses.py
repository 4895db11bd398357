"""License scans with a positional rare-token index (DataFrame functions only).

1. Every file's words that any template has (without stop words, which are
   wildcards in templates) are kept with their positions: one pass over texts.
2. Their document frequencies over all files and templates give IDFs. The index
   holds each template under the rarest word of its mandatory key phrase (the
   longer of equally rare ones): that word stands at every place that counts, so
   nothing is lost by looking for no other.
3. Each file's words that the index has give the places where a template may
   begin. There the template's postings are intersected with the file's words
   around by relative position: a place counts if all words of the key phrase
   stand there and the matched words have SHARE of the template's IDF.

The base phrases are templates whose key phrase is all of them, so every place
is found. All of it is done within the row of a file, against a literal of the
templates: nothing is exchanged but counts of words, and nothing is hot. A
place costs as many steps as a template is long, whatever the file's length.

Edge cases: null text counts as empty; files without words or places have null
first_word and last_word, empty labels and score 0; overlapping places all
count; repeated rows are scanned each; null ids stay null; an empty table gives
no rows; columns other than id and text are not read. Very long texts are
scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import required, stored

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Label, base phrases.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Label, template (from the licences' public notices, in words as files are read), mandatory key phrase in it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2 0",
    ),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "gnu general public license",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
)
STOP = frozenset("a and are in is of or the this to under use with without any".split())
SHARE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _library() -> list[tuple[str, bool, list[str], set[int]]]:
    """Label, whether base, words, positions of the key phrase's words (wildcards left out)."""
    found = [(label, True, text.split(), set(range(len(text.split())))) for label, text in BASE]
    for label, text, key in TEMPLATES:
        words, want = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(want)] == want)
        found.append((label, False, words, {i for i in range(at, at + len(want)) if words[i] not in STOP}))
    return found


def _scanned(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per file: words, and those of the vocabulary with their positions, in order."""
    words = texts.select("id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    hits = F.filter(
        F.transform("words", lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct(F.translate(w, _UPPER, _LOWER).alias("w"), i.alias("i")))),
        lambda x: x.isNotNull(),
    )
    return words.select("id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def document_frequencies(library, seen: dict[str, int]) -> dict[str, int]:
    """In how many files and templates each word stands."""
    out = dict(seen)
    for _, _, words, _ in library:
        for w in set(words) - STOP:
            out[w] = out.get(w, 0) + 1
    return out


def _weighted(library, df: dict[str, int], total: int) -> list[list[tuple[int, str, float]]]:
    """Per template its words but stop words: position, word, share of the template's IDF."""
    found = []
    for _, _, words, _ in library:
        own = [(i, w, math.log(1 + (total + 1) / (df[w] + 1))) for i, w in enumerate(words) if w not in STOP]
        whole = sum(x for _, _, x in own)
        found.append([(i, w, x / whole) for i, w, x in own])
    return found


def anchors(library, df: dict[str, int]) -> list[tuple[str, int]]:
    """Per template the rarest word of its key phrase, and where it stands in the template."""
    out = []
    for _, _, words, key in library:
        rarest = min((words[i] for i in key if words[i] not in STOP), key=lambda w: (df[w], -len(w), w))
        out.append((rarest, min(i for i in key if words[i] == rarest)))
    return out


def _index(anchored: list[tuple[str, int]]) -> Column:
    """Anchor -> where it stands in templates: (template, position)."""
    postings: dict[str, list[Column]] = {}
    for t, (w, p) in enumerate(anchored):
        postings.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")))
    return F.create_map(*(x for w, p in postings.items() for x in (F.lit(w), F.array(*p))))


def _templates(library, weighted) -> Column:
    """Per template, by position: word (null: a wildcard), share of IDF, whether of the key phrase; and its length, label and kind."""

    def one(t: int) -> Column:
        label, base, words, key = library[t]
        at = {i: (w, g) for i, w, g in weighted[t]}
        column = lambda f, kind: F.array(*(F.lit(f(i)).cast(kind) for i in range(len(words))))
        return F.struct(
            column(lambda i: at[i][0] if i in at else None, "string").alias("words"), column(lambda i: at[i][1] if i in at else 0.0, "double").alias("shares"), column(lambda i: int(i in key and i in at), "int").alias("keys"),
            F.lit(len(words)).alias("length"), F.lit(sum(i in at for i in key)).alias("n_keys"), F.lit(label).alias("label"), F.lit(base).alias("base"),
        )

    return F.array(*map(one, range(len(library))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every text.

    Returns id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the best share of a template's IDF at a verified place).
    """
    library = _library()
    vocabulary = sorted({w for _, _, words, _ in library for w in words} - STOP)
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    files = stored(_scanned(texts, vocabulary), "licences")
    return _found(library, files).withColumnRenamed("id", id_col)


def _places(library, anchored, weighted) -> Column:
    """The verified places of a file: start, share, label, base."""
    templates, index, held = _templates(library, weighted), _index(anchored), sorted({w for w, _ in anchored})
    reach = max(len(words) for _, _, words, _ in library)

    def place(h: Column, k: Column, x: Column) -> Column:
        start, t = h.i - x.p, F.get(templates, x.t)

        def add(acc: Column, other: Column) -> Column:
            p = other.i - start
            met = (p >= 0) & (p < t.length) & (F.get(t.words, F.greatest(p, F.lit(0))) == other.w)
            return F.struct((acc.share + F.when(met, F.get(t.shares, p)).otherwise(0.0)).alias("share"), (acc["keys"] + F.when(met, F.get(t["keys"], p)).otherwise(0)).alias("keys"))

        around = F.slice("hits", F.greatest(k + 2 - reach, F.lit(1)), F.lit(2 * reach))
        met = F.aggregate(around, F.struct(F.lit(0.0).alias("share"), F.lit(0).alias("keys")), add)
        return F.struct(start.alias("start"), F.least(met.share, F.lit(1.0)).alias("share"), ((met["keys"] == t.n_keys) & (met.share >= SHARE)).alias("holds"), t.label.alias("label"), t.base.alias("base"))

    begun = F.transform("hits", lambda h, k: F.when(h.w.isin(held), F.transform(F.element_at(index, h.w), lambda x: place(h, k, x))))
    return F.filter(F.flatten(F.filter(begun, lambda x: x.isNotNull())), lambda x: x.holds)


def _found(library, files: DataFrame) -> DataFrame:
    total = files.count() + len(library)
    counted = files.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").count()
    df = document_frequencies(library, {r.w: r["count"] for r in counted.collect()})  # a row per template word at most
    placed = files.select("id", "n_words", _places(library, anchors(library, df), _weighted(library, df, total)).alias("places"))
    base = F.filter("places", lambda x: x.base)
    named = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p.label))), ",")
    starts = F.transform("base", lambda x: x.start)
    return placed.withColumn("base", base).select(
        "id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        named(F.col("base")).alias("base_labels"),
        named(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x.share)), F.lit(0.0)).alias("score"),
    )
