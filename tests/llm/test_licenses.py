import random
import re

from plumbline.llm import licenses
from tests.llm import brute
from tests.llm.test_text_operators import SCHEMA, corpus


def test_scan(spark):
    texts = [t for _, t in corpus(2, 40)]
    texts += [
        "CC BY-NC 4.0", "cc-by, Cc/By cc xby by", "All rights reserved. all RIGHTS\nreserved all rights all rights reserved", "the GNU General Public License, version 3",
        "general public licence license", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "rights reserved all", "é cc by é ccé by",
        "Licensed under CC BY-NC 4.0. All rights reserved. " * 40, "cc by",
    ]
    got = licenses.license_scan(spark.createDataFrame([(i, t, "en", 1, "k") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute.license_base(texts[x.doc_id]), texts[x.doc_id]
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    by = {texts[x.doc_id]: x for x in got}
    assert by["Licensed under the Apache License, Version 2.0."].labels == "apache-2.0"
    assert by["Released under the MIT License."].labels == "mit"
    assert by["rights reserved all"].labels == "" and by["rights reserved all"].score == 0


def test_repeated_rows_and_empty_table(spark):
    twice = spark.createDataFrame([(1, "cc by", "en", 1, "k")] * 2 + [(1, None, "en", 1, "k")], SCHEMA)
    assert sorted(r.n_base for r in licenses.license_scan(twice).collect()) == [0, 1, 1]
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def plain(texts):
    """Labels and best score of each text: every template at every place, without any index."""
    words = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(brute.LOWER)) for t in texts]
    library = licenses._library()
    seen = {v: sum(v in w for w in words) for v in {x for _, _, own, _ in library for x in own} - licenses.STOP}
    weighted = licenses._weighted(library, licenses.document_frequencies(library, seen), len(texts) + len(library))
    for w in words:
        labels, best = set(), 0.0
        for (label, _, own, key), entries in zip(library, weighted, strict=True):
            for start in range(-len(own), len(w)):
                there = {i: g for i, x, g in entries if 0 <= start + i < len(w) and w[start + i] == x}
                if {i for i in key if own[i] not in licenses.STOP} <= set(there) and sum(there.values()) >= licenses.SHARE:
                    labels.add(label)
                    best = max(best, min(1.0, sum(there.values())))
        yield ",".join(sorted(labels)), best


def test_notices_and_their_plain_version(spark):
    """On notices with words replaced: any at random, and up to 40 % of those beside the key phrase."""
    r = random.Random(4)
    texts = ["under the terms of the GNU Lesser General Public License as published by the FSF"]
    library = [x for x in licenses._library() if not x[1]]
    for _, _, w, key in library:
        beside = [i for i in range(len(w)) if i not in range(min(key), max(key) + 1)]
        for lost in (0, 1, len(w) // 4, len(w) // 2):
            texts.append(" ".join("zzz" if i in set(r.sample(range(len(w)), lost)) else x.capitalize() for i, x in enumerate(w)) + ". All rights reserved")
        for share in (0.2, 0.4):
            gone = set(r.sample(beside, int(share * len(beside))))
            texts.append("Some file.\n" + " ".join("zzz" if i in gone else x.upper() for i, x in enumerate(w)) + " End.")
    texts += ["reserved " * 3000 + "all rights reserved", None, "", " ".join(library[1][2]) * 2]
    got = {x.doc_id: x for x in licenses.license_scan(spark.createDataFrame([(i, t, "en", 1, "k") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for n, (labels, best) in enumerate(plain(texts)):
        assert got[n].labels == labels and abs(got[n].score - best) < 1e-9, texts[n]
    assert "lgpl" in got[0].labels.split(",")
    whole = range(1, 1 + 6 * len(library), 6)
    assert all(got[i].score > 0.999 and x[0] in got[i].labels.split(",") for i, x in zip(whole, library, strict=True))


def test_null_ids_and_no_python(spark):
    df = spark.createDataFrame([(None, "cc by", "en", 1, "k"), (None, "all rights reserved", "en", 1, "k")], SCHEMA)
    got = licenses.license_scan(df)
    assert sorted((r.doc_id, r.labels) for r in got.collect()) == [(None, "cc-by"), (None, "reserved")]
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Exchange"))
