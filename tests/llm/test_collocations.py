"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import collocations
from tests.llm.brute import LOWER

SCHEMA = "lang string, text string, w1 string, f int, doc_id long"


def plain(docs, least, most):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    rows = []
    for p, a in f.items():
        if len(p) < 3 or a < least:
            continue
        if any(100 * f[q] >= collocations.COVERED * a for q in f if len(q) == 4 > len(p) and q[0] == p[0] and p[1:] in (q[1:3], q[2:4]) and f[q] >= least):
            continue
        cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        rows.append((p[0], -score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    out, rank = [], Counter()
    for lang, s, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return out


def corpus():
    r = random.Random(2)
    vocab = ["The", "the", "of", "new", "york", "ünder", "Ünder", "x|y", "a\x00b", *(f"w{i}" for i in range(60))]
    docs = [(None, None), ("en", ""), ("en", " \t\n"), (None, "the the the the the the the the the the the the"), ("und", "the the"), ("de", "short")]
    for _ in range(150):
        words = [r.choice(vocab[: r.choice([4, 9, len(vocab)])]) for _ in range(r.choice([1, 8, 60]))]
        words[r.randrange(len(words)) :] += ["new", "york", "city"]
        docs.append((r.choice(["en", "de", None]), "".join(w + r.choice([" ", " ", "\t", "  ", ", ", ".\n", "\x0b"]) for w in words)))
    return docs + docs[-20:]


@pytest.mark.parametrize("hot, most", [(10**9, 2000), (1, 7)])
def test_equals_a_plain_count(spark, monkeypatch, hot, most):
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "BUCKET", 100)
    docs = corpus()
    frame = spark.createDataFrame([(lang, text, "x", 1, 5) for lang, text in docs], SCHEMA)
    got = sorted(tuple(r) for r in collocations.collocations(frame, 4, most).collect())
    assert got == sorted(plain(docs, 4, most))
    assert len(got) > 20


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_three_way_sort_gives_all_counts():
    r = np.random.default_rng(1)
    keys = r.integers(-1, 6, (4, 3000))
    for d in range(1, 4):  # a pointer that has ended stays so
        keys[d][keys[d - 1] == -1] = -1
    weight = r.integers(1, 4, 3000)
    want = Counter()
    for k in range(3000):
        for d in range(4):
            if keys[d, k] == -1:
                break
            want[tuple(keys[: d + 1, k])] += int(weight[k])
    got = {}
    for depth, sample, total in collocations.three_way_sorted(keys, weight, 5):
        for s, t in zip(sample, total, strict=True):
            assert tuple(keys[: depth + 1, s]) not in got
            got[tuple(keys[: depth + 1, s])] = int(t)
    assert got == {k: v for k, v in want.items() if v >= 5}
