"""Ranked search against scores of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from plumbline.llm import ranked
from tests.llm.brute import LOWER

DOCS = "doc_id long, text string, term int, item int, score string"
ITEMS = "item_id long, text string, doc_id string, rank int"


def terms(text):
    return re.findall(ranked.TERM, (text or "").translate(LOWER))


def plain(docs, items, most):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        q = Counter(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in q}
        scores = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(k * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def tables():
    r = random.Random(4)
    vocab = ["the", "The", "of", "1984", "naïve", "ÜBER", "x_y", "a-b", *(f"w{i}" for i in range(80))]
    docs = [(None, "the w1 w2 w3"), (0, None), (1, ""), (2, "?!"), (3, "w1"), (3, "w1"), (3, "w2 w2 w2"), (4, "w5 " * 3000)]
    for i in range(5, 250):
        docs.append((i, docs[-1][1] if r.random() < 0.2 else " ".join(r.choice(vocab[: r.choice([6, 20, len(vocab)])]) for _ in range(r.choice([1, 10, 80])))))
    items = [(0, None), (1, "..."), (2, "never_seen"), (3, "the of the"), (4, "w1 w1 w5 1984"), (4, "w5"), (5, "Naïve ÜBER, x_y a-b"), (5, "Naïve ÜBER, x_y a-b"), (None, "w7 w8")]
    items += [(10 + k, " ".join(r.choice(vocab) for _ in range(12))) for k in range(15)]
    return docs, items


@pytest.mark.parametrize("block, most, item_terms", [(64, 20, 500_000), (2, 3, 40)])
def test_equals_scores_of_all_documents(spark, monkeypatch, block, most, item_terms):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "ITEM_TERMS", item_terms)
    docs, items = tables()
    got = ranked.ranked(
        spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "d", 3) for i, t in items], ITEMS), most
    ).select("item_id", "rank", "doc_id", "score")
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain(docs, items, most)


def test_blocks_are_skipped(spark, monkeypatch):
    """A rare passage needs few documents scored, though most share its common words."""
    monkeypatch.setattr(ranked, "BLOCK", 4)
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["the", "of", "and", *(f"v{k}" for k in range(400))]) for _ in range(60))) for i in range(600)]
    passage = " ".join(f"rare{k}" for k in range(12))
    docs += [(1000 + i, f"{passage} the of {i}") for i in range(25)]
    q = ranked.queries([type("R", (), {"terms": terms(passage + " the of v1 v2")})])
    floor = ranked.np.array([12 * 5_000_000])
    highest = ranked.np.array([6_000_000 if t.startswith("rare") else 1_000_000 for t in q.vocabulary])
    assert sorted(q.vocabulary[t] for t in q.terms[ranked._essential(q, highest, floor)])[0].startswith("rare")
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage + " the of v1 v2")], "item_id long, text string")
    assert sorted((tuple(x) for x in ranked.ranked(*frames).collect()), key=str) == plain(docs, [(1, passage + " the of v1 v2")], 20)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "w1", 1, 2, "s")], DOCS), spark.createDataFrame([(1, "w1", "d", 3)], ITEMS)
    for d, i in ((docs, items), (docs, some[1]), (some[0], items)):
        got = ranked.ranked(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    assert [tuple(x) for x in ranked.ranked(*some).collect()] == plain([(1, "w1")], [(1, "w1")], 20)
