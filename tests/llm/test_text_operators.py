import hashlib
import random

import pytest

from plumbline.llm import bpe, contamination, jaccard, substring, toxicity
from plumbline.llm.queries import vocabulary
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, cls int, key string"


def corpus(seed=3, n=120):
    """Texts with copies, near copies, shared passages, repeats and odd cases."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["über", "<|endoftext|>", "naïve", "the", "the", "the"]
    passage = [r.choice(vocab) for _ in range(70)]
    texts = [None, "", "   \n\t", "one", "two words", "A b c D e", " x \x85y", "x" * 5000, "the " * 700]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.25 and len(texts) > 12:
            texts.append(texts[r.randrange(len(texts))])
        elif kind < 0.55 and len(texts) > 12:
            w = (texts[r.randrange(len(texts))] or "").split(" ")
            for _ in range(r.choice([1, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
        else:
            w = [r.choice(vocab) for _ in range(r.choice([3, 20, 60, 300]))]
            if kind > 0.8:
                at = r.randrange(len(w))
                w[at:at] = passage[r.randrange(15) :]
            texts.append(r.choice([" ", "  ", "\n"]).join(w))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "k") for i, t in corpus()], SCHEMA)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation(), t.no_padding()
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs, vocabulary()).collect()}
    assert len(got) == len(corpus())
    for i, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _shared():
    """Two texts of several chunks that share some, and a short one."""
    r = random.Random(5)
    common, own = (" ".join(f"w{r.randrange(5000)}" for _ in range(2000)) for _ in range(2))
    return [common + " " + own, common + " end", "short one"]


@pytest.mark.parametrize(
    "ids",
    [
        [(3, 2), (7, 2), (7, 2)],
        [(3, 2), (3, 2), (7, 2)],
        [(7, 2), (7, 2)],
        [(3, 0), (7, 0), (7, 1)],
        [(3, 1), (7, 1), (7, 0)],
        [(3, 2), (7, 2), (7, 0), (9, 1)],
        [(3, 2), (7, 2), (7, 1), (9, 0)],
        [(None, 0), (None, 0), (None, 1), (4, 1)],
    ],
)
def test_bpe_gives_every_row_its_result(spark, ids):
    texts, code = _shared(), bpe.coder(vocabulary())
    assert set(bpe.chunks(texts[0].encode())) & set(bpe.chunks(texts[1].encode()))
    got = bpe.bpe_round_trip(spark.createDataFrame([(i, texts[t]) for i, t in ids], "doc_id long, text string"), vocabulary()).collect()
    assert sorted(map(tuple, got), key=lambda x: (x[0] or 0, x[1:])) == sorted(((i, *bpe._result(code.encode(texts[t]), code)) for i, t in ids), key=lambda x: (x[0] or 0, x[1:]))


def test_jaccard_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(docs).collect()}
    assert got == brute.jaccard_components(corpus())


def test_substring_dedup(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(substring.substring_dedup(docs)).collect()}
    assert got == brute.substring_dedup(corpus())


def test_contamination(spark, docs):
    items = [(1, "w1 w2"), (2, corpus()[40][1]), (3, None), (4, ""), (5, " ".join((corpus()[60][1] or "x").split()[:12])), (5, "the the the the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in contamination.contamination(docs, bench).collect()}
    assert got == brute.contained(corpus(), items)


def test_toxicity_learns_and_handles_edges(spark, docs):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = r.random() < 0.2
        w = [f"n{r.randrange(300)}" for _ in range(60)]
        if bad:
            for _ in range(6):
                w[r.randrange(60)] = r.choice(["vile", "scumbag", "rotten"])
        rows.append((i, " ".join(w), "en", int(bad), "k"))
        labels.append((i, int(bad)))
    got = toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [x for x in got if x.held_out]
    assert held and sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.score for x in toxicity.toxicity(docs, none).collect()} == {0.0}


def test_toxicity_judges_rare_words_among_many_common_ones(spark):
    common = " ".join(f"{i:05d}" for i in range(21_000))
    rows = [(i, common + (" vile" if i % 2 and i > 8 else ""), i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels).lexicon) == 1


@pytest.mark.parametrize("run", [lambda d: bpe.bpe_round_trip(d, vocabulary()), jaccard.ngram_jaccard_join, substring.substring_dedup])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
