"""Null and repeated ids, repeated rows, clashing columns: every operator gives every row its result."""

import time

import numpy as np
import pytest

from plumbline.llm import archives, bpe, contamination, jaccard, substring, toxicity
from plumbline.llm.queries import vocabulary
from tests.llm import brute

SCHEMA = "doc_id long, text string, id string, h int, key string, cls int"
A = " ".join(f"a{i}" for i in range(80))
B = " ".join(f"b{i}" for i in range(70))
NEAR = A + " more"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2) for i, t in rows], SCHEMA)


ROWS = [(1, A), (2, A), (2, A), (2, B + " " + A), (None, A), (None, B), (None, NEAR), (3, B), (4, None), (4, ""), (5, "short")]


def test_substring(spark):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(frame(spark, ROWS)).collect()), key=str)
    # A is removed from rows of id 2; B of id 3 stands in id 2 already; rows without an id keep all
    want = [(1, 80, 0), (2, 80, 80), (2, 80, 80), (2, 150, 80), (None, 80, 0), (None, 70, 0), (None, 81, 0), (3, 70, 70), (4, 0, 0), (4, 0, 0), (5, 1, 0)]
    assert got == sorted(want, key=str)


def test_substring_run_of_one_word_is_one_block():
    words, at = np.full(100_000, 7, np.uint64), np.array([0, 60_000, 100_000])
    doc, key, content, first, last = substring.blocks(words, at, 50)
    assert doc.tolist() == [0, 1] and len(set(key)) == len(set(content)) == 1
    assert first.tolist() == [0, 0] and last.tolist() == [60_000 - 50, 40_000 - 50]


def test_jaccard(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(frame(spark, ROWS)).collect()), key=str)
    want = [(1, 76, 1), (2, 76, 1), (2, 76, 1), (2, 146, 2), (None, 76, 1), (None, 66, 3), (None, 77, 1), (3, 66, 3), (4, 0, 4), (4, 0, 4), (5, 1, 5)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_contamination_gives_equal_rows_at_any_number_of_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(contamination, "BLOCK_SHINGLES", most)
    items = [(1, " ".join(f"a{i}" for i in range(20))), (1, "b1 b2 b3 b4 b5 b6"), (2, "b1 b2"), (None, A), (3, " ".join(f"b{i}" for i in range(60))), (4, None)]
    got = sorted(((r.doc_id, r.contaminated, r.n_items, r.item_ids) for r in contamination.contamination(frame(spark, ROWS), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    plain = brute.contained([(k, t) for k, (_, t) in enumerate(ROWS)], [x for x in items if x[0]])
    assert got == sorted(((i, bool(plain[k]), len([x for x in plain[k].split(",") if x]), plain[k]) for k, (i, _) in enumerate(ROWS)), key=str)
    none = contamination.contamination(frame(spark, ROWS), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(ROWS) and not any(r.contaminated for r in none)
    assert contamination.contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_toxicity(spark):
    texts = [f"vile{i % 2} rotten scum awful words {i}" if i % 2 else f"kind good day to you {i}" for i in range(60)]
    rows = [*enumerate(texts), (None, texts[1]), (1, texts[1]), (1, None), (1, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.toxicity(frame(spark, []), labels).collect() == []


def test_archives_null_and_repeated_ids(spark):
    pages = [(2, "http://a/", "same"), (None, "http://b/", "same"), (2, "http://c/", "same"), (7, None, "same"), (None, "http://d/", None), (9, "u", "")]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archives.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()), key=str)
    want = [(2, 4, "response", None), (2, 4, "response", None), (7, 4, "revisit", 2), (None, 4, "revisit", 2), (None, 0, "revisit", 9), (9, 0, "response", None)]
    assert got == sorted(want, key=str)


def test_label_model_recovers_planted_voters():
    r = np.random.default_rng(3)
    y = r.random(8000) < 0.3
    hit, false = r.uniform(0.3, 0.9, 12), r.uniform(0.01, 0.1, 12)
    v = (r.random((8000, 12)) < np.where(y[:, None], hit, false)).astype(float)
    v[:, 5] = np.where(r.random(8000) < 0.9, v[:, 4], v[:, 5])  # nearly a copy of its neighbour
    model = toxicity.LabelModel(v)
    assert {model.parent[5], model.parent[4]} & {4, 5}
    free = [j for j in range(12) if model.parent[j] < 0]
    assert np.abs(model.rates[0, 1, free] - hit[free]).max() < 0.05 and np.abs(model.rates[0, 0, free] - false[free]).max() < 0.03
    assert ((model.posterior > 0.5) == y).mean() > 0.97


def test_long_texts(spark):
    word = "word " * 200_000
    began = time.time()
    got = {r.doc_id: r for r in substring.substring_dedup(frame(spark, [(1, word), (2, word + "end")])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 200_000 and got[2].kept == "end"
    assert {r.component_id for r in jaccard.ngram_jaccard_join(frame(spark, [(1, word), (2, "word " * 300)])).collect()} == {1}
    assert len(bpe.bpe_round_trip(frame(spark, [(1, word)]), vocabulary()).collect()) == 1
    assert time.time() - began < 600


def test_marks_of_writing():
    texts = [b"", b"hey!!! no!! ok! aaa bbbb cc f**k a@b@@c $a a$ AAa\nsss", b"s", b"!!"]
    assert toxicity.marks(texts).tolist() == [[0, 0, 0], [2, 3, 4], [0, 0, 0], [1, 0, 0]]


def test_substring_short_periods_are_few_blocks():
    r = np.random.default_rng(3)
    for period in (2, 7, 24, 25):
        turn = r.integers(0, 1 << 60, period).astype(np.uint64)
        words = np.tile(turn, 200_000 // period)
        doc, key, content, first, last = substring.blocks(words, np.array([0, len(words)]), 50)
        assert len(key) < 100 and first[0] == 0 and last[-1] == len(words) - 50
        # equal windows have one key, whatever stands around them
        odd = np.concatenate((r.integers(0, 1 << 60, 90).astype(np.uint64), words[period // 2 :][:70], r.integers(0, 1 << 60, 90).astype(np.uint64)))
        _, other, _, begin, end = substring.blocks(odd, np.array([0, len(odd)]), 50)
        assert other[(begin <= 95) & (end >= 95)][0] == key[0]


def test_substring_periodic_texts(spark):
    r = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        period = [f"p{r.integers(4)}" for _ in range(r.integers(1, 30))]
        around = [f"u{r.integers(10**6)}" for _ in range(r.integers(0, 60))]
        texts.append(" ".join(around + (period * 200)[: r.integers(20, 300)] + around[::-1]))
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring.substring_dedup(frame(spark, rows)).collect()}
    assert got == {i: (len(w), len(w) - len(kept), " ".join(kept)) for i, (w, kept) in brute.substring_kept(rows).items()}


def test_toxicity_limits_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", 10)
    taken = []
    monkeypatch.setattr(toxicity, "_trained", lambda rows: taken.append(rows.count()) or toxicity.Model(np.zeros(0, np.uint64), None, 0.0))
    rows = [(i, f"text {i} {k}", "x", 1, "k", 2) for i in range(2, 40) for k in range(50)] + [(5, "again", "x", 1, "k", 2)] * 300 + [(6, None, "x", 1, "k", 2)] * 3
    toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert taken == [10]


def test_archives_exchange_no_payloads(spark, monkeypatch):
    """With broadcast off, nothing that an archive holds is under an exchange of the conversion."""
    seen = []
    real = archives._convert

    def watched(session, arc, warc, index):
        names = session.read.format("binaryFile").load(arc).select("path")
        seen.append(names._jdf.queryExecution().toString())
        return real(session, arc, warc, index)

    monkeypatch.setattr(archives, "_convert", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([(i, f"http://x/{i}", "same" if i % 3 else f"own {i}") for i in range(30)], "page_id long, url string, html string")
        got = {r.page_id: (r.record_type, r.refers_to) for r in archives.round_trip(pages).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: ("response", None) if i % 3 == 0 or i == 1 else ("revisit", 1) for i in range(30)}
    assert seen and "content" not in seen[0].partition("Physical Plan")[2]
