"""The corpus pipeline against the plain versions of its stages, one after the other."""

import random

import corpus_pipeline
from plumbline.llm import bpe, toxicity
from plumbline.llm.queries import vocabulary
from tests.llm import brute


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    r = random.Random(11)
    word = lambda: f"n{r.randrange(900)}"
    passage, item = [word() for _ in range(60)], [word() for _ in range(20)]
    docs, labels = [], []
    for i in range(160):
        w = [word() for _ in range(r.choice([4, 90, 200]))]
        bad = i % 6 == 0
        if bad:
            for _ in range(7):
                w[r.randrange(len(w))] = r.choice(["vile", "scumbag", "rotten"])
        elif i % 7 == 0:
            w += passage
        elif i % 11 == 0:
            w += item
        elif i % 13 == 0 and docs:
            w = (docs[r.randrange(len(docs))][1] or "").split() + ["end"] * (i % 2)
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (503, docs[3][1]), (3, docs[3][1])]
    return docs, labels, [(1, " ".join(item)), (2, " ".join(passage[:15] + ["other"])), (3, None)]


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, labels, items = corpus()
    tables(spark, str(tmp_path), docs, labels, items)
    toxic = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("predicted = 1").collect()}
    bad = {i for i, t in docs if {"vile", "scumbag", "rotten"} & set((t or "").split())}
    assert len(toxic & bad) >= 20 and not toxic - bad
    left = [(i, t) for i, t in docs if i not in toxic]
    groups = brute.jaccard_components(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    gone = brute.substring_dedup(left)
    kept = brute.substring_texts(left)
    left = [(i, t if not gone[i][1] else kept[i]) for i, t in left if not gone[i][1] or gone[i][1] < gone[i][0]]
    hit = brute.contained(left, items)
    left = [(i, t) for i, t in left if not hit[i]]
    code = bpe.coder(vocabulary())
    want = sorted((i, *bpe._result(code.encode(t or ""), code)) for i, t in left)
    assert len(want) < len(docs) - 40 and any(gone[i][1] for i in gone)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns


def test_null_ids_and_an_empty_table(spark, tmp_path):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    tables(spark, f"{tmp_path}/n", [(None, a), (None, b), (4, a), (4, b), (5, "x y")], [], [])
    got = corpus_pipeline.run(spark, f"{tmp_path}/n").collect()
    assert sorted(((r.doc_id, r.n_tokens > 3) for r in got), key=str) == [(4, True), (4, True), (5, False)]
    tables(spark, f"{tmp_path}/e", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").collect() == []
