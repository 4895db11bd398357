import random

from plumbline.llm import quality
from tests.llm import brute
from tests.llm.test_text_operators import SCHEMA, corpus


def test_base_columns_equal_brute_force(spark):
    r = random.Random(5)
    texts = [t for _, t in corpus(9, 60)]
    for _ in range(60):
        w = [r.choice("abcde") for _ in range(r.choice([7, 8, 9, 16, 40, 90]))]
        texts.append("".join(x + r.choice([" ", "\n", "\n\n", "\x0b", " | "]) for x in w))
    texts += ["a\nb\na\n\n \n \na", "x" * 9, "# * $ % & | < >\n" * 4, "  é  q"]
    df = spark.createDataFrame([(i, t, "en", 1, "k") for i, t in enumerate(texts)], SCHEMA)
    rows = quality.quality_rules(df).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute.quality(texts[x.doc_id])
        assert not (x.base_failed and x.kept)


def test_lines_are_judged(spark):
    good = " ".join(f"word{i}" for i in range(40)) + "."
    nav = "home | news | sport | wetter | kontakt | shop"
    shout = " ".join(f"BUY{i}!!" for i in range(60))
    texts = [good, good + "\n" + nav, shout + "\n" + good, nav + "\n" + "\n".join(nav + str(i) for i in range(20))]
    got = {x.doc_id: x for x in quality.quality_rules(spark.createDataFrame([(i, t, "en", 1, "k") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i].kept for i in range(4)] == [True, True, False, False]
    assert got[1].cleaned == good and got[0].lost_chars == 0 and got[3].cleaned is None


def test_empty(spark):
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
