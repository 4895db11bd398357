"""Null ids, repeated rows, clashing columns and very long texts, and a plain version of the line rules."""

import random
import re

from plumbline.llm import contamination, quality, toxicity, url_lists
from tests.llm import brute

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_url_filter_judges_every_row(spark):
    captures = spark.createDataFrame(
        [(None, "http://a.b.org/x", 50, "v", 1), (None, "http://a.b.org/x", 50, "v", 1), (3, "http://a.b.org/x", 50, "v", 1), (3, "http://a.b.org/x", 5, "v", 1), (4, None, 50, "v", 1), (5, "http://b.org/", None, "v", 1), (None, "no url", 50, "v", 1)],
        "page_id long, url string, fetched_at long, value string, period int",
    )
    entries = spark.createDataFrame([("domain:b.org", "add", 10, "x"), ("domain:b.org", "add", 10, "x"), (None, "add", 1, "x")], "value string, action string, at long, host string")
    got = sorted(((r.page_id, r.fetched_at, r.blocked, r.n_active) for r in url_lists.url_filter(captures, entries).collect()), key=str)
    assert got == sorted([(None, 50, True, 1), (None, 50, True, 1), (3, 50, True, 1), (3, 5, False, 0), (4, 50, False, 0), (5, None, False, 0), (None, 50, False, 0)], key=str)


def line_fails(line):
    n = len(WORDS.findall(line))
    noisy, bars = len(re.findall(quality.NOISY, line)), len(re.findall(quality.BAR, line))
    return (noisy and 100 * noisy > quality.MOST_NOISY * n) or (bars and 100 * bars > quality.MOST_BARS * n) or (len(line) <= quality.SHORT_LINE and re.search(quality.BOILERPLATE, line))


def plain_verdict(text):
    text = text or ""
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    size = lambda x: len("".join(WORDS.findall(x)))
    lost = sum(size(x) for x in lines if line_fails(x))
    kept = not brute.quality(text)[-1] and 100 * lost <= quality.MOST_LOST * size(text)
    return kept, lost, "\n".join(x for x in lines if not line_fails(x)) if kept else None


def test_line_rules_equal_a_plain_version(spark):
    r = random.Random(6)
    pieces = ["plain words here and there", "BUY!! NOW!! cheap##", "home | news | shop", "We use cookies.", "x » y", "read more", "ok! fine!", "a|b", "long " * 30 + "subscribe", "•", "§ $% &&& *"]
    texts = [None, "", "\n\n"] + ["\n".join(r.choice(pieces) + str(r.randrange(99)) * r.randrange(2) for _ in range(r.randrange(1, 14))) for _ in range(120)]
    texts.append("\n".join(f"line {i} of a very long text" for i in range(30_000)))
    df = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, "x", 1, "l") for i, t in enumerate(texts)], "doc_id long, text string, id string, n int, lines string")
    got = sorted(((x.doc_id, x.kept, x.lost_chars, x.cleaned) for x in quality.quality_rules(df).collect()), key=str)
    assert got == sorted(((None if i % 9 == 0 else i // 2, *plain_verdict(t)) for i, t in enumerate(texts)), key=str)
    assert 10 < sum(k for _, k, _, _ in got) < len(texts) - 10


def test_long_texts(spark):
    item = " ".join(f"b{i}" for i in range(30))
    long = " ".join(f"w{i}" for i in range(150_000)) + " " + item + " " + " ".join(f"z{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("b7 ", "")), (None, item)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.contaminated) for r in contamination.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()), key=str)
    assert got == sorted([(1, True), (2, True), (None, True)], key=str)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, labels).collect())
