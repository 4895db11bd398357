"""Fingerprints: edited texts against a plain version, sums against summing anew, likeness against true counts."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import fingerprints
from tests.llm.brute import WORD

SCHEMA = "doc_id long, text string, k string, h string, n int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "h", 1, "v") for i, t in rows], SCHEMA)


def corpus():
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    texts = [None, "", "\n", "\n\n", "x", "é", "日本語テキスト", " a  b\tc ", "one\n", line(4000)]
    texts += ["\n".join(line(r.choice([1, 5, 40])) for _ in range(r.choice([1, 2, 9]))) for _ in range(60)]
    return [(3 * i, t) for i, t in enumerate(texts)] + [(500, texts[20]), (501, texts[20])]


def edited(rows):
    """By plain slicing; rows are one for each id."""
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda x: x[0])]
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        out[i] = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
    return out


def pairs(text):
    out = Counter()
    for p in (text or "").split("\n"):
        w = WORD.findall(p)
        out.update(zip([None, *w], w, strict=False))
    return out


def like(a, b):
    both = sum(x * x for x in a.values()) + sum(x * x for x in b.values())
    return 2 * sum(x * b[p] for p, x in a.items()) / both if both else 1.0


def anew(spark, texts):
    """Fingerprints summed from nothing."""
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    v = fingerprints.vectors(rows.select("id", fingerprints.paragraphs(F.col("text")).alias("paragraphs")), ["id"])
    return {r.id: r.f for r in v.select("id", fingerprints.fingerprint(F.col("vector")).alias("f")).collect()}


def test_edited_texts(spark):
    rows = corpus()
    got = {r.doc_id: r for r in fingerprints.with_edited(frame(spark, rows)).collect()}
    want = edited(rows)
    assert sorted(got) == sorted(want)
    first, second = anew(spark, {i: t or "" for i, t in rows}), anew(spark, want)
    ids = sorted(got)
    for at, i in enumerate(ids):
        text = dict(rows)[i] or ""
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        # inserting and deleting paragraphs gives what summing anew gives
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (first[i], second[i])
        after = dict(rows)[ids[(at + 1) % len(ids)]] or ""
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if len(pairs(text)) > 30:
            assert abs(got[i].near_edited - like(pairs(text), pairs(want[i]))) < 0.4
            assert abs(got[i].near_next - like(pairs(text), pairs(after))) < 0.4
    assert got[500].fingerprint == got[501].fingerprint == got[60].fingerprint and got[500].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for _, t in rows})


def test_order_and_updates(spark):
    a, b, c = "first line here", "second one", "third\tline of words"
    found = anew(spark, {1: f"{a}\n{b}\n{c}", 2: f"{c}\n{a}\n{b}", 3: f"{a}\n{b}", 4: f"{a}\n{b}\n{c}\n{c}"})
    assert found[1] == found[2] and len(set(found.values())) == 3
    rows = spark.createDataFrame([(1, [a, b, c]), (2, [c]), (3, [a, b])], "id long, paragraphs array<string>")
    v = {r.id: r.vector for r in fingerprints.vectors(rows, ["id"]).collect()}
    one = spark.createDataFrame([(v[1], v[2], v[3])], "w array<long>, x array<long>, y array<long>").select(
        fingerprints.fingerprint(fingerprints.deleted(F.col("w"), F.col("x"))), fingerprints.fingerprint(F.col("y")),
        fingerprints.fingerprint(fingerprints.inserted(F.col("y"), F.col("x"))), fingerprints.fingerprint(F.col("w")),
    ).first()
    assert one[0] == one[1] and one[2] == one[3]


def test_rows(spark):
    """Repeated rows, one id with several texts, none with an id, one document, none."""
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "x y"), (None, "no id"), (None, None), (7, "last")]
    got = fingerprints.with_edited(frame(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(str((i, len(t or ""))) for i, t in rows)
    assert len({tuple(r) for r in got}) == len(got) - 1
    sole = fingerprints.with_edited(frame(spark, [(5, "abc def")])).first()
    assert sole.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and sole.near_next == 1.0
    none = fingerprints.with_edited(frame(spark, []))
    assert none.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and none.count() == 0


def test_paragraph_order_is_no_python(spark):
    plan = fingerprints.vectors(spark.createDataFrame([(1, ["a"])], "id long, paragraphs array<string>"), ["id"])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
