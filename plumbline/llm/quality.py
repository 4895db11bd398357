"""Quality rules, line first (DataFrame functions only).

Every line is judged by itself: shouting or symbol-laden punctuation (most
words end in exclamation marks or carry symbols), navigation (words divided by
bars), boilerplate (short lines holding a stock phrase). Failed lines are
removed; a document that loses more than MOST_LOST percent of the code points
of its words is rejected, and so is one that fails the base rules: fewer than
LEAST_WORDS words, or more than MOST_REPEATED percent of its words in
eight-word windows that its text holds twice or more.

All of it is computed within the row of a document, in the JVM, without any
exchange: no group of documents exists that could be hot. Windows are compared
by 64-bit hashes of eight word hashes; only texts that have equal ones sort
theirs.

Edge cases: null text counts as empty (no words, base rules failed); white
space is the six ASCII characters; repeated rows are judged alike; ties cannot
arise; an empty table gives no rows; columns other than id and text are not
read. Very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import required

WINDOW = 8
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 20, 30, 50
SPACE = r"[\x20\x09-\x0D]+"
#: A line's share, in percent of its words, of runs of shouting or symbols, and of lone bars.
MOST_NOISY, MOST_BARS = 50, 20
NOISY = r"!{2,}|[#*$%&<>]{2,}"
BAR = r"(?<![^\x20\x09-\x0D])[|»>•·](?![^\x20\x09-\x0D])"
#: Stock phrases of lines that are no text, where the line is short (in code points).
BOILERPLATE = r"(?i)cookies?\b|privacy policy|terms of (?:use|service)|all rights reserved|sign up|log ?in\b|subscribe|javascript|click here|read more"
SHORT_LINE = 80


def words_of(text: Column) -> Column:
    """The words of a text (none for a blank one)."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _with_window_hashes(df: DataFrame, hashes: str) -> DataFrame:
    """A hash of each run of WINDOW words, by doubling; one column a step, as lambdas compute again what is no column.

    The last places have no partner in a step; the caller cuts what comes of them off.
    """
    span = 1
    while span < WINDOW:
        df = df.withColumn(hashes, F.zip_with(hashes, F.slice(hashes, F.lit(span + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b)))
        span *= 2
    return df


def _repeated_starts(ordered: Column) -> Column:
    """Of (hash, place) pairs in order: the places whose hash stands beside an equal one."""
    return F.filter(
        F.transform(ordered, lambda x, k: F.when((F.get(ordered, k - 1).h == x.h) | (F.get(ordered, k + 1).h == x.h), x.i)),
        lambda i: i.isNotNull(),
    )


def _covered_count(starts: Column) -> Column:
    following = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.lit(1 << 30)))
    return F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda acc, x: acc + x)


def line_failed(line: Column) -> Column:
    """Whether a line is noise, navigation or boilerplate (words are counted only where there is something to hold against them)."""
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    noisy, bars = F.regexp_count(line, F.lit(NOISY)), F.regexp_count(line, F.lit(BAR))
    return (
        ((noisy > 0) & (100 * noisy > MOST_NOISY * words))
        | ((bars > 0) & (100 * bars > MOST_BARS * words))
        | ((F.length(line) <= SHORT_LINE) & line.rlike(BOILERPLATE))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every text.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_chars (code points of words in removed lines) and
    cleaned (the lines left; null where rejected).
    """
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    split = texts.select("id", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = split.select(
        "id",
        "text",
        "lines",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).alias("chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.filter("lines", lambda x: ~line_failed(x)).alias("left"),
    )
    windows = _with_window_hashes(hashed, "hashes").withColumnRenamed("hashes", "windows")
    windows = windows.withColumn("windows", F.slice("windows", F.lit(1), F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))))
    # each in a step of its own: what a lambda reads has to be a column, or it is computed for every element
    ordered = windows.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    starts = ordered.withColumn("starts", F.array_sort(_repeated_starts(F.col("ordered")))).drop("ordered")
    measured = starts.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("starts").isNotNull(), _covered_count(F.col("starts"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.size("left") < F.size("lines"), F.col("chars") - F.length(F.regexp_replace(F.array_join("left", ""), SPACE, ""))).otherwise(0).cast("long").alias("lost_chars"),
        F.array_join("left", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lost_chars",
        F.when(F.col("kept"), F.col("cleaned")).alias("cleaned"),
    )
