"""Character patterns of values, and what they say.

A long pattern has A for each letter, N for each digit, Q for each quote, S for
each space, E for an empty text and NULL for none; a short pattern has one
letter for each run of A, N, E, S and of quotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters beyond ASCII that count as letters where wanted.
EUROPEAN = "À-ÿĀ-ſƀ-ɏḀ-ỿͰ-Ͽ"


def _replaced(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def long_pattern(c: Column, european: bool = False) -> Column:
    letters = f"[A-Za-z{EUROPEAN if european else ''}]"
    return F.when(c.isNull(), "NULL").when(c == "", "E").otherwise(_replaced(c, (letters, "A"), ("[0-9]", "N"), ("['\"]", "Q"), (" ", "S")))


def short_pattern(c: Column, european: bool = False) -> Column:
    letters = f"[A-Za-z{EUROPEAN if european else ''}]+"
    return F.when(c.isNull(), "NULL").when(c == "", "E").otherwise(_replaced(c, (letters, "A"), ("[0-9]+", "N"), ("['\"]+", "Q"), (" +", "S")))


def space_class(short: Column) -> Column:
    """leading, trailing, inner, outer or none, by the short pattern (the last that fits holds)."""
    return (
        F.when(short.rlike("^[S].*[^S]+.*[^S]+.*[S]$"), "outer")
        .when(short.rlike("^[^S].*[S]+.*[^S]$"), "inner")
        .when(short.rlike("^[^S].*[S]+$"), "trailing")
        .when(short.rlike("^[S]+.*[^S]$"), "leading")
        .otherwise("no_space")
    )


def character_class(short: Column) -> Column:
    """What a value is made of."""
    return (
        F.when(short == "NULL", "null")
        .when(short == "E", "empty")
        .when(short == "S", "space")
        .when(short == "A", "alpha")
        .when(short == "N", "digit")
        .when(short.rlike("^[AN]+$"), "alphanumeric")
        .when(short.rlike("^[ANS]+$"), "with_space")
        .otherwise("special")
    )


def pattern_regex(pattern: str, short: bool) -> str:
    """A regular expression of the values that have a pattern."""
    signs = {"A": "[A-Za-z]", "N": "[0-9]", "S": "[ ]", "Q": "['\"]"}
    out = []
    for ch in pattern:
        out.append(signs[ch] + ("+" if short else "") if ch in signs else "\\" + ch if not ch.isalnum() else ch)
    return "^" + "".join(out) + "$"


#: Classes of texts by whole-value regular expressions (our own; of the syntax that Java and RE2 share).
CONTACTS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9 ()/.-]{5,18}[0-9]",
    "ip": r"((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])",
    "url": r"(https?|ftp)://[^ /?#]+([/?#][^ ]*)?",
    "uuid": r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "name": r"[A-Z][a-z]+( [A-Z]\.)?( [A-Z][a-z]+)+",
}


def sign(long: Column) -> Column:
    """negative, positive or null, by the pattern of a number: every N stands for a one."""
    number = F.regexp_replace(long, "N", "1").try_cast("double")
    return F.when(number < 0, "negative").when(number > 0, "positive")
