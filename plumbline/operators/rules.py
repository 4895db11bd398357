"""Rules: conditions, lookups, comparisons, groups, and the rows that break them."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.health import score

OPERATORS = {
    "eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le,
    "between": lambda c, v: c.between(*v), "notbetween": lambda c, v: ~c.between(*v), "in": lambda c, v: c.isin(*v),
    "like": lambda c, v: c.like(v), "matches": lambda c, v: c.rlike(v), "contains": lambda c, v: c.contains(v),
    "starts": lambda c, v: c.startswith(v), "ends": lambda c, v: c.endswith(v),
    "null": lambda c, v: c.isNull(), "length_between": lambda c, v: F.length(c).between(*v),
}


def rule(spec: dict) -> Column:
    """A predicate from nested groups.

    A group is {"all" or "any": [...]} or {"not": ...}; a leaf has column, op
    and value. What a leaf can't decide (nulls) counts as not met.
    """
    if "not" in spec:
        return ~rule(spec["not"])
    for word, fold in (("all", operator.and_), ("any", operator.or_)):
        if word in spec:
            return reduce(fold, map(rule, spec[word]))
    return F.coalesce(OPERATORS[spec["op"]](F.col(spec["column"]), spec.get("value")), F.lit(False))


def measured(df: DataFrame, rules: dict[str, Column], weights: dict[str, float] | None = None) -> DataFrame:
    """All rules in one scan: rule, total_count, valid_count, invalid_count, score."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(p).alias(f"v{i}") for i, p in enumerate(rules.values())))
    rows = F.array(*(F.struct(F.lit(k).alias("rule"), F.col("n").alias("total_count"), F.col(f"v{i}").alias("valid_count"), F.lit(float((weights or {}).get(k, 100))).alias("weight")) for i, k in enumerate(rules)))
    out = one.select(F.inline(rows))
    share = F.when(F.col("total_count") > 0, F.least(F.lit(100.0), 100.0 * F.col("valid_count") / F.col("total_count") * F.col("weight") / 100))
    return out.select("rule", "total_count", "valid_count", (F.col("total_count") - F.col("valid_count")).alias("invalid_count"), F.round(share, 4).alias("score"))


def failed_rows(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per rule and row that breaks it, with its identifier key."""
    broken = F.array_compact(F.array(*(F.when(~p, F.lit(k)) for k, p in rules.items())))
    return df.select(*keys, identifier(keys).alias("identifier_key"), F.explode(broken).alias("rule"))


def failed_summary(failed: DataFrame) -> DataFrame:
    """Per identifier key: the rules broken, as JSON."""
    return failed.groupBy("identifier_key").agg(F.count("*").alias("n_rules"), F.to_json(F.array_sort(F.collect_set("rule"))).alias("rules"))


def identifier(columns: list[str]) -> Column:
    """md5 of the values, nulls as empty ones, joined by bars."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def without_accepted(failed: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows whose key was marked as normal go."""
    return failed.join(accepted.select("identifier_key").distinct(), "identifier_key", "left_anti")


def lookup(df: DataFrame, column: str, library: DataFrame, key: str) -> DataFrame:
    """How many rows have their value in the library: total, found and missing."""
    known = library.select(F.col(key).alias("known")).where("known is not null").distinct().withColumn("hit", F.lit(1))
    # values are counted first, so that a value of very many rows is one row of the join
    values = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    joined = values.join(known, F.col("value") == F.col("known"), "left")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("valid_count")).withColumn(
        "invalid_count", F.col("total_count") - F.col("valid_count")
    )


def compare_keys(source: DataFrame, target: DataFrame, source_columns: list[str], target_columns: list[str]) -> DataFrame:
    """Matched and unmatched rows on both sides; keys are compared as texts, nulls as equal, repeats as matched."""

    def side(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        return df.groupBy(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns))).agg(F.count("*").alias(name))

    a, b = side(source, source_columns, "s").alias("a"), side(target, target_columns, "t").alias("b")
    same = reduce(operator.and_, (F.col(f"a.k{i}").eqNullSafe(F.col(f"b.k{i}")) for i in range(len(source_columns))))
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return a.join(b, same, "full_outer").agg(
        total("s", F.col("t").isNotNull()).alias("source_matched"), total("s", F.col("t").isNull()).alias("source_unmatched"),
        total("t", F.col("s").isNotNull()).alias("target_matched"), total("t", F.col("s").isNull()).alias("target_unmatched"),
    )


def grouped_scores(df: DataFrame, by: list[str], valid: Column, weight: float = 100.0) -> DataFrame:
    """Rule counts and score per group."""
    counted = df.groupBy(*by).agg(F.count("*").alias("total_count"), F.count_if(valid).alias("valid_count"))
    return counted.withColumn("score", F.round(score(F.col("valid_count"), F.col("total_count"), weight), 4))


def overall(groups: DataFrame) -> DataFrame:
    """The mean of group scores to three places, and the valid rows it stands for (in whole numbers, so that no tie depends on an engine's floats)."""
    one = groups.agg(F.count("*").alias("n_groups"), F.sum("total_count").alias("total_count"), F.sum(F.round(F.col("score") * 10_000).cast("long")).alias("s"))
    return one.select("n_groups", "total_count", (F.expr("(2 * s + 10 * n_groups) div (20 * n_groups)") / 1000).alias("score"), F.expr("(s * total_count) div (1000000 * n_groups)").alias("valid_count"))


def pass_statistics(scores: DataFrame, by: list[str], least: float) -> DataFrame:
    """Rules per group, and how many passed and failed (``rule``, ``score``)."""
    name = lambda met: F.count_distinct(F.when(met, F.col("rule")))
    return scores.groupBy(*by).agg(F.count_distinct("rule").alias("n_rules"), name(F.col("score") >= least).alias("passed"), name(F.col("score") < least).alias("failed"))


def cross_source(frames: dict[str, DataFrame], query: str) -> DataFrame:
    """A user's SQL over named frames, written ``@name`` in it (not within quotes). The session keeps no view of them."""
    spark = next(iter(frames.values())).sparkSession
    # quoted texts and names as they are, frames as arguments of the query
    parts = re.split(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""", query)
    bare = lambda x: x.replace("{", "{{").replace("}", "}}")
    named = (bare(x) if k % 2 else re.sub(r"@(\w+)", lambda m: f"{{source_{m[1]}}}" if m[1] in frames else m[0], bare(x)) for k, x in enumerate(parts))
    return spark.sql("".join(named), **{f"source_{name}": df for name, df in frames.items()})


def upserted(stored_rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh`` replace stored ones of equal key (a null key equals a null one), others are added; fresh rows have one row a key."""
    old, new = stored_rows.alias("old"), fresh.select(key).alias("new")
    return old.join(new, F.col(f"old.{key}").eqNullSafe(F.col(f"new.{key}")), "left_anti").unionByName(fresh)


def retained(df: DataFrame, history: DataFrame, runs: int) -> DataFrame:
    """Rows of the last ``runs`` runs of ``history`` (run_id, at)."""
    order = history.select("run_id", "at").groupBy("run_id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), F.desc("run_id")).limit(runs)
    return df.join(F.broadcast(order.select("run_id")), "run_id", "left_semi")


def assigned(df: DataFrame, owners: list[tuple[Column, str]], default: str) -> DataFrame:
    """The owner that the first rule that holds names, else the default one."""
    out = F.lit(default)
    for condition, owner in reversed(owners):
        out = F.when(condition, owner).otherwise(out)
    return df.withColumn("owner", out)


def enum_score(df: DataFrame, column: str, valid: list, positive: bool = True) -> DataFrame:
    """Rows whose value is among the valid ones, and their share (of the others where the measure is negative)."""
    one = df.agg(F.count("*").alias("total_count"), F.count_if(F.col(column).isin(valid)).alias("valid_count"))
    met = F.col("valid_count") if positive else F.col("total_count") - F.col("valid_count")
    return one.withColumn("score", F.round(score(met, F.col("total_count")), 4))


def outside_range(df: DataFrame, lengths: dict[str, tuple], values: dict[str, tuple]) -> DataFrame:
    """Per column, measure (length_range, value_range) and learned range: rows outside it and the score of the others; nulls are inside."""
    tests = [(c, "length_range", ~F.length(c).between(*r)) for c, r in lengths.items()] + [(c, "value_range", ~F.col(c).between(*r)) for c, r in values.items()]
    one = df.agg(F.count("*").alias("n"), *(F.count_if(x).alias(f"v{i}") for i, (_, _, x) in enumerate(tests)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("measure"), F.col("n").alias("total_count"), F.col(f"v{i}").alias("outside")) for i, (c, m, _) in enumerate(tests)))
    return one.select(F.inline(rows)).withColumn("score", F.round(score(F.col("total_count") - F.col("outside"), F.col("total_count")), 4))


def weighted_rollup(scores: DataFrame, by: list[str]) -> DataFrame:
    """sum(score * weight) / sum(weight) of scored measures."""
    return scores.filter("score is not null").groupBy(*by).agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 3).alias("score"), F.count("*").alias("n_measures"))
