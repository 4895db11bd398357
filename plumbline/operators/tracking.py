"""What changes from run to run: groups against their own limits, learned ranges, bounds from two sources, versions, constraints.

All DataFrame functions. Empty tables give no rows; null groups are groups;
columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct}
_PRIORITIES = ("High", "Medium", "Low")


# ---------------------------------------------------------------- groups


def grouped_measures(df: DataFrame, by: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Several measures of each group, in long form: groups, measure (aggregate_column), value, n (rows of the group).

    Groups are aggregated once for all pairs of (aggregate, column), map side
    first.
    """
    measures = [_AGGREGATES[a](c).cast("double").alias(f"{a}_{c}") for a, c in pairs]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *measures)
    cells = F.array(*(F.struct(F.lit(f"{a}_{c}").alias("measure"), F.col(f"{a}_{c}").alias("value")) for a, c in pairs))
    return wide.select(*by, "n", F.explode(cells).alias("x")).select(*by, "x.measure", "x.value", "n")


def grouped_alerts(measured: DataFrame, by: list[str], limits: DataFrame) -> DataFrame:
    """Groups outside of their limits: groups, status (the highest of what is met), met (measure and priority, sorted, as JSON).

    limits: ``by``, measure, priority (High, Medium, Low), lower, upper: a value
    below or above is met; null bounds are open. Limits whose groups are all null
    hold for groups that have none of their own for that measure. A group that
    meets nothing gives no row, one with a null value meets nothing.
    """
    own = limits.filter(" or ".join(f"`{c}` is not null" for c in by))
    usual = limits.filter(" and ".join(f"`{c}` is null" for c in by)).drop(*by)
    keys = [*by, "measure"]
    special = measured.join(own, keys)
    others = measured.join(own.select(*keys).distinct(), keys, "left_anti").join(usual, "measure")
    both = special.select(*keys, "value", "priority", "lower", "upper").unionByName(others.select(*keys, "value", "priority", "lower", "upper"))
    met = both.filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    rank = F.coalesce(*(F.when(F.col("priority") == p, i) for i, p in enumerate(_PRIORITIES)))
    said = F.array_sort(F.collect_set(F.struct("measure", "priority")))
    found = met.withColumn("rank", rank).filter("rank is not null").groupBy(*by).agg(F.min("rank").alias("rank"), F.to_json(said).alias("met"))
    return found.select(*by, F.get(F.array(*map(F.lit, _PRIORITIES)), F.col("rank")).alias("status"), "met")


# ---------------------------------------------------------------- learned ranges


def learned_ranges(extremes: DataFrame, room: float = 0.05, least_runs: int = 3) -> DataFrame:
    """Ranges that measures had so far, with room: measure, runs, lower, upper.

    extremes: measure, at, low, high of each run. The range is that of the runs,
    widened by ``room`` of its width on both sides (of its value where it has none); measures with
    fewer runs have none yet.
    """
    seen = extremes.groupBy("measure").agg(F.count("*").alias("runs"), F.min("low").cast("double").alias("low"), F.max("high").cast("double").alias("high")).filter(F.col("runs") >= least_runs)
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.abs("high")) * room
    return seen.select("measure", "runs", F.round(F.col("low") - width, 6).alias("lower"), F.round(F.col("high") + width, 6).alias("upper"))


def outside_learned(df: DataFrame, measures: dict[str, Column], ranges: DataFrame) -> DataFrame:
    """How many rows are outside of what was learned: measure, total_count, outside, score. Nulls are inside.

    Ranges are a row a measure, sent to the rows' tasks; the rows are read once.
    """
    wide = ranges.filter(F.col("measure").isin(list(measures))).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("lower", "upper")))).alias("ranges"))
    rows = df.select(*(c.cast("double").alias(m) for m, c in measures.items())).crossJoin(F.broadcast(wide))  # one row
    bound = lambda m: F.try_element_at("ranges", F.lit(m))
    one = rows.groupBy().agg(F.count("*").alias("n"), *(F.count_if((F.col(m) < bound(m).lower) | (F.col(m) > bound(m).upper)).alias(m) for m in measures))
    cells = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("outside")) for m in measures))
    long = one.select("n", F.explode(cells).alias("x")).select("x.measure", F.col("n").alias("total_count"), "x.outside").join(ranges.select("measure"), "measure", "left_semi")
    return long.withColumn("score", F.when(F.col("total_count") > 0, F.round(100.0 * (F.col("total_count") - F.col("outside")) / F.col("total_count"), 4)))


# ---------------------------------------------------------------- bounds from two sources


def aligned(lower: Column, upper: Column, data_lower: Column, data_upper: Column, ranges: bool) -> Column:
    """Whether a profile's bounds and the data's are near each other."""
    # fixed values: shares of the width, and what holds where there is none
    share, plain = (0.15, 10.0) if ranges else (0.20, 5.0)
    near = F.when(upper > lower, (upper - lower) * share).otherwise(plain)
    return (F.abs(lower - data_lower) <= near) & (F.abs(upper - data_upper) <= near)


def contaminated(previous_lower: Column, previous_upper: Column, lower: Column, upper: Column, length: bool = False) -> Column:
    """Whether the bounds of the run before are to be left out: two of several signs that they ran away."""
    width = upper - lower
    # fixed values: 2.5 times the width, 1.5 widths away; lengths far below 0
    signs = [(width > 0) & (previous_upper - previous_lower > 2.5 * width), F.abs(previous_lower - lower) > F.abs(width * 1.5), F.abs(previous_upper - upper) > F.abs(width * 1.5)]
    if length:
        signs.append((previous_lower < -50) & (lower >= -10))
    votes = sum((s.cast("int") for s in signs), F.lit(0))
    return F.coalesce(votes >= 2, F.lit(False))


def prioritised(share: Column, data: tuple[Column, Column], feedback: tuple[Column, Column]) -> Column:
    """Bounds of which the data has a share (see ``history.data_share``) and feedback the rest: struct of lower and upper, whole numbers.

    Without bounds from feedback the data's hold; where the two meet, too.
    """
    low, high = (F.round(share * d + (1 - share) * f, 9) for d, f in zip(data, feedback, strict=True))
    low, high = F.floor(low).cast("double"), F.ceil(high).cast("double")
    plain = feedback[0].isNull() | feedback[1].isNull() | (low >= high)
    return F.struct(F.when(plain, data[0]).otherwise(low).alias("lower"), F.when(plain, data[1]).otherwise(high).alias("upper"))


# ---------------------------------------------------------------- versions and constraints


def versions(snapshots: DataFrame, digits: int = 2, most: int = 9) -> DataFrame:
    """Versions of tables over their stored snapshots: asset, at, added, removed, retyped, version.

    snapshots: asset, at, column_name, datatype. The first one is 1.0 (of as
    many digits). Columns that go or change their type raise the first digit, new
    ones the last; a last digit that is full raises the first. Runs that
    change nothing keep the version.
    """
    runs = snapshots.groupBy("asset", "at").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("column_name", "datatype")))).alias("columns"))
    order = Window.partitionBy("asset").orderBy("at")
    both = runs.withColumn("before", F.lag("columns").over(order))
    names, old = F.map_keys("columns"), F.map_keys("before")
    both = both.select(
        "asset", "at",
        F.when(F.col("before").isNull(), 0).otherwise(F.size(F.array_except(names, old))).alias("added"),
        F.when(F.col("before").isNull(), 0).otherwise(F.size(F.array_except(old, names))).alias("removed"),
        F.when(F.col("before").isNull(), 0).otherwise(F.size(F.filter(F.array_intersect(names, old), lambda c: F.element_at("columns", c) != F.element_at("before", c)))).alias("retyped"),
    )
    listed = both.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("at", "added", "removed", "retyped"))).alias("runs"))
    start = F.struct(F.lit(1).alias("major"), F.lit(0).alias("minor"), F.array().cast("array<struct<major:int,minor:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        breaks = (x.removed + x.retyped) > 0
        full = ~breaks & (x.added > 0) & (acc.minor >= most)
        major = acc.major + F.when(breaks | full, 1).otherwise(0)
        minor = F.when(breaks | full, 0).otherwise(acc.minor + F.when(x.added > 0, 1).otherwise(0))
        return F.struct(major.alias("major"), minor.alias("minor"), F.concat(acc.out, F.array(F.struct(major.alias("major"), minor.alias("minor")))).alias("out"))

    folded = listed.withColumn("out", F.aggregate("runs", start, step).getField("out")).select("asset", F.explode(F.arrays_zip("runs", "out")).alias("x"))
    middle = [F.lit("0")] * (digits - 2)
    version = F.concat_ws(".", F.col("x.out.major").cast("string"), *middle, F.col("x.out.minor").cast("string"))
    return folded.select("asset", F.col("x.runs.at").alias("at"), F.col("x.runs.added").alias("added"), F.col("x.runs.removed").alias("removed"), F.col("x.runs.retyped").alias("retyped"), version.alias("version"))


def observed_constraints(df: DataFrame, at: Column, columns: list[str]) -> DataFrame:
    """What holds of columns in each run: at, column_name, not_null, unique (of filled values).

    Distinct values are counted by run and value first, so a frequent value is one row of the count.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    long = df.select(at.alias("at"), F.explode(cells).alias("x")).groupBy("at", "x.column_name", "x.value").agg(F.count("*").alias("n"))
    return long.groupBy("at", "column_name").agg((F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) == 0).alias("not_null"), (F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(1)) == 1).alias("unique"))


def constraint_changes(observed: DataFrame) -> DataFrame:
    """Constraints that begin or end to hold: column_name, at, constraint, change (created in the first run they hold, deactivated, created again)."""
    order = Window.partitionBy("column_name", "constraint").orderBy("at")
    cells = F.array(*(F.struct(F.lit(c).alias("constraint"), F.col(c).alias("holds")) for c in ("not_null", "unique")))
    long = observed.select("column_name", "at", F.explode(cells).alias("x")).select("column_name", "at", "x.*").withColumn("before", F.coalesce(F.lag("holds").over(order), F.lit(False)))
    return long.filter(F.col("holds") != F.col("before")).select("column_name", "at", "constraint", F.when(F.col("holds"), "created").otherwise("deactivated").alias("change"))


# ---------------------------------------------------------------- failed rows


def exported_failures(failed: DataFrame, run: dict[str, str], limit: int, order: list[str]) -> DataFrame:
    """Failed rows (with a ``rule`` column) as they are exported: metadata columns, the row's number within its rule, and at most ``limit`` rows a rule.

    The limit is the export's; total_failed has the count without it. Rows are
    numbered in the given order, so any partitioning exports the same.
    """
    at = Window.partitionBy("rule").orderBy(*order)
    total = failed.groupBy("rule").agg(F.count("*").alias("total_failed"))
    numbered = failed.withColumn("number", F.row_number().over(at)).filter(F.col("number") <= limit)
    return numbered.join(total, "rule").select(*(F.lit(v).alias(k) for k, v in run.items()), *failed.columns, "number", "total_failed")
