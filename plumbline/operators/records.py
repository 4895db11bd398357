"""Records of one thing: similarity of fields, blocking, clusters and survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.sources.scratch import Workspace


def record_id(fields: list[str]) -> Column:
    """sha256 of the joined fields, nulls as empty ones."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256)


def ratio(a: Column, b: Column) -> Column:
    """0-100: one minus the edit distance over the longer length; both empty: 100."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / longer))


def partial_ratio(a: Column, b: Column) -> Column:
    """0-100: the ratio of the shorter value with the run of its length in the longer one that is most like it.

    Both empty: 100; one empty: 0.
    """
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    swap = F.length(x) > F.length(y)
    short, long = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    n, room = F.length(short), F.length(long) - F.length(short)
    edits = F.array_min(F.transform(F.sequence(F.lit(1), room + 1), lambda i: F.levenshtein(F.substring(long, i, n), short)))
    return F.when(room + n == 0, 100.0).when(n == 0, 0.0).otherwise(100.0 * (1 - edits / n))


def token_set(a: Column, b: Column) -> Column:
    """0-100: shared words over all words."""
    x, y = (F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), " +")) for c in (a, b))
    return 100.0 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def similarity(kind: str, a: Column, b: Column) -> Column:
    """Field similarity by type."""
    if kind in ("Exact", "Categorical"):
        return F.when(a.eqNullSafe(b), 100.0).otherwise(0.0)
    if kind == "Price":
        return F.when(F.abs(a - b) < 0.01, 100.0).otherwise(0.0)
    if kind == "Set":
        return token_set(a, b)
    return ratio(a, b)


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(h))


def cluster(df: DataFrame, id_col: str, block: Column, fields: dict[str, str], least: float = 90.0) -> DataFrame:
    """Clusters of records of one block whose mean field similarity reaches ``least``.

    Equal records are one from the start, so that a large group of copies adds
    no pairs; different ones of a block are compared, so the block has to be
    chosen narrow (where fields have to be equal, it should hold them). A
    cluster is a whole connected component, however long its chains, and is
    named by its smallest id. Every row gives a row; one without an id has a
    null cluster_id unless it equals a record with one. Returns id, cluster_id.
    """
    names = list(fields)
    grouped = df.groupBy(block.alias("block"), *names).agg(F.min(id_col).alias("rep"))
    a, b = grouped.alias("a"), grouped.alias("b")
    mean = sum((similarity(k, F.col(f"a.{c}"), F.col(f"b.{c}")) for c, k in fields.items()), F.lit(0.0)) / len(fields)
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.rep") < F.col("b.rep"))).filter(mean >= least).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    with Workspace(df.sparkSession) as space:
        labels = connected_components(space.stored(pairs, "pairs"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in names]
    joined = df.withColumn("block", block).alias("r").join(grouped.alias("g"), [F.col("r.block").eqNullSafe(F.col("g.block")), *same])
    return joined.join(labels, F.col("g.rep") == F.col("node"), "left").select(F.col(f"r.{id_col}").alias(id_col), F.coalesce("component", "g.rep").alias("cluster_id"))


def survivor(df: DataFrame, by: str, column: str) -> DataFrame:
    """Per cluster the most frequent value, the longest and then the smallest on ties."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), F.desc(F.length(column)), column)
    return counted.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(by, column)
