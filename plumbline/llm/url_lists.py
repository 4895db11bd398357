"""URL filters over dated lists: a temporal join.

List entries say that a domain or a path prefix is added to or removed from a
list at some time. Per listed value they become validity intervals [from, to).
Every capture is looked up under its host, the host's parent domains and the
host with its first path segment; the join takes the interval that holds at the
time of the fetch. Intervals are cut into periods of PERIOD_DAYS, so that a
value with a long history is joined by value and period, not with all of it.

Captures join by value: a value that many captures share is one that adaptive
execution splits; a list that Spark knows to be small is broadcast by the
session's own threshold. Results are aggregated per capture, not per value.

Edge cases: null or unreadable URLs, and captures without a time, match
nothing; of entries of one value at one time removal wins; repeated additions
extend nothing; an addition never removed holds for ever; an empty list matches
nothing; repeated captures are each judged; an empty table gives no rows;
columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import required, table

PERIOD_DAYS = 30
_PERIOD = PERIOD_DAYS * 86_400


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keys_of(url: Column, host: Column) -> Column:
    """What a URL is looked up under."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    segment = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*(/[^/?#]+)", 1)
    path = F.when(segment != "", F.array(F.concat(F.lit("path:"), host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of (value, action, at): value, since, until (seconds; until is null while it holds)."""
    state = entries.filter("value is not null and at is not null and action in ('add', 'remove')").groupBy("value", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("value").orderBy("at")
    changes = state.withColumn("before", F.lag("action").over(order)).filter("not action <=> before")
    return changes.withColumn("until", F.lead("at").over(order)).filter("action = 'add'").select("value", F.col("at").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Judge every capture by the entries active at its fetch.

    ``entries``: value ("domain:<name>" or "path:<host>/<segment>"), action
    (add or remove), at (seconds). ``time_col``: seconds. Returns id, host,
    fetched_at, blocked, n_active, entry (the smallest active value, or null).
    """
    seen = required(captures, **{id_col: "long", url_col: "string", time_col: "long"}).toDF("id", "url", "at")
    seen = seen.withColumns({"row": F.monotonically_increasing_id(), "host": F.coalesce(host_of(F.col("url")), F.lit(""))})
    looked = seen.select("row", "id", "host", "at", F.explode_outer(keys_of(F.col("url"), F.col("host"))).alias("value"), F.floor(F.col("at") / _PERIOD).alias("period"))

    last = captures.agg(F.max(F.col(time_col).cast("long"))).first()[0] or 0  # one number: no interval need reach beyond it
    held = intervals(entries).filter(F.col("since") <= last)
    first_period, end = F.floor(F.col("since") / _PERIOD), F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))
    cut = held.select("value", "since", "until", F.explode(F.sequence(first_period, F.floor(end / _PERIOD))).alias("period"))

    active = looked.join(
        cut.withColumnRenamed("value", "listed").withColumnRenamed("period", "in_period"),
        F.expr("value = listed and period = in_period and at >= since and (until is null or at < until)"),
        "left",
    )
    judged = active.groupBy("row").agg(F.first("id").alias(id_col), F.first("host").alias("host"), F.first("at").alias(time_col), F.count("listed").alias("n_active"), F.min("listed").alias("entry"))
    return judged.select(id_col, "host", time_col, (F.col("n_active") > 0).alias("blocked"), "n_active", "entry")


# ---------------------------------------------------------------- the query

DAY = 86_400
START = 1_704_067_200  # 2024-01-01, in seconds


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list by rule, as no table has one: every other-length host is listed on
    a day by its length, delisted 60 days later and, below .net, listed again on day
    150; two parent domains and a path are listed too."""
    host = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    size = F.length("host")
    listed = host.filter(size % 2 == 0).select("host", (START + (size * 7 % 200) * DAY).alias("at"))
    value = F.concat(F.lit("domain:"), F.col("host"))
    own = listed.select(value.alias("value"), F.lit("add").alias("action"), "at").unionByName(
        listed.select(value.alias("value"), F.lit("remove").alias("action"), (F.col("at") + 60 * DAY).alias("at"))
    )
    again = host.filter("host like '%.net'").select(value.alias("value"), F.lit("add").alias("action"), F.lit(START + 150 * DAY).alias("at"))
    paths = host.filter("host like 'm.%'").select(F.concat(F.lit("path:"), "host", F.lit("/fr")).alias("value"), F.lit("add").alias("action"), F.lit(START + 30 * DAY).alias("at"))
    fixed = pages.sparkSession.sql(
        f"""select * from values ('domain:example.org', 'add', {START + 20 * DAY}L), ('domain:example.org', 'remove', {START + 80 * DAY}L),
        ('domain:example.com', 'add', {START + 300 * DAY}L) as t(value, action, at)"""
    )
    return own.unionByName(again).unionByName(paths).unionByName(fixed).withColumn("at", F.col("at").cast("long"))


def over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the dated list; pages have no fetch time, so it follows from the id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", (START + F.col("page_id") * 7919 % (365 * DAY)).cast("long"))
    return url_filter(captures, dated_list(pages))


ORACLE = rf"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         CAST({START} + page_id * 7919 % {365 * DAY} AS BIGINT) AS fetched_at FROM pages
), h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
l AS (SELECT host, {START} + (length(host) * 7 % 200) * {DAY} AS "at" FROM h WHERE length(host) % 2 = 0),
e AS (
  SELECT 'domain:' || host AS value, 'add' AS action, "at" FROM l
  UNION ALL SELECT 'domain:' || host, 'remove', "at" + {60 * DAY} FROM l
  UNION ALL SELECT 'domain:' || host, 'add', {START + 150 * DAY} FROM h WHERE host LIKE '%.net'
  UNION ALL SELECT 'path:' || host || '/fr', 'add', {START + 30 * DAY} FROM h WHERE host LIKE 'm.%'
  UNION ALL SELECT * FROM (VALUES ('domain:example.org', 'add', {START + 20 * DAY}), ('domain:example.org', 'remove', {START + 80 * DAY}), ('domain:example.com', 'add', {START + 300 * DAY})) AS f(value, action, "at")
), s AS (SELECT value, "at", max(action) AS action FROM e GROUP BY 1, 2),
c AS (SELECT *, lag(action) OVER (PARTITION BY value ORDER BY "at") AS before FROM s),
d AS (SELECT value, action, "at", lead("at") OVER (PARTITION BY value ORDER BY "at") AS until FROM c WHERE before IS NULL OR before <> action),
k AS (
  SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
    ['domain:' || array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
    CASE WHEN regexp_extract(url, '^[^/?#]*//[^/?#]*(/[^/?#]+)', 1) <> '' THEN ['path:' || host || regexp_extract(url, '^[^/?#]*//[^/?#]*(/[^/?#]+)', 1)] ELSE [] END))) AS value
  FROM p WHERE host <> ''
), m AS (
  SELECT k.page_id, count(*) AS n, min(k.value) AS entry FROM k JOIN d ON d.action = 'add' AND d.value = k.value AND k.fetched_at >= d."at" AND (d.until IS NULL OR k.fetched_at < d.until) GROUP BY 1
)
SELECT p.page_id, p.host, p.fetched_at, m.n IS NOT NULL AS blocked, CAST(coalesce(m.n, 0) AS BIGINT) AS n_active, m.entry FROM p LEFT JOIN m ON m.page_id = p.page_id
"""
