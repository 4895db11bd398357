"""Registered queries of hierarchies, lineage and increments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import hierarchy
from plumbline.plans.base import query, t
from plumbline.sources.scratch import scratch
from plumbline.streaming.increments import SliceStore


def places(spark, sf_dir):
    """Regions over nations over customers."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nations = t(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    customers = t(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    return nations.unionByName(customers)


_PLACES = """e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


@query(f"WITH RECURSIVE {_PLACES}, d AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, child, depth + 1 FROM d JOIN e ON e.parent = d.node) SELECT * FROM d")
def descendants_region(spark, sf_dir):
    roots = t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return hierarchy.descendants(places(spark, sf_dir), roots)


def followed_types(spark, sf_dir):
    """Lineage with cycles: an event's kind and hour leads to that of the user's next event."""
    e = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.concat_ws("@", "event_type", F.hour("ts").cast("string")).alias("kind"))
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("child", F.lead("kind").over(at)).select(F.col("kind").alias("parent"), "child").filter("child is not null")


_FOLLOWED = """k AS (SELECT user_id, ts, event_id, event_type || '@' || hour(ts) AS kind FROM events),
    f AS (SELECT kind AS parent, lead(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS child FROM k), e AS (SELECT DISTINCT parent, child FROM f WHERE child IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {_FOLLOWED}, w AS (SELECT parent AS ancestor, child AS node, 1 AS depth FROM e UNION SELECT w.ancestor, e.child, depth + 1 FROM w JOIN e ON e.parent = w.node WHERE depth < 12)
    SELECT ancestor, node, min(depth) AS depth FROM w GROUP BY 1, 2"""
)
def closure_event_kinds(spark, sf_dir):
    return hierarchy.closure(followed_types(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_FOLLOWED}, w AS (SELECT parent AS ancestor, child AS node, 1 AS depth FROM e UNION SELECT w.ancestor, e.child, depth + 1 FROM w JOIN e ON e.parent = w.node WHERE depth < 12)
    SELECT node, min(depth) AS length FROM w WHERE ancestor = node GROUP BY 1"""
)
def cycles_of_event_kinds(spark, sf_dir):
    return hierarchy.in_cycles(hierarchy.closure(followed_types(spark, sf_dir)))


@query(
    """SELECT 'r' || n_regionkey AS root, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
    UNION ALL SELECT 'n' || c_nationkey, count(*), CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) FROM customer GROUP BY 1"""
)
def rolled_up_places(spark, sf_dir):
    """Customers and their balances below every nation and region."""
    edges = places(spark, sf_dir)
    held = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return hierarchy.rolled_up(edges, edges.select("parent").distinct(), held, ["cents"])


@query(
    """WITH c AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS nation, 'r' || n_regionkey AS region, CAST(c_acctbal AS DOUBLE) AS score FROM customer JOIN nation ON n_nationkey = c_nationkey),
    s AS (SELECT nation AS node, avg(score) AS score FROM c GROUP BY 1), g AS (SELECT region AS node, avg(score) AS score FROM c GROUP BY 1)
    SELECT g.node, g.score, round(g.score, 6) AS spread FROM g UNION ALL SELECT s.node, s.score, round((s.score + 0.5 * g.score) / 1.5, 6) FROM s JOIN (SELECT DISTINCT nation, region FROM c) x ON x.nation = s.node JOIN g ON g.node = x.region
    UNION ALL SELECT c.node, NULL, round((0.5 * s.score + 0.25 * g.score) / 0.75, 6) FROM c JOIN s ON s.node = c.nation JOIN g ON g.node = c.region"""
)
def spread_scores_places(spark, sf_dir):
    """Mean balances of nations and regions, passed on to what lies below."""
    edges = places(spark, sf_dir)
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = lambda kind, k: c.groupBy(F.concat(F.lit(kind), F.col(k).cast("string")).alias("node")).agg(F.avg("c_acctbal").alias("score"))
    return hierarchy.scores_spread(edges, own("n", "c_nationkey").unionByName(own("r", "n_regionkey")))


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS slice_start, event_type, count(*) AS n, count(value) AS n_value, round(sum(value), 2) AS total_value, round(avg(value), 6) AS mean_value,
    min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1, 2"""
)
def incremental_slices_events(spark, sf_dir):
    """Four increments in order of time, the second one run twice, the first three compacted."""
    e = t(spark, sf_dir, "events")
    store = SliceStore(spark, scratch(spark), "ts", "1 day", ["event_type"], ["value"])
    n = e.agg(F.max("event_id")).first()[0]
    for batch, share in ((1, 0.3), (2, 0.55), (2, 0.9), (3, 0.9), (4, 1.0)):
        # event ids rise with time; what an increment sees grows, what it takes is new
        store.add(e.filter(F.col("event_id") <= n * share), batch)
        if batch == 3:
            store.compact()
    return store.slices().drop("deviation_value")
