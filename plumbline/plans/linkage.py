"""Registered queries of similar records, clusters and links.

The tables hold no typing errors, so records with some are derived from them by
rule: copies of every fifth customer with a letter less or one more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import linkage
from plumbline.operators.linkage import Field
from plumbline.plans.base import query, t

FIELDS = [Field("label", ("ShortString",), 3.0), Field("nation", ("Exact",), 1.0)]
KEYS, LEAST = [("label", "nation")], 92.0
#: Which value of a cluster's survives.
RULES = {"label": "value", "nation": "value"}


def typed_customers(spark, sf_dir) -> DataFrame:
    """Customers as (id, label, nation), and copies of every fifth with an error."""
    label = F.format_string("%s %s %.2f", "c_name", "c_mktsegment", "c_acctbal")
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), label.alias("label"), F.col("c_nationkey").cast("string").alias("nation"))
    wrong = F.when(F.expr("id % 2 = 0"), F.replace("label", F.lit("Customer"), F.lit("Custmer"))).otherwise(F.concat("label", F.lit("x")))
    return rows.unionByName(rows.filter("id % 5 = 0").select((10_000_000 + F.col("id")).alias("id"), wrong.alias("label"), "nation"))


_TYPED = """c AS (SELECT c_custkey AS id, c_name || ' ' || c_mktsegment || ' ' || printf('%.2f', c_acctbal) AS label, CAST(c_nationkey AS VARCHAR) AS nation FROM customer),
    r AS (SELECT * FROM c UNION ALL SELECT 10000000 + id, CASE WHEN id % 2 = 0 THEN replace(label, 'Customer', 'Custmer') ELSE label || 'x' END, nation FROM c WHERE id % 5 = 0),
    s AS (SELECT a.id AS u, b.id AS v, round((3 * 100 * (1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label))) + 100) / 4, 6) AS score
          FROM r a JOIN r b ON a.nation = b.nation AND a.id < b.id),
    p AS (SELECT * FROM s WHERE score >= 92)"""
_CLUSTERS = f"""WITH RECURSIVE {_TYPED}, e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
    w AS (SELECT id, id AS "at" FROM r UNION SELECT w.id, e.v FROM w JOIN e ON e.u = w."at"),
    k AS (SELECT id, min("at") AS cluster_id FROM w GROUP BY 1)"""


@query(f"WITH {_TYPED} SELECT u, v, score FROM p")
def similar_customers(spark, sf_dir):
    return linkage.similar_records(typed_customers(spark, sf_dir), FIELDS, KEYS, LEAST, id_col="id").select("u", "v", F.round("score", 6).alias("score"))


@query(f"{_CLUSTERS} SELECT id, cluster_id FROM k")
def fuzzy_clusters_customer(spark, sf_dir):
    return linkage.clusters(typed_customers(spark, sf_dir), "id", FIELDS, KEYS, LEAST).select("id", "cluster_id")


@query(f"{_CLUSTERS} SELECT id, cluster_id FROM k")
def extended_clusters_customer(spark, sf_dir):
    """In three increments, one of them the copies."""
    rows = typed_customers(spark, sf_dir)
    state = linkage.clusters(rows.filter("id % 3 = 0"), "id", FIELDS, KEYS, LEAST)
    for more in ("id % 3 <> 0 and id < 10000000", "id % 3 <> 0 and id >= 10000000"):
        state = linkage.extended(state, rows.filter(more), "id", FIELDS, KEYS, LEAST)
    return state.select("id", "cluster_id")


@query(
    f"""{_CLUSTERS}, n AS (SELECT cluster_id, label, count(*) AS n FROM k JOIN r USING (id) GROUP BY 1, 2)
    SELECT cluster_id, (SELECT count(*) FROM k WHERE k.cluster_id = n.cluster_id) AS n_records, (SELECT count(*) FROM k WHERE k.cluster_id = n.cluster_id) > 1 AS merged, label,
    (SELECT min(nation) FROM k JOIN r USING (id) WHERE k.cluster_id = n.cluster_id) AS nation
    FROM n QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(label) DESC, label) = 1"""
)
def merge_output_customer(spark, sf_dir):
    state = linkage.clusters(typed_customers(spark, sf_dir), "id", FIELDS, KEYS, LEAST)
    return linkage.merge_output(state, "id", RULES)


@query(
    f"""{_CLUSTERS}, n AS (SELECT cluster_id, label, nation, count(*) AS n FROM k JOIN r USING (id) GROUP BY 1, 2, 3),
    f AS (SELECT cluster_id, label, nation FROM n QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(label) DESC, label) = 1),
    q AS (SELECT a.cluster_id AS u, b.cluster_id AS v FROM f a JOIN f b ON a.nation = b.nation AND a.cluster_id < b.cluster_id
          WHERE (3 * 100 * (1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label))) + 100) / 4 >= 85),
    g AS (SELECT u, v FROM q UNION SELECT v, u FROM q), x AS (SELECT u AS cluster_id, u AS "at" FROM g UNION SELECT x.cluster_id, g.v FROM x JOIN g ON g.u = x."at")
    SELECT cluster_id, min("at") AS merged_id FROM x GROUP BY 1"""
)
def similar_clusters_customer(spark, sf_dir):
    state = linkage.clusters(typed_customers(spark, sf_dir), "id", FIELDS, KEYS, LEAST)
    return linkage.similar_clusters(state, FIELDS, KEYS, RULES, 85.0)


# ---------------------------------------------------------------- links

LINK_FIELDS = [Field("name", agree=95.0), Field("nation", ("Exact",)), Field("balance", ("Price",)), Field("segment", ("Exact",))]
LINK_KEYS = [(Field("name", ("Exact",)),), (Field("balance", ("Price",)),)]


def link_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers, and three quarters of them as another table has them: other ids, errors, gaps."""
    left = t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("left_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.format_string("%.2f", "c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    k = lambda n: F.expr(f"left_id % {n} = 0")
    right = left.filter("left_id % 4 <> 0").select(
        (3 * F.col("left_id") + 1).alias("right_id"),
        F.when(k(5), F.replace("name", F.lit("Customer"), F.lit("Custmer"))).otherwise(F.col("name")).alias("name"),
        F.when(k(13), F.lit("99")).otherwise(F.col("nation")).alias("nation"),
        F.when(k(7), F.lit(None)).when(k(11), F.lit("0.00")).otherwise(F.col("balance")).alias("balance"),
        F.when(k(9), F.lit("UNKNOWN")).otherwise(F.col("segment")).alias("segment"),
    )
    return left, right


@query(
    """WITH l AS (SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, printf('%.2f', c_acctbal) AS balance, c_mktsegment AS segment FROM customer),
    r AS (SELECT CASE WHEN k % 5 = 0 THEN replace(name, 'Customer', 'Custmer') ELSE name END AS name, CASE WHEN k % 13 = 0 THEN '99' ELSE nation END AS nation,
          CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN '0.00' ELSE balance END AS balance, CASE WHEN k % 9 = 0 THEN 'UNKNOWN' ELSE segment END AS segment FROM l WHERE k % 4 <> 0),
    c AS (SELECT CAST(l.balance AS DOUBLE) AS x, CAST(r.balance AS DOUBLE) AS y, l.name AS n1, r.name AS n2, l.nation = r.nation AS g1, l.segment = r.segment AS g3
          FROM l JOIN r ON l.name = r.name OR floor(CAST(l.balance AS DOUBLE) * 100) BETWEEN floor(CAST(r.balance AS DOUBLE) * 100) - 1 AND floor(CAST(r.balance AS DOUBLE) * 100) + 1),
    d AS (SELECT 100 * (1 - levenshtein(n1, n2) / greatest(length(n1), length(n2))) >= 95 AS g0, g1, abs(x - y) < 0.01 AS g2, g3 FROM c)
    SELECT g0, g1, g2, g3, count(*) AS n FROM d GROUP BY 1, 2, 3, 4"""
)
def link_patterns_customer(spark, sf_dir):
    """How many candidate links agree in which fields."""
    left, right = link_sides(spark, sf_dir)
    both = linkage.link_records(left, right, "left_id", "right_id", [f.name for f in LINK_FIELDS])
    return linkage.patterns(linkage.agreements(both, linkage.link_candidates(both, LINK_KEYS, 90.0), LINK_FIELDS), len(LINK_FIELDS))


@query()
def linked_customers(spark, sf_dir):
    """Weights by expectation maximisation, links one to one."""
    left, right = link_sides(spark, sf_dir)
    return linkage.link(left, right, "left_id", "right_id", LINK_FIELDS, LINK_KEYS)[0]


@query(
    """SELECT least(a.p_partkey, b.p_partkey) AS u, greatest(a.p_partkey, b.p_partkey) AS v FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k, p_brand FROM part) a
    JOIN (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k, p_brand FROM part) b ON a.p_brand = b.p_brand AND b.k BETWEEN a.k + 1 AND a.k + 3"""
)
def neighbours_part(spark, sf_dir):
    """Sorted neighbourhood by price within a brand."""
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_retailprice")
    return linkage.neighbours(parts, ["p_retailprice"], 3, ["p_brand"])


@query(
    """WITH d AS (SELECT DISTINCT p_name AS n FROM part), x AS (SELECT a.n AS a, b.n AS b, CASE WHEN length(a.n) <= length(b.n) THEN a.n ELSE b.n END AS s, CASE WHEN length(a.n) <= length(b.n) THEN b.n ELSE a.n END AS l
    FROM d a JOIN d b ON a.n < b.n) SELECT a, b, round(100 * (1 - list_min([levenshtein(substr(l, i, length(s)), s) FOR i IN range(1, length(l) - length(s) + 2)]) / length(s)), 6) AS score FROM x
    WHERE 100 * (1 - list_min([levenshtein(substr(l, i, length(s)), s) FOR i IN range(1, length(l) - length(s) + 2)]) / length(s)) >= 70"""
)
def partial_ratio_part_names(spark, sf_dir):
    """Names of parts that lie within each other, nearly."""
    names = [Field("p_name", ("String",))]
    parts = t(spark, sf_dir, "part").select("p_name").distinct()
    found = linkage.similar_records(parts, names, [("p_name",)], 70.0)
    by_node = linkage.with_node(parts, names).select("node", "p_name")
    pairs = found.join(by_node.toDF("u", "x"), "u").join(by_node.toDF("v", "y"), "v")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("score", 6).alias("score"))
