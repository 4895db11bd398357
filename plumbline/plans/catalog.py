"""Registered queries of terms, observed tables and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import terms
from plumbline.plans.base import query, t
from plumbline.sources import observe, structure
from plumbline.sources.scratch import scratch


@query(
    r"""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, 'o', '') || '_' || p_type WHEN p_partkey % 7 = 1 THEN upper(p_name) ELSE p_name || ' ' || p_type END AS name FROM part),
    x AS (SELECT DISTINCT name AS n FROM a), g AS (SELECT DISTINCT p_name AS term FROM part), size AS (SELECT count(*) AS size FROM x),
    w AS (SELECT n, word, count(*) AS tf FROM (SELECT n, unnest(list_filter(regexp_split_to_array(lower(n), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM x) GROUP BY 1, 2),
    v AS (SELECT term AS n, word, count(*) AS tf FROM (SELECT term, unnest(list_filter(regexp_split_to_array(lower(term), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM g) GROUP BY 1, 2),
    idf AS (SELECT word, ln((1 + size) / (1 + count(*))) + 1 AS idf FROM w, size GROUP BY word, size),
    wv AS (SELECT n, w.word, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY n)) AS z FROM w JOIN idf ON idf.word = w.word), vv AS (SELECT n, v.word, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY n)) AS z FROM v JOIN idf ON idf.word = v.word),
    c AS (SELECT wv.n, vv.n AS term, sum(wv.z * vv.z) AS cosine FROM wv JOIN vv ON vv.word = wv.word GROUP BY 1, 2),
    s AS (SELECT x.n, g.term, coalesce(cosine, 0) AS cosine, 100 * (1 - levenshtein(lower(x.n), lower(g.term)) / greatest(length(x.n), length(g.term))) AS edit,
          list_distinct(list_filter(regexp_split_to_array(lower(x.n), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS p, list_distinct(list_filter(regexp_split_to_array(lower(g.term), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS q
          FROM x CROSS JOIN g LEFT JOIN c ON c.n = x.n AND c.term = g.term),
    b AS (SELECT n, term, edit >= 95 AS direct, round(CASE WHEN edit >= 95 THEN 0.98 ELSE (0.2 * cosine + 0.3 * edit / 100 + 0.1 * len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q)))) / 0.6 END, 6) AS score FROM s),
    top AS (SELECT * FROM b WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, term) = 1)
    SELECT id, name, term, score, direct FROM a LEFT JOIN top ON top.n = a.name"""
)
def terms_part(spark, sf_dir):
    """Labels of parts, some misspelt, mapped to the names in use."""
    part = t(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    label = F.when(k == 0, F.concat(F.replace("p_name", F.lit("o"), F.lit("")), F.lit("_"), "p_type")).when(k == 1, F.upper("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    return terms.mapped(part.select("p_partkey", label.alias("label")), part.select("p_name"), "p_partkey", "label", "p_name")


_OBSERVED = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_orderkey", "l_quantity", "l_discount"], "part": ["p_partkey", "p_size", "p_retailprice"], "nation": ["n_nationkey", "n_regionkey"]}


@query(
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count({c}) AS filled, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM {table}" for table, columns in _OBSERVED.items() for c in columns
    )
)
def observed_tables(spark, sf_dir):
    found = observe.observed_tables(spark, {name: f"{sf_dir}/{name}.parquet" for name in _OBSERVED})
    wanted = [c for columns in _OBSERVED.values() for c in columns]
    return found.filter(F.col("column_name").isin(wanted)).select("table_name", "column_name", "row_count", "filled", F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"))


@query(
    """SELECT o_orderstatus AS kind, CASE o_orderstatus WHEN 'F' THEN ',' WHEN 'O' THEN ';' ELSE '|' END AS delimiter, 3 AS n_columns, count(*) AS n_rows,
    count(*) FILTER (o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 10 = 0) AS n_ragged FROM orders GROUP BY 1"""
)
def delimited_files_orders(spark, sf_dir):
    """Orders written as delimited files, one kind with ragged rows, and checked by lines."""
    root, o = scratch(spark), t(spark, sf_dir, "orders")
    for status, mark in (("F", ","), ("O", ";"), ("P", "|")):
        extra = F.when((F.lit(mark) == "|") & (F.col("o_orderkey") % 10 == 0), F.lit("|more")).otherwise(F.lit(""))
        line = F.concat(F.col("o_orderkey").cast("string"), F.lit(f'{mark}"a{mark}b"{mark}'), "o_orderpriority", extra)
        rows = o.filter(F.col("o_orderstatus") == status).sortWithinPartitions(F.col("o_orderkey") % 10 == 0).select(line.alias("value"))
        rows.write.text(f"{root}/{status}")
    # every file's first row is its header here, so one is counted back for each
    found = structure.delimited_structure(spark, root).withColumn("kind", F.regexp_extract("path", "/([FOP])/[^/]*$", 1))
    return found.groupBy("kind", "delimiter", "n_columns").agg(F.sum(F.col("n_rows") + 1).alias("n_rows"), F.sum("n_ragged").alias("n_ragged"))
