"""Feature vectors, scaling, clustering."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from framelake.operators import clustering as ml
from framelake.registry.aggregates import LONG_STATS_SQL, triplets
from framelake.registry.base import query, rounded, sql_round as r
from framelake.workspace import materialize

FEATURES = ["A_std_sub", "A_median_bg", "N_std_sub"]
FEATURES_SQL = f"""
(WITH st AS MATERIALIZED {LONG_STATS_SQL}
 SELECT a.l_suppkey, a.std_sub AS A_std_sub, a.median_bg AS A_median_bg,
        n.std_sub AS N_std_sub
 FROM st a JOIN st n USING (l_suppkey) JOIN st r USING (l_suppkey)
 WHERE a.l_returnflag = 'A' AND n.l_returnflag = 'N' AND r.l_returnflag = 'R')"""


def features(spark, sf):
    return ml.assemble_features(triplets(spark, sf).select("l_suppkey", *FEATURES), FEATURES)


# Suppliers moved apart in all features, so that the clusters are known.
STEP = 1_000_000
MOVED_SQL = f"""
(SELECT l_suppkey, l_suppkey % 3 AS g, {", ".join(f"{c} + l_suppkey % 3 * {STEP} AS {c}" for c in FEATURES)}
 FROM {FEATURES_SQL})"""
NAME_SQL = "['" + "', '".join(ml.CLUSTER_NAMES) + "'][g + 1]"


def clustered(spark, sf):
    rows = triplets(spark, sf).select("l_suppkey", *FEATURES)
    moved = rows.withColumns({c: F.col(c) + F.col("l_suppkey") % 3 * STEP for c in FEATURES})
    vectors = materialize(ml.assemble_features(moved, FEATURES), "features")
    return ml.kmeans_fit_assign(ml.standardize(vectors), "l_suppkey")


@query("assemble_features", f"""
SELECT l_suppkey, {", ".join(f"{r(c, 4)} AS {c}" for c in FEATURES)} FROM {FEATURES_SQL}""")
def assemble_features(spark, sf):
    vectors = features(spark, sf).select("l_suppkey", "raw_features")
    out = ml.unpack_vector(vectors, "raw_features", FEATURES).drop("raw_features")
    return rounded(out, *FEATURES, digits=4)


@query("standardize", "SELECT l_suppkey, " + ", ".join(
    r(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)") + f" AS {c}" for c in FEATURES
) + f" FROM {FEATURES_SQL}")
def standardize(spark, sf):
    scaled = ml.standardize(features(spark, sf)).select("l_suppkey", "features")
    return rounded(ml.unpack_vector(scaled, "features", FEATURES).drop("features"), *FEATURES)


@query("kmeans_fit_assign", f"SELECT l_suppkey, {NAME_SQL} AS cluster_name FROM {MOVED_SQL}")
def kmeans_fit_assign(spark, sf):
    rows, model = clustered(spark, sf)
    return ml.cluster_names(rows, model).select("l_suppkey", "cluster_name")


# Mean silhouette over squared distances of the scaled features.
SILHOUETTE_SQL = f"""
WITH f AS MATERIALIZED (SELECT l_suppkey, g, {", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in FEATURES)} FROM {MOVED_SQL}),
d AS (SELECT p.l_suppkey, p.g, q.g AS other, avg({" + ".join(f"(p.{c} - q.{c}) ** 2" for c in FEATURES)}) AS away
      FROM f p JOIN f q ON p.l_suppkey <> q.l_suppkey GROUP BY ALL),
s AS (SELECT l_suppkey, max(away) FILTER (WHERE g = other) AS a, min(away) FILTER (WHERE g <> other) AS b
      FROM d GROUP BY l_suppkey)
SELECT count(*) AS rows, {r("avg(coalesce((b - a) / greatest(a, b), 0))")} AS silhouette FROM s"""


@query("silhouette", SILHOUETTE_SQL)
def silhouette(spark, sf):
    rows, _ = clustered(spark, sf)
    score = ml.silhouette(rows)
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(score).alias("silhouette"))
    return rounded(out, "silhouette")


@query("cluster_sizes", f"SELECT count(*) AS n FROM {MOVED_SQL} GROUP BY g")
def cluster_sizes(spark, sf):
    rows, _ = clustered(spark, sf)
    return ml.cluster_sizes(rows).select("n")


@query("cluster_names", f"""
WITH f AS MATERIALIZED (SELECT g, ({FEATURES[0]} - avg({FEATURES[0]}) OVER ()) / stddev_samp({FEATURES[0]}) OVER () AS x FROM {MOVED_SQL})
SELECT {NAME_SQL} AS cluster_name, count(*) AS n, {r("avg(x)")} AS mean_first_feature FROM f GROUP BY g""")
def cluster_names(spark, sf):
    rows, model = clustered(spark, sf)
    named = ml.cluster_names(rows, model)
    out = named.groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.get(vector_to_array("features"), 0)).alias("mean_first_feature"),
    )
    return rounded(out, "mean_first_feature")
