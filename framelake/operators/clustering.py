"""Feature vectors, scaling and clustering with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from framelake.operators.aggregates import group_count
from framelake.workspace import materialize

# Fixed values.
FEATURES = ["DIFFERENCE_std_sub", "DIFFERENCE_bright_pixels", "SCIENCE_std_sub"]
CLUSTER_NAMES = ["Background detections", "Noise/artifacts", "High-intensity transient candidates"]


def assemble_features(df: DataFrame, columns: Sequence[str], out: str = "raw_features") -> DataFrame:
    """Columns into one vector; a null or NaN is an error."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def standardize(df: DataFrame, vector: str = "raw_features", out: str = "features") -> DataFrame:
    """Zero mean, unit sample deviation. One pass to fit."""
    scaler = StandardScaler(inputCol=vector, outputCol=out, withMean=True, withStd=True)
    return scaler.fit(df).transform(df)


def unpack_vector(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    values = vector_to_array(vector)
    return df.withColumns({name: F.get(values, i) for i, name in enumerate(names)})


def stable_layout(df: DataFrame, key: str) -> DataFrame:
    """Partition and order by key, so that seeded starts repeat for the same data."""
    return df.repartition(F.col(key)).sortWithinPartitions(key)


def kmeans_fit_assign(
    df: DataFrame, key: str, vector: str = "features", k: int = 3, seed: int = 42,
    out: str = "cluster",
) -> tuple[DataFrame, KMeansModel]:
    """Rows with their cluster, and the model. The input is written once; the fit caches what it
    iterates over and releases it, and the rows returned read the table, not the input's plan."""
    data = materialize(stable_layout(df, key), "vectors")
    model = KMeans(featuresCol=vector, predictionCol=out, k=k, seed=seed).fit(data)
    return model.transform(data), model


def silhouette(df: DataFrame, vector: str = "features", cluster: str = "cluster") -> float:
    return ClusteringEvaluator(
        featuresCol=vector, predictionCol=cluster, metricName="silhouette"
    ).evaluate(df)


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return group_count(df, cluster)


def cluster_names(
    df: DataFrame, model: KMeansModel, cluster: str = "cluster",
    names: Sequence[str] = tuple(CLUSTER_NAMES), out: str = "cluster_name",
) -> DataFrame:
    """Name clusters by the rank of their centre, because cluster numbers are arbitrary.

    Centres are ranked by the sum of their scaled features, lowest first. Clusters beyond the
    given names keep their rank as a name.
    """
    centers = [float(center.sum()) for center in model.clusterCenters()]
    rank = {c: r for r, c in enumerate(sorted(range(len(centers)), key=lambda c: centers[c]))}
    named = F.lit(None).cast("string")
    for number, position in rank.items():
        text = names[position] if position < len(names) else f"rank {position}"
        named = F.when(F.col(cluster) == number, text).otherwise(named)
    return df.withColumn(out, named)
