"""Optional accelerator for top-k: clusters of unit vectors (k-means on a bounded sample), probing the nearest few."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.vector import cosine_distance, norm

# Fixed value: rows below which no index is built.
LEAST_ROWS = 256
SAMPLE = 50_000


def build(rows: DataFrame, vector: str, clusters: int = 64, sample: int = SAMPLE, seed: int = 7):
    """(centroids, rows with ``cluster``): k-means is fitted on at most ``sample`` rows, chosen by hash; every usable row is indexed,
    in its nearest cluster and once more in its second one, where ``home`` names the nearest. A row is missed only if both aren't probed.

    None for fewer than 256 usable rows. Null, zero and empty vectors aren't indexed.
    """
    unit = F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector)))
    good = rows.where(norm(F.col(vector)) > 0).withColumn("__unit", unit)
    n = good.count()
    if n < LEAST_ROWS:
        return None
    few = good if n <= sample else good.where(F.pmod(F.xxhash64(vector), F.lit(-(-n // sample))) == 0)
    model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=10).fit(few.select(array_to_vector("__unit").alias("features")))
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    copies = good.withColumn("__two", _nearest(centers, vector, 2)).select(*rows.columns, "__two", F.posexplode("__two").alias("__copy", "cluster"))
    return centers, copies.withColumn("home", F.when(F.col("__copy") > 0, F.col("__two")[0])).drop("__two", "__copy")


def _nearest(centers, vector, n: int):
    """The ``n`` nearest clusters of a vector's direction, nearest first."""

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        c, x = np.array(centers), np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        far = (c * c).sum(axis=1) - 2 * x @ c.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return near(vector)


def search(centers, indexed: DataFrame, vector: str, query: list[float], k: int, probes: int, id_col: str = "id") -> DataFrame:
    """Top k among the rows of the ``probes`` clusters nearest to the query; a filter that reaches a table partitioned by cluster."""
    far = [sum((a - b) ** 2 for a, b in zip(c, _unit(query))) for c in centers]
    near = sorted(range(len(centers)), key=lambda i: far[i])[:probes]
    q = F.array(*[F.lit(float(x)) for x in query])
    return indexed.where(F.col("cluster").isin(near) & (F.col("home").isNull() | ~F.col("home").isin(near))).withColumn("dist", cosine_distance(F.col(vector), q)).where("dist is not null").orderBy("dist", id_col).limit(k)


def search_batch(centers, indexed: DataFrame, vector: str, queries: DataFrame, k: int, probes: int, id_col: str = "id", block: int = 1000) -> DataFrame:
    """(qid, id, dist, rank): ``search`` for every row of ``queries(qid, qvec)``, a stated set of queries.

    Queries with their clusters are broadcast in blocks of at most about ``block`` queries and meet the rows of those clusters only.
    """
    near = queries.where(norm(F.col("qvec")) > 0).withColumn("__near", _nearest(centers, "qvec", probes)).select("qid", "qvec", "__near", F.explode("__near").alias("cluster"))
    w = Window.partitionBy("qid").orderBy("dist", id_col)

    def best(some: DataFrame) -> DataFrame:
        once = F.col("home").isNull() | ~F.array_contains("__near", F.col("home"))
        pairs = indexed.join(F.broadcast(some), "cluster").where(once).withColumn("dist", cosine_distance(F.col(vector), F.col("qvec"))).where("dist is not null")
        return pairs.select("qid", id_col, "dist").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    n = max(1, -(-queries.count() // block))
    return reduce(DataFrame.unionByName, [best(near.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)) for i in range(n)])


def _unit(v: list[float]) -> list[float]:
    n = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / n for x in v]
