"""Vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.distance import distance
from loomstone.operators import mvcc


def knn(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """(key, distance) of the k nearest, ties by key: a projection and a top-k, no full sort."""
    rows = df if where is None else df.filter(where)
    return rows.select(key, distance(F.col(vector), query, metric).alias("distance")).orderBy("distance", key).limit(k)


def of_key(df: DataFrame, key_value, vector: str = "embedding", key: str = "vec_id") -> list[float]:
    """The vector of one key: one row, found by a pushed filter."""
    found = df.filter(F.col(key) == key_value).select(F.col(vector).cast("array<double>").alias("v")).first()
    if found is None:
        raise KeyError(key_value)
    return found["v"]


def insert_errors(df: DataFrame, new: DataFrame, dim: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, reason) of vectors that may not be inserted: of another length, or of a key that exists."""
    wrong = new.filter(F.size(vector) != dim).select(key, F.lit("dimension").alias("reason"))
    return wrong.unionByName(new.join(df.select(key), key, "left_semi").select(key, F.lit("duplicate").alias("reason")))


def remove(df: DataFrame, gone: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def ann(df: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "vec_id", length: float = 2.0, tables: int = 8, seed: int = 5) -> DataFrame:
    """(key, distance): approximate Euclidean neighbours by random projection hashing."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=length, numHashTables=tables, seed=seed).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), k, distCol="distance").select(key, "distance")


def assign(df: DataFrame, centroids: Sequence[Sequence[float]], vector: str = "embedding") -> DataFrame:
    """df with the number of the nearest centroid in `list`, ties to the first: one projection."""
    away = [F.struct(distance(F.col(vector), list(c), "euclidean").alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return df.withColumn("list", F.array_min(F.array(*away))["i"])


def ivf(df: DataFrame, lists: int, vector: str = "embedding", key: str = "vec_id", sample: int = 20_000, seed: int = 5) -> tuple[DataFrame, list[list[float]]]:
    """(df with the number of its nearest centroid in `list`, centroids), centroids fitted on `sample` rows by hash order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = df.orderBy(F.xxhash64(key)).limit(sample).select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = KMeans(k=lists, featuresCol="_v", seed=seed, maxIter=10).fit(some)
    centroids = [c.tolist() for c in model.clusterCenters()]
    return assign(df, centroids, vector), centroids


def probe(indexed: DataFrame, centroids: list[list[float]], query: Sequence[float], k: int, probes: int, metric: str = "euclidean", **how) -> DataFrame:
    """knn over the `probes` lists whose centroids are nearest; a table partitioned by `list` reads no other."""
    away = sorted(range(len(centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centroids[i], query, strict=True)))
    return knn(indexed, query, k, metric, where=F.col("list").isin(*away[:probes]), **how)


def visible(log: DataFrame, lsn: int, key: str = "vec_id") -> DataFrame:
    """The vectors of a change log (vec_id, embedding, is_deleted, txn_id, commit_lsn, seq) as of lsn."""
    return mvcc.visible(log, lsn, keys=(key,))


def vacuum(log: DataFrame, watermark: int, key: str = "vec_id") -> DataFrame:
    return mvcc.vacuum(log, watermark, keys=(key,))


def verify(df: DataFrame, dim: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(problem, n): vectors of another length, with an element that is no number, and keys said twice. Search
    reads every row, so what is stored can be reached."""
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x))
    n = df.agg(F.count_if(F.size(vector) != dim).alias("length"), F.count_if(bad).alias("no number"), (F.count(key) - F.countDistinct(key)).alias("repeated key"))
    return n.unpivot([], ["length", "no number", "repeated key"], "problem", "n")


def stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"))
