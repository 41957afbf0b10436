"""Centroid clustering of integer vectors by expressions alone.

A vector's squared distance to a centroid is zip_with and aggregate over a literal array; array_min over structs of distance
and number chooses the cluster, so that the smaller number wins a tie. A round sums every component per cluster in one
aggregation whose partial sums leave few rows to shuffle, and the driver sees one row per centroid.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
ID, VECTOR = f"{OWN}id", f"{OWN}v"


def quantised(vector: Column | str, dims: int, scale: int) -> Column:
    """floor(scale * x) per component, or null if the vector is null, has another length or a null or non-finite component."""
    doubles = F.col(vector).cast("array<double>") if isinstance(vector, str) else vector.cast("array<double>")
    whole = (F.size(doubles) == dims) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(doubles, lambda x: F.floor(x * scale)))


def distance(vector: Column, centroid: list[int]) -> Column:
    """The squared Euclidean distance to a centroid, exact."""
    squares = F.zip_with(vector, F.expr(f"array({','.join(f'{c}L' for c in centroid)})"), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance long, cluster int) of the nearest centroid, ties to the smaller number."""
    return F.array_min(F.array(*(F.struct(distance(vector, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


def seeds(kept: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with an id whose sha256 of 1:<id> are smallest, in the order of these; of equal ids the smaller vector is first."""
    name = F.sha2(F.concat(F.lit("1:"), F.col(ID).cast("string")), 256)
    return [list(r[VECTOR]) for r in kept.where(F.col(ID).isNotNull()).orderBy(name, VECTOR).limit(clusters).collect()]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floor of each component's mean; those without a vector stay."""
    sums = [F.sum(F.col(VECTOR)[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = kept.select(nearest(F.col(VECTOR), centroids)["cluster"].alias("cluster"), VECTOR).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
    new = list(centroids)
    for r in found.collect():  # a row per centroid
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return new


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: id, cluster int, distance long (squared), cluster_inertia long, inertia long, centroid_sha256 string.

    Vectors that are null, of another length or hold a null or non-finite component take no part. Centroids start as
    the vectors whose sha256 of 1:<id> are smallest (all, if there are fewer); vectors without an id are clustered but never
    start one. Of rows that repeat an id or a vector each counts. Components are floor(scale * x); their squared distances and
    sums must fit 64 bits, or Spark raises its overflow error. An empty table, or one without a vector to start from, gives an
    empty result; other columns are not read. Each round scans the table once and shuffles one row of sums per task and centroid;
    the result is made in a scan without a shuffle. So vectors should be a table rather than a long plan.
    """
    kept = vectors.select(F.col(id_col).alias(ID), quantised(vector_col, dims, scale).alias(VECTOR)).where(F.col(VECTOR).isNotNull())
    centroids = seeds(kept, clusters)
    if not centroids:
        return kept.where("false").select(F.col(ID).alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    placed = kept.select(F.col(ID), nearest(F.col(VECTOR), centroids).alias("best"))
    inertia = {r["cluster"]: r["total"] for r in placed.groupBy("best.cluster").agg(F.sum("best.distance").alias("total")).collect()}
    per_cluster = F.array(*(F.lit(inertia.get(k, 0)).cast("long") for k in range(len(centroids))))
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids))
    own = F.col("best.cluster")
    return placed.select(F.col(ID).alias(id_col), own.alias("cluster"), F.col("best.distance").alias("distance"), per_cluster[own].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), names[own].alias("centroid_sha256"))
