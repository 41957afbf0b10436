"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them; edges run from the larger node u to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one neighbour less than itself and none greater, or none less."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    less, greater = F.when(F.col("v") < F.col("u"), F.col("v")), F.when(F.col("v") > F.col("u"), F.col("v"))
    nodes = both.groupBy("u").agg(F.min(less).alias("x"), F.max(less).alias("y"), F.min(greater).alias("z"))
    return not nodes.agg(F.max(F.expr("x < y or x is not null and z is not null"))).first()[0]


def parents(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge that reaches a lesser one; component: the least node that it reaches. Directions,
    repeated edges and loops don't matter. Nodes are never gathered by component: each round is a grouped minimum and a join,
    and is written to the shared folder."""
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "edges")
    if _stars(now):
        now = now.distinct()
    else:
        while not _stars(now := staged(_small(_large(now)).where("u <> v").distinct(), "edges")):
            pass
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge that isn't a loop, the least of each component among them; see parents."""
    found = parents(edges, a, b)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
