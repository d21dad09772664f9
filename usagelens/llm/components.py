"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``edges`` (``a``, ``b``).

    In each round every node is renamed to the smallest of itself and its neighbours, and the edges
    are renamed with it and made distinct, until none is left.  A star takes one round, a path a
    logarithmic number.  Neighbours are combined before the shuffle, and a node with very many edges
    is split by the skew join, as both sides of each join are stored tables.
    """
    edges = stored(edges.select("a", "b").where("a <> b"), "edges")
    labels = stored(
        edges.select("a").union(edges.select("b")).distinct().selectExpr("a AS node", "a AS component"), "labels"
    )
    while not edges.isEmpty():
        ways = edges.union(edges.select("b", "a"))
        parents = stored(
            ways.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a AS child", "least(a, b) AS parent"), "parents"
        )
        labels = stored(
            labels.join(parents, F.col("component") == F.col("child"), "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            ),
            "labels",
        )
        renamed = (
            edges.join(parents, F.col("a") == F.col("child"))
            .selectExpr("parent AS x", "b")
            .join(parents, F.col("b") == F.col("child"))
            .selectExpr("x", "parent AS y")
            .where("x <> y")
        )
        edges = stored(renamed.selectExpr("greatest(x, y) AS a", "least(x, y) AS b").distinct(), "edges")
    return labels
