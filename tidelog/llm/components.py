"""Connected components of an edge table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import stored


def _is_done(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one that has none itself. Edges lead from larger to smaller."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("y").alias("node"), F.lit(0).alias("up")))).alias("end"))
    nodes = ends.select("end.*").groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not nodes.agg(F.max((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("edge"))
    both = both.select("edge.*")
    least = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root"))
    return (both.where("y > x").join(least, F.col("x") == F.col("node"))
            .select(F.col("y").alias("x"), F.col("root").alias("y")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges lead from larger to smaller."""
    least = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root"))
    return edges.join(least, F.col("x") == F.col("node")).select(
        F.when(F.col("y") == F.col("root"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("root").alias("y"))


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(x, y) with one row per node that is not the least of its component; y is the least.

    `edges` are pairs (x, y) of longs. Stars make one edge of one, so edges do not grow; those of every round are written to
    the shared folder. Least neighbours are joined, so that Spark may split the edges of a node that has very many.
    """
    edges = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()
    edges, turn = stored(edges, folder, f"{name}-0"), 0
    while not _is_done(edges):
        turn += 1
        edges = stored(_small_star(_large_star(edges)).distinct(), folder, f"{name}-{turn}")
    return edges
