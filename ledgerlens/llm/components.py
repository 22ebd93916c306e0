"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks every node's larger (or smaller) neighbours to the node's smallest neighbour.

    The smallest neighbour is a partial aggregate, and the join that hands it out is a sort-merge join that
    Spark can split where one node has very many neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # in small steps every edge points from the larger to the smaller node
        moved = joined.select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = moved.where("u <> v")
    return moved if large else moved.distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the (u, v) edges; a component is named by its smallest node."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = C.saved(pairs, "edges")
    sign = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if sign == (seen["n"], seen["x"]) or not seen["n"]:
            break
        sign = (seen["n"], seen["x"])
        now = C.saved(_star(_star(now, large=True), large=False), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
