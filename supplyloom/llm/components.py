"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from supplyloom.sources.storage import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them.

    The large star moves neighbours above the node, the small star the node and
    its neighbours below.  ``edges`` has (u, v); smallest neighbours are combined
    before the shuffle, and a node of many edges is a join key that adaptive
    execution can split.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).withColumnRenamed("u", "_u")
    hung = both.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("_u").alias("u"), F.col("m").alias("v"))
        )
    return moved.filter(F.col("u") != F.col("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is its component's smallest.

    Large and small stars alternate until nothing changes, which takes a number
    of rounds in the order of the logarithm of the nodes.  Every round is stored.
    """
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    mark = None
    while True:
        now = settle(_star(_star(now, large=True), large=False), "edges")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == mark:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        mark = tuple(sign)
