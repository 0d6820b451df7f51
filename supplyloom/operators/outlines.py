"""Area and centroid of places from the vertices of their outlines.

Vertices are rows (place, ring, order, x, y).  A ring is closed from its last vertex
to its first.  Rings are cut into ranges of vertices: the edges inside a range come
from a lead over its rows, the edges between ranges from one row per ring and range,
so a coastline of any length is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from supplyloom.constants import EARTH_RADIUS_KM
from supplyloom.sources.storage import settle


def equal_area(
    df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y", radius: float = EARTH_RADIUS_KM
) -> DataFrame:
    """Add plane coordinates in which areas are those of the sphere (cylindrical).

    Degrees in, units of ``radius`` out.  Edges become straight in the plane, so long
    edges away from the equator differ from great circles.
    """
    return df.withColumns(
        {x: F.radians(lon) * F.lit(float(radius)), y: F.sin(F.radians(lat)) * F.lit(float(radius))}
    )


def geographic(df: DataFrame, x: str, y: str, lon: str, lat: str, radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """Add degrees of plane coordinates from :func:`equal_area`."""
    unit = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(y) / F.lit(float(radius))))
    return df.withColumns(
        {lon: F.degrees(F.col(x) / F.lit(float(radius))), lat: F.degrees(F.asin(unit))}
    )


def _edge(x1, y1, x2, y2) -> dict[str, Column]:
    cross = x1 * y2 - x2 * y1
    return {"_cross": cross, "_mx": (x1 + x2) * cross, "_my": (y1 + y2) * cross}


SUMS = ("_cross", "_mx", "_my")


def ring_moments(
    vertices: DataFrame, ids: Sequence[str], order: str, x: str, y: str, ranges: int | None = None
) -> DataFrame:
    """Twice the signed area and six times the signed moments of every ring.

    ``ids`` name a ring.  Vertices with an unknown coordinate or place in the ring are
    left out, their neighbours are joined by an edge; unknown ids are a ring.  Vertices
    that share a place in the ring follow by coordinates.
    """
    ids = list(ids)
    known = vertices.select(
        *ids, F.col(order).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).filter(F.col("_o").isNotNull() & (F.col("_x") - F.col("_x") == 0) & (F.col("_y") - F.col("_y") == 0))
    along = [*ids, "_o", "_x", "_y"]
    ranged = known.repartitionByRange(ranges, *along) if ranges else known.repartitionByRange(*along)
    dealt = settle(ranged.withColumn("_part", F.spark_partition_id()), "vertices")
    within = Window.partitionBy(*ids, "_part").orderBy("_o", "_x", "_y")
    inner = dealt.withColumns({"_x2": F.lead("_x").over(within), "_y2": F.lead("_y").over(within)})
    inner = inner.withColumns(_edge(F.col("_x"), F.col("_y"), F.col("_x2"), F.col("_y2")))
    vertex = F.struct("_o", "_x", "_y")
    pieces = inner.groupBy(*ids, "_part").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS],
        F.min(vertex).alias("_first"), F.max(vertex).alias("_last"), F.count(F.lit(1)).alias("_n"),
    )
    # One row per ring and range from here on.
    ladder = Window.partitionBy(*ids).orderBy("_part")
    whole = ladder.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = F.coalesce(F.lead("_first").over(ladder), F.first("_first").over(whole))
    joined = pieces.withColumn("_next", follow)
    ends = _edge(*[F.col(c) for c in ("_last._x", "_last._y", "_next._x", "_next._y")])
    return joined.groupBy(*ids).agg(
        *[F.sum(F.col(c) + ends[c]).alias(c) for c in SUMS], F.sum("_n").alias("n_vertices")
    )


def outline_measures(
    vertices: DataFrame, place: Sequence[str], ring: str, order: str, x: str, y: str,
    hole: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """(place, area, centroid_x, centroid_y, n_rings, n_vertices).

    Rings count by their size, whichever way round they are listed; rings with a true
    ``hole`` are taken off.  The flag belongs to the ring: rows that differ in it are
    rings apart, unknown is no hole.  Rings of fewer than three vertices have no area.
    A place without area has an unknown centroid; a place without a whole vertex is left out.
    Holes are expected inside outlines and outlines apart, which is not checked.
    """
    place = list(place)
    inside = F.coalesce(F.col(hole), F.lit(False)) if hole else F.lit(False)
    rings = ring_moments(vertices.withColumn("_hole", inside), [*place, ring, "_hole"], order, x, y, ranges)
    sign = F.when(F.col("_cross") < 0, -1.0).otherwise(1.0) * F.when(F.col("_hole"), -1.0).otherwise(1.0)
    total = rings.groupBy(*place).agg(
        *[F.sum(sign * F.col(c)).alias(c) for c in SUMS],
        F.count(F.lit(1)).alias("n_rings"), F.sum("n_vertices").alias("n_vertices"),
    )
    weight = F.nullif(F.lit(3.0) * F.col("_cross"), F.lit(0.0))
    return total.select(
        *place,
        (F.col("_cross") / F.lit(2.0)).alias("area"),
        F.try_divide("_mx", weight).alias("centroid_x"),
        F.try_divide("_my", weight).alias("centroid_y"),
        "n_rings", "n_vertices",
    )
