"""Polygons and the point-in-polygon join."""

from pyspark.sql import functions as F

EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"
SLICE_EDGES_BROADCAST = 500_000   # largest edge count for which the region table is broadcast


def polygons_from_rings(spark, rings):
    """Rows (feature_idx, name, polygon_id, ring_id, edges) from point lists."""
    rows = []
    for idx, name, part, ring, pts in rings:
        edges = [(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1])]
        rows.append((idx, name, part, ring, edges))
    return spark.createDataFrame(
        rows, f"feature_idx bigint, name string, polygon_id int, ring_id int, edges array<{EDGE}>")


def _crossing(e, x, y):
    """1 if a ray from (x, y) to the east crosses the edge."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    return F.when(spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1).otherwise(0)


def _on_edge(e, x, y):
    cross = (x - e["x1"]) * (e["y2"] - e["y1"]) == (y - e["y1"]) * (e["x2"] - e["x1"])
    return (cross & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"]))
            & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"])))


def point_in_polygon(points, regions, key="venue_id", columns=32, name="region"):
    """Add the name of the region that strictly contains each point, NULL if none.

    A feature's rings together follow the even-odd rule, so holes and several parts work; of
    several features that contain a point the last one (highest feature_idx) wins.

    Regions are sliced into latitude bands. A point meets only the slices of its own band, through
    an equi-join, and a slice holds only the edges that reach the band. The slices are broadcast
    if their measured edge count is small; otherwise the join shuffles on the band and column.
    """
    edges = regions.select("feature_idx", "name", F.explode("edges").alias("e"))
    ext = edges.agg(F.min(F.least("e.x1", "e.x2")).alias("x"), F.max(F.greatest("e.x1", "e.x2")).alias("xx"),
                    F.min(F.least("e.y1", "e.y2")).alias("y"), F.max(F.greatest("e.y1", "e.y2")).alias("yy"),
                    F.count("*").alias("n")).first()
    if not ext.n:
        return points.withColumn(name, F.lit(None).cast("string"))
    bands = min(max(columns, ext.n // 64), 8_192)   # detailed outlines get finer bands, so slices stay short
    step_y, step_x = max((ext.yy - ext.y) / bands, 1e-9), max((ext.xx - ext.x) / columns, 1e-9)

    def band(y):
        return F.floor((y - F.lit(ext.y)) / F.lit(step_y))

    def column(x):
        return F.floor((x - F.lit(ext.x)) / F.lit(step_x))

    y_lo, y_hi = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    per_band = (edges.withColumn("band", F.explode(F.sequence(band(y_lo), band(y_hi))))
                .groupBy("feature_idx", "name", "band")
                .agg(F.collect_list("e").alias("edges"),
                     F.min(F.least("e.x1", "e.x2")).alias("x_lo"), F.max(F.greatest("e.x1", "e.x2")).alias("x_hi")))
    slices = per_band.withColumn("column", F.explode(F.sequence(column(F.col("x_lo")), column(F.col("x_hi")))))
    size = slices.agg(F.sum(F.size("edges"))).first()[0]
    if size <= SLICE_EDGES_BROADCAST:
        slices = F.broadcast(slices)
    x, y = F.col("long"), F.col("lat")
    crossings = F.aggregate("edges", F.lit(0), lambda acc, e: acc + _crossing(e, x, y))
    hits = (points.select(key, "lat", "long").withColumn("band", band(y)).withColumn("column", column(x))
            .join(slices, ["band", "column"])
            .filter((crossings % 2 == 1) & ~F.exists("edges", lambda e: _on_edge(e, x, y)))
            .groupBy(key).agg(F.max_by(F.col("name"), F.col("feature_idx")).alias(name)))
    return points.join(hits, key, "left")
