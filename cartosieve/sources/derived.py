"""Feature layers derived from the given tables: whole-number or dyadic coordinates, so that predicates are exact.

Each layer has feature_pos, feature_id, geometry and attributes. The SQL next to each says the same for an oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G


#: So many rows of a table are one task's.
TASK_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to tasks by its rows: in a small file there may be many, and what is derived from them is larger than they are."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = -(-rows.count() // TASK_ROWS)
    return rows.repartition(tasks) if tasks > max(1, len(rows.inputFiles())) else rows


def once(shape: Column) -> Column:
    """The shape as a value that is made for each row once: a plain expression would be moved into every filter and made again wherever that reads it."""
    return F.when(F.monotonically_increasing_id() >= 0, shape)


def whole(x, by: int):
    return F.floor(x / by).cast("long")


def points_of(customers: DataFrame) -> DataFrame:
    """A point for each customer; one in ten stands on its neighbour, one in 89 has no geometry."""
    key = F.col("c_custkey")
    k = key - F.when(key % 10 == 1, 1).otherwise(0)
    at = G.point(k % 97, whole(k, 97))
    return customers.select(
        key.alias("feature_pos"), key.alias("feature_id"), F.when(key % 89 != 0, at).alias("geometry"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").alias("district"),
    )


def asset_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(table(spark, sf_dir, "customer"))


POINTS_SQL = """SELECT c_custkey AS fid, (c_custkey - CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END) % 97 AS x,
    CAST(floor((c_custkey - CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END) / 97.0) AS BIGINT) AS y, c_custkey % 89 = 0 AS missing, c_mktsegment AS status, c_nationkey AS district FROM customer"""


def pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each order: along a row of the grid, or across it; some start late, bend or repeat a vertex, some lie a quarter above their row, which leaves gaps in it."""
    k = F.col("o_orderkey")
    across = k % 29 == 0
    x, y = k % 100, whole(k, 100) + F.when(~across & (k % 17).isin(0, 2), 0.25).otherwise(0.0)
    start = F.when(across, G.coord(x - 0.5, y - 0.5)).otherwise(G.coord(x + F.when(k % 23 == 0, 0.0625).otherwise(0.0), y))
    end = F.when(across, G.coord(x - 0.5, y + 0.5)).otherwise(G.coord(x + 1, y))
    again = F.when(k % 31 == 0, F.array(start)).otherwise(F.array().cast(f"array<{G.COORD}>"))
    bend = F.when(~across & (k % 7 == 0), F.array(G.coord(x + 0.5, y + 0.125))).otherwise(F.array().cast(f"array<{G.COORD}>"))
    line = G.single_part("LineString", F.concat(F.array(start), again, bend, F.array(end)))
    return table(spark, sf_dir, "orders").select(
        k.alias("feature_pos"), k.alias("feature_id"), once(line).alias("geometry"), F.lower(F.substring_index("o_orderpriority", "-", -1)).alias("asset_class"), F.col("o_orderstatus").alias("status"),
    )


PIPES_SQL = """SELECT o_orderkey AS fid, o_orderkey % 29 = 0 AS across, o_orderkey % 31 = 0 AS again, o_orderkey % 29 <> 0 AND o_orderkey % 7 = 0 AS bend,
    CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey % 100 - 0.5 ELSE o_orderkey % 100 + CASE WHEN o_orderkey % 23 = 0 THEN 0.0625 ELSE 0.0 END END::DOUBLE AS sx,
    CASE WHEN o_orderkey % 29 = 0 THEN floor(o_orderkey / 100.0) - 0.5 ELSE floor(o_orderkey / 100.0) + CASE WHEN o_orderkey % 17 IN (0, 2) THEN 0.25 ELSE 0.0 END END::DOUBLE AS sy,
    CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey % 100 - 0.5 ELSE o_orderkey % 100 + 1.0 END::DOUBLE AS ex,
    CASE WHEN o_orderkey % 29 = 0 THEN floor(o_orderkey / 100.0) + 0.5 ELSE floor(o_orderkey / 100.0) + CASE WHEN o_orderkey % 17 IN (0, 2) THEN 0.25 ELSE 0.0 END END::DOUBLE AS ey,
    lower(split_part(o_orderpriority, '-', -1)) AS asset_class, o_orderstatus AS status FROM orders"""


def zones(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """A rectangle for each part; names repeat and rectangles overlap."""
    p = F.col("p_partkey")
    moved = F.when(p % 2 == 0, shift).otherwise(0.0)
    x0, y0 = (p % 40) * 2 + moved, whole(p, 40) * 2
    shape = G.rectangle(x0, y0, x0 + 1 + F.col("p_size") % 4, y0 + 1 + F.col("p_size") % 3)
    return table(spark, sf_dir, "part").select(p.alias("feature_pos"), p.alias("feature_id"), shape.alias("geometry"), F.col("p_brand").alias("dma_name"), F.col("p_type").alias("office"))


ZONES_SQL = """SELECT p_partkey AS fid, (p_partkey % 40) * 2.0::DOUBLE AS x0, floor(p_partkey / 40.0) * 2.0::DOUBLE AS y0,
    (p_partkey % 40) * 2.0::DOUBLE + 1 + p_size % 4 AS x1, floor(p_partkey / 40.0) * 2.0::DOUBLE + 1 + p_size % 3 AS y1, p_brand AS dma_name, p_type AS office FROM part"""


def reference_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each supplier on the grid of asset_points."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("feature_pos"), s.alias("feature_id"), G.point((s * 7) % 97, whole(s * 7, 97)).alias("geometry"))


REFERENCE_SQL = "SELECT s_suppkey AS rid, (s_suppkey * 7) % 97 AS rx, CAST(floor(s_suppkey * 7 / 97.0) AS BIGINT) AS ry FROM supplier"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of three or four vertices for each order; one in 37 crosses itself."""
    k = F.col("o_orderkey")
    x, y = k % 100 * 2, whole(k, 100) * 2
    bow, plain = F.array(G.coord(x, y), G.coord(x + 1, y + 1), G.coord(x + 1, y), G.coord(x, y + 1)), F.array(G.coord(x, y), G.coord(x + 1, y), G.coord(x + 1, y + 1))
    return table(spark, sf_dir, "orders").select(k.alias("feature_pos"), k.alias("feature_id"), once(G.single_part("LineString", F.when(k % 37 == 0, bow).otherwise(plain))).alias("geometry"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rectangles around a hole for each supplier with an even key, three of them for the others."""
    s = F.col("s_suppkey")
    x, w = s * 10, 1 + s % 3
    sides = F.array(G.rectangle(x, F.lit(0), x + w + 2, F.lit(1)), G.rectangle(x, F.lit(0), x + 1, F.lit(3)), G.rectangle(x + w + 1, F.lit(0), x + w + 2, F.lit(3)), G.rectangle(x, F.lit(2), x + w + 2, F.lit(3)))
    shapes = F.when(s % 2 == 0, sides).otherwise(F.slice(sides, 1, 3))
    return table(spark, sf_dir, "supplier").select(s.alias("block"), F.posexplode(shapes).alias("i", "geometry")).select((F.col("block") * 4 + F.col("i")).alias("feature_pos"), (F.col("block") * 4 + F.col("i")).alias("feature_id"), "block", "geometry")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each supplier as if it named a layer: crs, title, extent and index status, some absent."""
    s = F.col("s_suppkey")
    crs = F.when(s % 5 == 1, "EPSG:4326").when(s % 5 == 2, "EPSG:3857").when(s % 5 == 3, "urn:ogc:def:crs:EPSG::4326").when(s % 5 == 4, "local grid")
    kind = F.when(s % 3 == 0, "Point").when(s % 3 == 1, "LineString").otherwise("Polygon")
    return table(spark, sf_dir, "supplier").select(
        s.alias("layer_id"), F.col("s_name").alias("layer_name"), crs.alias("crs"), kind.alias("geometry_type"), F.when(s % 7 != 0, F.col("s_name")).alias("title"), F.when(s % 11 == 0, " ").otherwise("0 0 1 1").alias("extent"),
        F.when(s % 4 == 0, "stale").when(s % 4 == 1, "missing").otherwise("current").alias("index_status"),
    )


INVENTORY_SQL = """SELECT s_suppkey AS layer_id, s_name AS layer_name, CASE s_suppkey % 5 WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'EPSG:3857' WHEN 3 THEN 'urn:ogc:def:crs:EPSG::4326' WHEN 4 THEN 'local grid' END AS crs,
    CASE s_suppkey % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS geometry_type, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS title, CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE '0 0 1 1' END AS extent,
    CASE s_suppkey % 4 WHEN 0 THEN 'stale' WHEN 1 THEN 'missing' ELSE 'current' END AS index_status FROM supplier"""


def archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """inventory and the features of its layers: for each supplier three points of which two are one, four short lines with a crossing, or the sides of a frame, by its key; one in 13 has none."""
    s = F.col("s_suppkey")
    n = F.lit(None)
    points = F.array(G.point(s, F.lit(0)), G.point(s, F.lit(0)), G.point(s, F.lit(1)), n.cast(G.GEOMETRY))
    line = lambda *c: G.single_part("LineString", F.array(*[G.coord(F.lit(x), F.lit(y)) for x, y in c]))
    lines = F.array(line((0, 0), (2, 0)), line((2, 0), (2, 2)), line((1, -1), (1, 1)), line((9, 9), (9, 9), (10, 9)))
    w = 1 + s % 3
    zero = F.lit(0)
    sides = F.array(G.rectangle(zero, zero, w + 2, F.lit(1)), G.rectangle(zero, zero, F.lit(1), F.lit(3)), G.rectangle(w + 1, zero, w + 2, F.lit(3)), G.rectangle(zero, F.lit(2), w + 2, F.lit(3)))
    shapes = F.when(s % 3 == 0, points).when(s % 3 == 1, lines).otherwise(sides)
    rows = table(spark, sf_dir, "supplier").where(s % 13 != 0).select(s.alias("layer_id"), F.posexplode(shapes).alias("i", "geometry"))
    return inventory(spark, sf_dir), rows.select("layer_id", (F.col("layer_id") * 4 + F.col("i")).alias("feature_pos"), (F.col("layer_id") * 4 + F.col("i")).alias("feature_id"), "geometry")


def plots_of(parts: DataFrame, *more: str) -> DataFrame:
    """Two turned polygons for each part, with irrational coordinates: nested, equal but begun elsewhere, partly overlapping, or one in the other's hole. Columns of the parts may come along."""
    p = F.col("p_partkey")
    x, y = p % 40 * 10, whole(p, 40) * 10
    at = lambda i, n, r, dx: G.coord(x + dx + r * F.cos(p + i * (2 * math.pi) / n), y + r * F.sin(p + i * (2 * math.pi) / n))
    gon = lambda n, r, first=0, dx=0.0: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: at((i + first) % n, n, r, F.lit(dx)))
    part = lambda ring, coords: F.struct(F.lit(ring).alias("ring"), coords.alias("coords"))
    outer = F.when(p % 4 == 3, F.array(part(0, gon(9, 3.0)), part(1, gon(9, 1.5)))).otherwise(F.array(part(0, gon(9, 3.0))))
    second = F.when(p % 4 == 1, gon(9, 3.0, 4)).when(p % 4 == 2, gon(9, 3.0, 0, 2.0)).otherwise(gon(7, 1.0))
    shape = lambda parts: G.of_parts("Polygon", parts)
    return parts.select(p.alias("part"), *more, F.posexplode(F.array(shape(outer), shape(F.array(part(0, second))))).alias("i", "geometry")).select(
        (F.col("part") * 2 + F.col("i")).alias("feature_pos"), (F.col("part") * 2 + F.col("i")).alias("feature_id"), "geometry", *more,
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots_of(table(spark, sf_dir, "part"))


#: Two shapes for each rest of a part's key by 8: kind and (part, ring, corners).
MIXED = (
    (("MultiLineString", ((0, 0, ((0, 0), (4, 4))), (1, 0, ((0, 4), (4, 0))))), ("Point", ((0, 0, ((1, 1),)),))),
    (("MultiLineString", ((0, 0, ((0, 0), (2, 2))), (1, 0, ((2, 2), (4, 0))))), ("Point", ((0, 0, ((0, 0),)),))),
    (("MultiLineString", ((0, 0, ((0, 0), (4, 0))), (1, 0, ((2, 0), (2, 3))))), ("LineString", ((0, 0, ((1, -1), (1, 1))),))),
    (("Polygon", ((0, 0, ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))), (0, 1, ((3, 1), (3, 3), (5, 3), (5, 1), (3, 1))))), ("LineString", ((0, 0, ((1, 1), (1, 3))),))),
    (("Polygon", ((0, 0, ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))), (0, 1, ((0, 2), (1, 3), (1, 1), (0, 2))))), ("Point", ((0, 0, ((0.75, 2),)),))),
    (("MultiPolygon", ((0, 0, ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))), (1, 0, ((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))))), ("LineString", ((0, 0, ((5, 5), (6, 5))),))),
    (("MultiPolygon", ((0, 0, ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))), (1, 0, ((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))))), ("LineString", ((0, 0, ((0.5, 0.5), (1.5, 1.5))),))),
    (("MultiLineString", ((0, 0, ((0, 0), (2, 0), (2, 2), (0, 0))), (1, 0, ((0, 0), (-1, -1))))), ("LineString", ((0, 0, ((0, 0), (2, 0))),))),
)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shapes of several parts, holes and kinds for each part, as MIXED has them; how they lie is known from how they were made."""
    p = F.col("p_partkey")
    x, y = p % 40 * 10, whole(p, 40) * 10
    corners = lambda cs: F.array(*[G.coord(x + a, y + b) for a, b in cs])
    shape = lambda kind, parts: F.struct(F.lit(kind).alias("type"), F.array(*[F.struct(F.lit(n).alias("part"), F.lit(r).alias("ring"), corners(cs).alias("coords")) for n, r, cs in parts]).alias("parts")).cast(G.GEOMETRY)
    pairs = F.lit(None)
    for k, two in enumerate(MIXED):
        pairs = F.when(p % 8 == k, F.array(*[shape(*s) for s in two])).otherwise(pairs)
    rows = table(spark, sf_dir, "part").select(p.alias("part"), F.posexplode(pairs).alias("i", "geometry"))
    return rows.select((F.col("part") * 2 + F.col("i")).alias("feature_pos"), (F.col("part") * 2 + F.col("i")).alias("feature_id"), "geometry")


def named_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plots, named by the part's brand and kind. Names are joined before there are shapes, and parts dealt to tasks again: the join leaves many rows to few."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.col("p_partkey"), F.concat_ws(" ", F.col("p_brand"), F.col("p_partkey") % 4).alias("name"))
    named = parts.select("p_partkey").join(names.hint("merge"), "p_partkey")
    return plots_of(named.repartition(max(1, -(-parts.count() // TASK_ROWS))), "name")


PLOTS_SQL = "SELECT p_partkey AS part, p_partkey % 4 AS kind, p_partkey * 2 + i AS fid, i FROM part, (VALUES (0), (1)) s(i)"


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A winding line of 50 to 500 vertices for each order; one in 997 crosses itself, one in 1349 repeats its first vertex.

    The wave is one of seven, by the rest of the key: these are a table of seven rows, so that a vertex takes two sums.
    """
    k, x, y, turn, n = (F.col(c) for c in ("o_orderkey", "x", "y", "turn", "n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (k % 1000 * 10).alias("x"), (whole(k, 1000) * 10).alias("y"), (k % 7).alias("turn"), (50 + k % 451).cast("int").alias("n"))  # not once more for each vertex
    vertices = F.sequence(F.lit(0), F.lit(499))
    waves = spark.range(7).select(F.col("id").alias("turn"), F.transform(vertices, lambda i: i * 0.01).alias("along"), F.transform(vertices, lambda i: 0.3 * F.sin(i * 0.7 + F.col("id"))).alias("wave"))
    shifted = lambda by, steps: F.transform(F.slice(steps, F.lit(1), n), lambda v: by.cast("double") + v)
    line = F.arrays_zip(shifted(x, F.col("along")).alias("x"), shifted(y, F.col("wave")).alias("y"), F.array_repeat(F.lit(None).cast("double"), n).alias("z"))
    none = F.array().cast(f"array<{G.COORD}>")
    again = F.when(k % 1349 == 0, F.array(G.coord(x + 0 * 0.01, y + F.get("wave", F.lit(0))))).otherwise(none)
    back = F.when(k % 997 == 0, F.array(G.coord(x + 0.02, y + 2), G.coord(x + 0.03, y - 2))).otherwise(none)
    coords = F.when((k % 1349 == 0) | (k % 997 == 0), F.concat(again, line, back)).otherwise(line)
    return orders.join(F.broadcast(waves), "turn", "left").select(k.alias("feature_pos"), k.alias("feature_id"), once(G.single_part("LineString", coords)).alias("geometry"))
