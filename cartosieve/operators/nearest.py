"""The nearest feature of a reference layer, of any geometry.

Shapes are taken as their segments (points: of no length), equal ones once. The reference's segments are leaves of a tree of cells: by their middles they fall into the
finest cells, FAN * FAN of which make a cell of the next level, and every cell knows the box around its segments. Each segment of a feature starts at the few root cells
and goes down level by level; on each it keeps the cells whose box may hold something nearer than what the feature is sure to find in another.
Levels are joins on the cell, so neither layer is held in one place, and how dense the reference is somewhere does not show elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G
from cartosieve.functions.storage import checkpointed
from cartosieve.operators.rows import raw
from cartosieve.operators.topology import candidate_pairs, cell_size, insides_meet, with_shapes

FAN, LEVELS = 16, 5
BOX = ["x0", "y0", "x1", "y1"]


def segments(layer: DataFrame, pos: str) -> DataFrame:
    """(pos, ax, ay, bx, by): every segment of every shape; a part of one coordinate is a segment of no length, and polygons are their rings."""
    ends = lambda c: F.when(F.size(c) == 1, F.array(F.struct(F.get(c, F.lit(0)).alias("a"), F.get(c, F.lit(0)).alias("b")))).otherwise(F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    shown = layer.where("geometry is not null").select(F.col("feature_pos").alias(pos), F.explode(F.flatten(F.transform("geometry.parts", lambda p: ends(p["coords"])))).alias("s"))
    return shown.select(pos, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length > 0, length)))).otherwise(0.0)
    return F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2)


def segment_distance(p: list[Column], q: list[Column]) -> Column:
    """Of two segments (ax, ay, bx, by); 0 where they cross."""
    side = lambda s, x, y: F.signum((s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0]))
    crossing = (side(p, q[0], q[1]) * side(p, q[2], q[3]) < 0) & (side(q, p[0], p[1]) * side(q, p[2], p[3]) < 0)
    ends = F.least(_to_segment(p[0], p[1], *q), _to_segment(p[2], p[3], *q), _to_segment(q[0], q[1], *p), _to_segment(q[2], q[3], *p))
    return F.when(crossing, 0.0).otherwise(F.sqrt(ends))


def _bounds_between(s: list[Column], box: list[Column]) -> tuple[Column, Column]:
    """The least and the greatest distance that a segment can have from something within a box."""
    x0, x1, y0, y1 = F.least(s[0], s[2]), F.greatest(s[0], s[2]), F.least(s[1], s[3]), F.greatest(s[1], s[3])
    gap = lambda lo, hi, low, high: F.greatest(F.lit(0.0), lo - high, low - hi)
    far = lambda lo, hi, low, high: F.greatest(hi - low, high - lo)
    least = F.sqrt(F.pow(gap(box[0], box[2], x0, x1), 2) + F.pow(gap(box[1], box[3], y0, y1), 2))
    return least, F.sqrt(F.pow(far(box[0], box[2], x0, x1), 2) + F.pow(far(box[1], box[3], y0, y1), 2))


def nearest(layer: DataFrame, reference: DataFrame) -> DataFrame:
    """(feature_pos, reference_pos, distance) of every feature with a shape; of equally near references the smallest position.

    What shares a point, or lies within a polygon, is at distance 0. Features without geometry, and all where the reference has none, have no row. Distances are planar.
    """
    seg = ["ax", "ay", "bx", "by"]
    leaves = checkpointed(segments(reference, "ref").groupBy(*seg).agg(F.min("ref").alias("ref")))
    extent = leaves.agg(*[F.min(F.least(a, b)).alias(n) for n, a, b in (("x0", "ax", "bx"), ("y0", "ay", "by"))], *[F.max(F.greatest(a, b)).alias(n) for n, a, b in (("x1", "ax", "bx"), ("y1", "ay", "by"))]).first()
    none = layer.select("feature_pos", F.col("feature_pos").alias("reference_pos"), F.lit(0.0).alias("distance")).where("false")
    if extent["x0"] is None:
        return none
    width = max(extent["x1"] - extent["x0"], extent["y1"] - extent["y0"], 1e-300) / FAN**LEVELS
    cell = lambda a, b, low: F.least(F.floor(((F.col(a) + F.col(b)) / 2 - low) / width), F.lit(FAN**LEVELS - 1)).cast("long")
    leaves = leaves.select(*seg, "ref", cell("ax", "bx", extent["x0"]).alias("cx"), cell("ay", "by", extent["y0"]).alias("cy"))
    boxed = leaves.select("cx", "cy", F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))
    around = lambda df, *by: df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    levels = [checkpointed(around(boxed, "cx", "cy"))]
    up = lambda c: F.floor(F.col(c) / FAN).cast("long").alias(c)
    for _ in range(LEVELS - 1):
        levels.append(checkpointed(around(levels[-1].select(up("cx"), up("cy"), *BOX), "cx", "cy")))
    roots = levels.pop().collect()  # FAN * FAN cells at most
    tree = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("cx", "cy", *BOX)]) for r in roots])
    own = [F.col(c) for c in seg]
    wanted = segments(layer, "pos").distinct()
    found = wanted.select("pos", *seg, F.explode(tree).alias("c")).select("pos", *seg, "c.*")
    by_feature = Window.partitionBy("pos")

    def kept(df: DataFrame) -> DataFrame:
        least, most = _bounds_between(own, [F.col(c) for c in BOX])
        return df.withColumns({"least": least, "most": F.min(most).over(by_feature)}).where("least <= most").select("pos", *seg, F.col("cx").alias("px"), F.col("cy").alias("py"))

    for below in reversed(levels):
        children = below.select(F.floor(F.col("cx") / FAN).cast("long").alias("px"), F.floor(F.col("cy") / FAN).cast("long").alias("py"), "cx", "cy", *BOX)
        found = kept(found).join(children, ["px", "py"]).drop("px", "py")
    entries = leaves.select(F.col("cx").alias("px"), F.col("cy").alias("py"), "ref", *[F.col(c).alias(f"r{c}") for c in seg])
    away = kept(found).join(entries, ["px", "py"]).select("pos", "ref", segment_distance(own, [F.col(f"r{c}") for c in seg]).alias("distance"))
    polygon = lambda df: df.where("geometry is not null").withColumn("filled", G.is_a(F.col("geometry"), G.POLYGONS))
    left, right = polygon(layer), polygon(reference)
    any_left, any_right = (not side.where("filled").isEmpty() for side in (left, right))
    if any_left or any_right:  # without polygons nothing lies within anything, and no boxes are dealt to cells
        pairs = candidate_pairs(left if any_right else left.where("filled"), right if any_left else right.where("filled"), cell_size(right), ["filled"], False).where("filled_a or filled_b")
        inside = with_shapes(pairs.select("a", "b"), left, right).withColumn("hit", insides_meet("geometry_a", "geometry_b")).where("hit")
        away = away.union(inside.select(F.col("a").alias("pos"), F.col("b").alias("ref"), F.lit(0.0).alias("distance")))
    best = away.groupBy("pos").agg(F.min(F.struct("distance", "ref")).alias("m"))
    return best.select(F.col("pos").alias("feature_pos"), F.col("m.ref").alias("reference_pos"), F.col("m.distance").alias("distance"))


def positional_accuracy(layer: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Features of any geometry that are farther than the tolerance from the nearest reference feature; with tolerance 0 all that touch none. Without reference features all are too far."""
    found = nearest(layer, reference).select("feature_pos", F.col("distance").alias("distance_"))
    far = layer.where("geometry is not null and size(geometry.parts) > 0").join(found, "feature_pos", "left").where(F.col("distance_").isNull() | (F.col("distance_") > tolerance))
    text = F.when(F.col("distance_").isNull(), "There is no reference feature.").otherwise(F.concat(F.lit("The nearest reference feature is "), F.format_number("distance_", 3), F.lit(f" away, over {tolerance:g}.")))
    return raw(far, "positional_accuracy_exceeds_reference_tolerance", text)
