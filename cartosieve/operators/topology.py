"""Pairwise checks: candidates by a grid of cells, predicates exactly on each pair."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartosieve.functions import geometry as G
from cartosieve.functions import arrangement, codecs, planar
from cartosieve.functions.graphs import groups
from cartosieve.functions.storage import checkpointed
from cartosieve.operators.rows import raw


BOX = ("minx", "miny", "maxx", "maxy")


def cell_size(layer: DataFrame) -> float:
    """Twice the mean extent of the layer's features, so that most lie in a few cells."""
    b = layer.where("geometry is not null and size(geometry.parts) > 0").select(*[c.alias(n) for n, c in G.bounds(F.col("geometry")).items()])
    size = b.agg(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    return 2 * size if size else 1.0


def _boxed(layer: DataFrame, side: str, size: float, keep: list[str], equal: list[str], margin: float) -> DataFrame:
    """The positions and boxes of the layer's shapes, or its own boxes (minx, miny, maxx, maxy), and the level whose cells, size * 2 ** level wide, are no smaller than the box."""
    known = "minx" in layer.columns
    b = {c: F.col(c) for c in BOX} if known else G.bounds(F.col("geometry"))
    rows = (layer if known else layer.where("geometry is not null and size(geometry.parts) > 0")).select(
        F.col("feature_pos").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in keep], *equal,
        (b["minx"] - margin).alias(f"x0_{side}"), (b["miny"] - margin).alias(f"y0_{side}"), (b["maxx"] + margin).alias(f"x1_{side}"), (b["maxy"] + margin).alias(f"y1_{side}"),
    )
    extent = F.greatest(F.col(f"x1_{side}") - F.col(f"x0_{side}"), F.col(f"y1_{side}") - F.col(f"y0_{side}"))
    return rows.withColumn(f"level_{side}", F.when(extent > size, F.ceil(F.log2(extent / size)).cast("int")).otherwise(0))


def _celled(boxed: DataFrame, side: str, size: float, levels: list[int]) -> DataFrame:
    """A row for each cell that a box meets, at its own level and all coarser ones that occur: at most four a level."""
    rows = boxed.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col(f"level_{side}"))))
    width = F.pow(F.lit(2.0), F.col("level")) * size
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"{lo}_{side}") / width), F.floor(F.col(f"{hi}_{side}") / width))
    return rows.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def candidate_pairs(left: DataFrame, right: DataFrame, size: float, keep: list[str] | None = None, same_layer: bool = True, margin: float = 0.0, equal: list[str] | None = None) -> DataFrame:
    """Pairs (a, b) whose boxes meet and whose columns `equal` are the same, once each. In one layer a < b.

    A pair meets at the coarser of its two levels, in the cell that holds the lower left corner of the boxes' overlap, so that a
    large shape among small ones takes few cells. Only positions, boxes and kept columns go to the cells; with_shapes fetches the shapes.
    Both are merge joins: by the size of its files a derived layer looks small enough to be copied to all tasks, which it is not.
    """
    keep, equal = keep or [], equal or []
    sides = {"a": _boxed(left, "a", size, keep, equal, margin), "b": _boxed(right, "b", size, keep, equal, 0.0)}
    found = sides["a"].select(F.col("level_a").alias("level")).union(sides["b"].select("level_b")).distinct().collect()  # levels are powers of two of an extent: some dozens at most
    levels = sorted(r["level"] for r in found) or [0]
    a, b = (_celled(boxed, side, size, levels) for side, boxed in sides.items())
    width = F.pow(F.lit(2.0), F.col("level")) * size
    meet = (F.col("x0_a") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a")) & (F.col("y0_a") <= F.col("y1_b")) & (F.col("y0_b") <= F.col("y1_a"))
    owner = (F.col("cx") == F.floor(F.greatest("x0_a", "x0_b") / width)) & (F.col("cy") == F.floor(F.greatest("y0_a", "y0_b") / width))
    pairs = a.join(b.hint("merge"), ["level", "cx", "cy", *equal]).where((F.col("level") == F.greatest("level_a", "level_b")) & meet & owner)
    return pairs.where("a < b") if same_layer else pairs


def with_shapes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs (a, b) with geometry_a and geometry_b."""
    of = lambda df, c: df.select(F.col("feature_pos").alias(c), F.col("geometry").alias(f"geometry_{c}"))
    return pairs.join(of(left, "a").hint("merge"), "a").join(of(right, "b").hint("merge"), "b")


@F.arrow_udf(T.StructType([T.StructField("relation", T.StringType()), T.StructField("shared", T.DoubleType())]))
def relations(a: pa.Array, b: pa.Array) -> pa.Array:
    """How b lies to a, and the area they share."""
    relation, shared = arrangement.relate(a, b)
    return pa.StructArray.from_arrays([pa.array(np.array(arrangement.RELATIONS, object)[relation], pa.string()), pa.array(shared)], names=["relation", "shared"])


@F.arrow_udf(codecs.GEOMETRY_TYPE)
def intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    """What two polygons have in common; empty if their insides do not meet."""
    found = planar.intersections(arrangement.oriented(a), arrangement.oriented(b), len(a))
    parts = [[(i, k, ring) for i, polygon in enumerate(polygons) for k, ring in enumerate(polygon)] for polygons in found]
    return planar.shapes(["Polygon" if len(polygons) < 2 else "MultiPolygon" for polygons in found], parts)


@F.arrow_udf(T.BooleanType())
def insides_meet(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(arrangement.insides_meet(a, b))


@F.arrow_udf(T.BooleanType())
def meets_itself(geometry: pa.Array) -> pa.Array:
    return pa.array(arrangement.meets_itself(geometry))


#: Evaluated as columns where they stand, not moved into filters and evaluated again there.
relations, intersection, insides_meet, meets_itself = (f.asNondeterministic() for f in (relations, intersection, insides_meet, meets_itself))


SELF_TEXT = "The feature's outline meets itself."


def may_meet_itself(geometry: Column, onward: Column) -> Column:
    """Lines and polygons but those that go on in one direction, which need not be looked at by meets_itself."""
    return (G.is_a(geometry, G.LINES) | G.is_a(geometry, G.POLYGONS)) & ~onward


def self_intersection(layer: DataFrame) -> DataFrame:
    """Lines that are not simple and polygons whose rings meet themselves or pass through each other, all parts of a shape seen together."""
    g = F.col("geometry")
    judged = layer.where(may_meet_itself(g, G.goes_onward(g))).withColumn("hit_", meets_itself(g)).where("hit_")
    return raw(judged, "self_intersection", SELF_TEXT)


def polygon_pairs(layer: DataFrame, keep: list[str] | None = None, other: DataFrame | None = None, equal: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """(a, b, relation, shared, area_a, area_b, kept columns) of polygons whose boxes meet and that fulfil `where`, which may use kept columns as name_a and name_b.

    relation is one of arrangement.RELATIONS; a shape's own area is computed once, not for each pair.
    """
    polygons = lambda df: df.where(G.is_a(F.col("geometry"), G.POLYGONS)).withColumn("area", G.area(F.col("geometry")))
    left = polygons(layer)
    right = left if other is None else polygons(other)
    pairs = candidate_pairs(left, right, cell_size(left), ["area", *(keep or [])], other is None, equal=equal)
    columns = [f"{c}_{s}" for c in ["area", *(keep or [])] for s in "ab"]
    shown = with_shapes((pairs if where is None else pairs.where(where)).select("a", "b", *columns), left, right)
    return shown.withColumn("m", relations("geometry_a", "geometry_b")).select("a", "b", *columns, "m.relation", "m.shared")


def shape_pairs(layer: DataFrame, equal: list[str] | None = None) -> DataFrame:
    """(a, b, relation, shared) of features of any kind whose boxes meet and whose columns `equal` are the same."""
    known = layer.where(G.is_a(F.col("geometry"), G.LINES + G.POLYGONS + G.POINTS))
    pairs = with_shapes(candidate_pairs(known, known, cell_size(known), equal=equal).select("a", "b"), known, known)
    return pairs.withColumn("m", relations("geometry_a", "geometry_b")).select("a", "b", "m.relation", "m.shared")


def _flagged(layer: DataFrame, pairs: DataFrame, problem: str, text: str) -> DataFrame:
    """Each feature of a pair once."""
    found = pairs.select(F.explode(F.array("a", "b")).alias("feature_pos")).distinct()
    return raw(layer.join(found.hint("merge"), "feature_pos", "left_semi"), problem, text)


def overlaps(layer: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Partial overlap of polygons: equal shapes and shapes inside others do not count. polygon_pairs or shape_pairs may be given."""
    pairs = polygon_pairs(layer) if pairs is None else pairs
    return _flagged(layer, pairs.where("relation = 'partial' and shared > 0"), "polygon_overlap_same_layer", "The polygon overlaps another of its layer.")


def within(layer: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The inner of two nested features of any kind; both of equal ones. shape_pairs may be given."""
    inner = F.when(F.col("relation") == "equal", F.array("a", "b")).when(F.col("relation") == "a_within_b", F.array("a")).when(F.col("relation") == "b_within_a", F.array("b"))
    found = (shape_pairs(layer) if pairs is None else pairs).select(F.explode(inner).alias("feature_pos")).distinct()
    return raw(layer.join(found.hint("merge"), "feature_pos", "left_semi"), "feature_within_feature", "The feature lies within another of its layer.")


def _border(geometry: Column) -> Column:
    """The two ends (x, y) of a line of one part that does not end where it begins; null for all else."""
    ends = F.when(F.size(geometry["parts"]) == 1, G.endpoints(geometry))
    at = lambda i: F.struct(F.get(ends, F.lit(i))["x"].alias("x"), F.get(ends, F.lit(i))["y"].alias("y"))
    return F.when(at(0) != at(1), F.array(at(0), at(1)))


def crossing_pairs(layer: DataFrame, equal: list[str] | None = None) -> DataFrame:
    """(a, b): features, of which one at least is a line, whose insides meet: they intersect and do not merely touch.

    Where two boxes have one point in common, nothing else can meet; if it is an end of either line, the two merely touch there, and their shapes are not fetched.
    """
    known = layer.where(G.is_a(F.col("geometry"), G.LINES + G.POLYGONS + G.POINTS)).select("*", G.is_a(F.col("geometry"), G.LINES).alias("line"), _border(F.col("geometry")).alias("border"))
    low, high = (F.struct(*[f(F.col(f"{c}{n}_a"), F.col(f"{c}{n}_b")).alias(c) for c in "xy"]) for f, n in ((F.greatest, 0), (F.least, 1)))
    touch = (low == high) & (F.array_contains("border_a", low) | F.array_contains("border_b", low))
    met = candidate_pairs(known, known, cell_size(known), ["line", "border"], equal=equal).where("line_a or line_b").where(~F.coalesce(touch, F.lit(False)))
    pairs = with_shapes(met.select("a", "b"), layer, layer)
    return pairs.withColumn("hit", insides_meet("geometry_a", "geometry_b")).where("hit").select("a", "b")


def line_intersections(layer: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    return _flagged(layer, crossing_pairs(layer) if pairs is None else pairs, "line_intersection_same_layer", "The line crosses another of its layer.")


def not_split(layer: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The same pairs as line_intersections, which may be given."""
    return _flagged(layer, crossing_pairs(layer) if pairs is None else pairs, "feature_not_split_at_intersection", "The line is not split where it crosses another.")


def duplicate_geometry(layer: DataFrame) -> DataFrame:
    """All features whose coordinates are those of another, in the same order. Counts are made before the join."""
    shapes = layer.where("geometry is not null").select("*", F.sha2(F.to_json("geometry"), 256).alias("shape"))
    same = shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("feature_pos").alias("first_pos")).where("n > 1")
    found = shapes.join(same.hint("merge"), "shape")
    text = F.when(F.col("feature_pos") == F.col("first_pos"), "The geometry is duplicated by another feature.").otherwise("The geometry duplicates another feature's.")
    return raw(found, "duplicate_geometry_same_layer", text)


def boundary_mismatch(layer: DataFrame, reference: DataFrame, max_ratio: float = 0.02) -> DataFrame:
    """(feature_pos, reference_pos, ratio): polygons whose best-matching reference differs by more than the ratio of their union."""
    pairs = polygon_pairs(layer, other=reference).where("relation <> 'apart' and shared > 0")
    best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "shared", "area_a", "area_b"), F.struct("shared", (-F.col("b")).alias("first"))).alias("m"))
    union = F.col("m.area_a") + F.col("m.area_b") - F.col("m.shared")
    ratio = (union - F.col("m.shared")) / union
    return best.select(F.col("a").alias("feature_pos"), F.col("m.b").alias("reference_pos"), ratio.alias("ratio")).where(F.col("ratio") > max_ratio)


def _left_over(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(feature_pos, edge, t, the edges' other columns): what of each edge, 0 to 1 along it, the stretches (feature_pos, edge, lo, hi) that are gone leave: up to each of them from the furthest before, and from the furthest of all."""
    own = F.struct(*[c for c in edges.columns if c not in ("feature_pos", "edge")])
    none = F.lit(None)
    rows = edges.select("feature_pos", "edge", own.alias("own"), none.cast("double").alias("lo"), none.cast("double").alias("hi")).unionByName(gone.withColumn("own", none))
    edge = Window.partitionBy("feature_pos", "edge")
    furthest = lambda w: F.greatest(F.lit(0.0), F.max("hi").over(w))
    before = edge.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.select("feature_pos", "edge", "own", F.first("own", True).over(edge).alias("of"), F.when(F.col("own").isNull(), furthest(before)).otherwise(furthest(edge)).alias("low"), F.when(F.col("own").isNull(), F.col("lo")).otherwise(1.0).alias("high"))
    left = found.where(F.when(F.col("own").isNull(), F.col("high") > F.col("low") + arrangement.ON_LINE).otherwise(F.col("low") < 1 - arrangement.ON_LINE))
    return left.where("of is not null").select("feature_pos", "edge", "of.*", F.struct(F.col("low").alias("lo"), F.col("high").alias("hi")).alias("t"))


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Polygons -> their boxes, the corners of their oriented rings, one after the other, and the size of each ring; none for polygons without inside."""
    for batch in batches:
        edges = arrangement.oriented(batch.column("geometry"))
        job, first, n = np.unique(edges.job, return_index=True, return_counts=True)
        at = np.flatnonzero(np.concatenate(([True], edges.ring[1:] != edges.ring[:-1]))) if len(edges.ring) else np.zeros(0, np.int64)
        rings = np.bincount(np.searchsorted(job, edges.job[at]), minlength=len(job))
        low, high = (c[job] for c in arrangement.extents(batch.num_rows, edges))
        own = [batch.column(c).take(pa.array(job)) for c in ("feature_pos", "key")]
        xy = planar.lists(2 * n, edges.s[:, :2].reshape(-1))
        sizes = planar.lists(rings, np.diff(np.concatenate((at, [len(edges.ring)]))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*own, *[pa.array(c) for c in (*low.T, *high.T)], xy, sizes], names=["feature_pos", "key", *BOX, "xy", "sizes"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of outlines -> the stretches of the edges of both, by their place in the polygon, that are none of the outline of the pair's union."""
    for batch in batches:
        edges = {c: arrangement.of_corners(batch.column(f"xy_{c}"), batch.column(f"sizes_{c}")) for c in "ab"}
        for own, other, first in (("a", "b", True), ("b", "a", False)):
            found = planar.covered(edges[own], edges[other], batch.num_rows, first)
            place = found.segment - np.searchsorted(edges[own].job, found.job)
            columns = [batch.column(own).to_numpy()[found.job], place.astype(np.int32), found.low, found.high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature_pos", "edge", "lo", "hi"])


def _lines(low: tuple[float, float], grain: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Outlines with what is left of their edges (pieces; no lo: the edge is not whole) -> the rings that stay, and lines of what stays of others, as planar.joined_pieces has them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 33
        for batch in batches:
            edges = arrangement.of_corners(batch.column("xy"), batch.column("sizes"))
            pieces = batch.column("pieces")
            row, flat = pc.list_parent_indices(pieces).to_numpy(), pc.list_flatten(pieces)
            edge, lo, hi = (pc.struct_field(flat, c) for c in ("edge", "lo", "hi"))
            place = np.searchsorted(edges.job, row) + edge.to_numpy()
            part, ring = planar.left_parts(edges, place, pc.fill_null(lo, np.nan).to_numpy(), pc.fill_null(hi, np.nan).to_numpy())
            found = planar.joined_pieces(part, ring, np.array(low), grain)
            job = np.zeros(len(edges.job) and int(edges.ring.max()) + 1, np.int64)
            job[edges.ring] = edges.job
            end = pa.StructArray.from_arrays([pa.array(c) for c in (*found.corners.T, *found.angles.T)], names=["k0x", "k0y", "k1x", "k1y", "go", "come"], mask=pa.array(found.closed))
            columns = [batch.column("key").take(pa.array(job[found.ring])), pa.array(found.number + done), pa.array(found.area), planar.lists(found.sizes, found.xy.reshape(-1)), end]
            done += len(part)
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ring", "area", "xy", "end"])

    return made


def union_outline(layer: DataFrame, key: str | None = None) -> tuple[DataFrame, tuple[float, float], float]:
    """((key, ring, area, xy, end), low, grain): the outline of the union of all polygons, or of those of each key, its inside on the left, as rings that are whole (end is null) and lines between the places where it
    goes on along another polygon; end has a line's ends on a fine grid from `low` and its first and last direction. xy has x and y of each corner in turn, ring is the number of the first edge; the others follow.

    Each polygon's outline loses what lies inside a neighbour, between the two, or along a neighbour that comes first; neighbours meet by the grid of cells, so no task sees the layer. Outlines are kept once, as plain
    corners: what neighbours take from them comes to them, and only lines, not edges, are to be put together by others.
    """
    polygons = layer.where(G.is_a(F.col("geometry"), G.POLYGONS)).where("size(geometry.parts) > 0").select(F.col("feature_pos").cast("long").alias("feature_pos"), (F.col(key) if key else F.lit("")).alias("key"), "geometry")
    kind = polygons.schema["key"].dataType.simpleString()
    known = checkpointed(polygons.mapInArrow(_outlines, f"feature_pos long, key {kind}, {', '.join(f'{c} double' for c in BOX)}, xy array<double>, sizes array<int>"))
    box = known.agg(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))).alias("size"), *[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True)]).first()
    low = (box["minx"] or 0.0, box["miny"] or 0.0)
    grain = 1.0 if box["minx"] is None else max(box["maxx"] - box["minx"], box["maxy"] - box["miny"], 1e-300) * 1e-9
    boxes = known.select("feature_pos", "key", *BOX)
    pairs = candidate_pairs(boxes, boxes, 2 * box["size"] if box["size"] else 1.0, equal=["key"]).select("a", "b")
    of = lambda c: known.select(F.col("feature_pos").alias(c), F.col("xy").alias(f"xy_{c}"), F.col("sizes").alias(f"sizes_{c}")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    gone = checkpointed(both.mapInArrow(_covered, "feature_pos long, edge int, lo double, hi double"))
    met = gone.select("feature_pos", "edge").distinct()
    left = _left_over(met.withColumn("met", F.lit(True)), gone).select("feature_pos", "edge", "t.lo", "t.hi")
    none = F.lit(None).cast("double")
    pieces = met.select("feature_pos", "edge", none.alias("lo"), none.alias("hi")).union(left).groupBy("feature_pos").agg(F.collect_list(F.struct("edge", "lo", "hi")).alias("pieces"))
    shown = known.select("feature_pos", "key", "xy", "sizes").join(pieces.hint("merge"), "feature_pos", "left").select("key", "xy", "sizes", "pieces")
    return checkpointed(shown.mapInArrow(_lines(low, grain), f"key {kind}, ring long, area double, xy array<double>, end struct<k0x:long,k0y:long,k1x:long,k1y:long,go:double,come:double>")), low, grain


RINGS = T.ArrayType(T.StructType([T.StructField("ring", T.LongType()), T.StructField("coords", codecs.PART_TYPE["coords"].dataType)]))


@F.arrow_udf(RINGS)
def _in_order(edges: pa.Array) -> pa.Array:
    """Rings, each with the number of its first edge and its corners, from edges each with the number of the next; the lowest corner first and last."""
    row, flat = pc.list_parent_indices(edges).to_numpy(), pc.list_flatten(edges)
    edge, after, x, y, kx, ky = (pc.struct_field(flat, c).to_numpy() for c in ("edge", "b", "x0", "y0", "k0x", "k0y"))
    n = len(edge)
    bounds = np.searchsorted(row, np.arange(len(edges) + 1))
    lowest = np.lexsort((y, x, row))  # the first of each row is its lowest corner
    first = lowest[bounds[:-1][row]] if n else np.zeros(0, np.int64)
    by_number = np.argsort(edge, kind="stable")
    follows = by_number[np.minimum(np.searchsorted(edge[by_number], after), max(n - 1, 0))] if n else np.zeros(0, np.int64)
    ahead = np.where((edge[follows] == after) & (row[follows] == row), follows, first).tolist()
    by_place = np.lexsort((ky, kx))
    corner = np.zeros(n, np.int64)
    corner[by_place[1:]] = np.cumsum((kx[by_place[1:]] != kx[by_place[:-1]]) | (ky[by_place[1:]] != ky[by_place[:-1]]))
    corner, rank = corner.tolist(), np.empty(n, np.int64)
    rank[lowest] = np.arange(n)
    rank, number = rank.tolist(), edge.tolist()
    places, ring, sizes, counts = [], [], [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        begin = now = int(first[lo]) if hi > lo else -1
        loop = []
        for _ in range(hi - lo):
            loop.append(now)
            now = ahead[now]
            if now == begin:
                break
        rings = planar.simple_loops(loop, corner)
        for own in rings:
            low = own.index(min(own, key=rank.__getitem__))
            places += own[low:] + own[: low + 1]
            ring.append(min(number[e] for e in own))
            sizes.append(len(own) + 1)
        counts.append(len(rings))
    ends = lambda c: pa.array(np.concatenate(([0], np.cumsum(c))).astype(np.int32), pa.int32())
    at = np.array(places, np.int64)
    coords = pa.ListArray.from_arrays(ends(sizes), pa.StructArray.from_arrays([pa.array(x[at]), pa.array(y[at]), pa.nulls(len(at), pa.float64())], fields=list(planar.COORD)))
    return pa.ListArray.from_arrays(ends(counts), pa.StructArray.from_arrays([pa.array(ring, pa.int64()), coords], names=["ring", "coords"]))


_in_order = _in_order.asNondeterministic()


def _corner(xy: Column, i: Column) -> Column:
    return G.coord(F.get(xy, 2 * i), F.get(xy, 2 * i + 1))


def _corners(xy: Column) -> Column:
    """Coordinates of x and y in turn; there is one at least."""
    return F.transform(F.sequence(F.lit(0), (F.size(xy) / 2).cast("int") - 1), lambda i: _corner(xy, i))


def outline_rings(outline: tuple[DataFrame, tuple[float, float], float]) -> DataFrame:
    """union_outline -> (key, ring, xy, area): its rings, the lowest corner first and last, positive areas around what is inside, negative ones around holes.

    At each corner the outline goes on with the sharpest left turn, and a ring that comes to a corner again is cut there, so that rings that touch in a point
    stay apart. The rings of the lines that are not whole are connected groups of them; lines near each other are contracted in one task first.
    """
    found, low, grain = outline
    whole, lines = found.where("end is null").select("key", "ring", "xy", "area"), found.where("end is not null").select("key", F.col("ring").alias("edge"), "xy", "end.*")
    slim = lines.drop("xy")
    turn = F.pmod(F.col("e.come") - F.col("n.go") + F.lit(math.pi - 2e-9), F.lit(2 * math.pi))  # back along the same line comes last
    meet = (F.col("e.key") == F.col("n.key")) & (F.col("e.k1x") == F.col("n.k0x")) & (F.col("e.k1y") == F.col("n.k0y"))
    follow = slim.alias("e").join(slim.alias("n"), meet).select(F.col("e.edge").alias("a"), F.col("n.edge").alias("b"), turn.alias("turn"), F.col("e.k1x").alias("x"), F.col("e.k1y").alias("y"))
    follow = checkpointed(follow.groupBy("a").agg(F.min_by(F.struct("b", "x", "y"), F.struct("turn", "b")).alias("m")).select("a", "m.*"))
    ring = groups(follow.where("a != b"), ["y", "x"]).select(F.col("v").alias("edge"), F.col("g").alias("ring"))
    own = lines.join(follow.select(F.col("a").alias("edge"), "b").hint("merge"), "edge").join(ring.hint("merge"), "edge", "left").withColumn("ring", F.coalesce("ring", "edge"))
    number = lambda v, o: F.rint((v - o) / grain).cast("long")

    def edges(line: Column) -> Column:
        last = (F.size(line["xy"]) / 2).cast("int") - 2  # the last corner is the next line's first
        x, y = (lambda i: F.get(line["xy"], 2 * i)), (lambda i: F.get(line["xy"], 2 * i + 1))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            (line["edge"] + i).alias("edge"), F.when(i == last, line["b"]).otherwise(line["edge"] + i + 1).alias("b"), x(i).alias("x0"), y(i).alias("y0"), number(x(i), low[0]).alias("k0x"), number(y(i), low[1]).alias("k0y"),
        ))

    rings = own.groupBy("ring").agg(F.first("key").alias("key"), F.collect_list(F.struct("edge", "b", "xy")).alias("lines")).select("key", F.flatten(F.transform("lines", edges)).alias("edges"))
    made = rings.select("key", F.explode(_in_order("edges")).alias("r")).select("key", "r.ring", F.flatten(F.transform("r.coords", lambda c: F.array(c["x"], c["y"]))).alias("xy"), G.ring_area(F.col("r.coords")).alias("area"))
    return whole.union(checkpointed(made)).where("area != 0")


def gaps(layer: DataFrame, min_area: float = 0.0, key: str | None = None) -> DataFrame:
    """(gap, key, area, x, y, outline): the holes that the union of the layer's polygons, or of those of each key, encloses; x, y is the outline's lowest corner, outline its text."""
    found = outline_rings(union_outline(layer, key)).where("area < 0").withColumn("area", -F.col("area")).where(F.col("area") >= min_area)
    text = F.array_join(F.transform(_corners(F.col("xy")), lambda c: F.concat(G.number_text(c["x"]), F.lit(" "), G.number_text(c["y"]))), ", ")
    return found.select(F.col("ring").alias("gap"), "key", "area", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"), F.concat(F.lit("POLYGON (("), text, F.lit("))")).alias("outline"))


def united(layer: DataFrame, key: str) -> DataFrame:
    """(key, geometry): the union of the polygons of each key (null: none), holes in their shells.

    A hole is of the smallest shell of its key that it lies in: holes' corners and shells' boxes meet by the grid of cells. Corners go to their key once.
    """
    rings = outline_rings(union_outline(layer.where(F.col(key).isNotNull()), key))
    shells, holes = rings.where("area > 0"), rings.where("area < 0")
    at = lambda i: (F.get("xy", F.lit(i)) + F.get("xy", F.lit(i + 2))) / 2
    points = holes.select(F.col("ring").alias("feature_pos"), "key", at(0).alias("minx"), at(1).alias("miny"), at(0).alias("maxx"), at(1).alias("maxy"), F.lit(0.0).alias("area"))
    along = lambda c: F.filter("xy", lambda v, i: i % 2 == c)
    boxes = shells.select(F.col("ring").alias("feature_pos"), "key", "area", along(0).alias("x"), along(1).alias("y")).select("feature_pos", "key", "area", F.array_min("x").alias("minx"), F.array_min("y").alias("miny"), F.array_max("x").alias("maxx"), F.array_max("y").alias("maxy"))
    size = boxes.agg(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    pairs = candidate_pairs(points, boxes, 2 * size if size else 1.0, ["area"], False, equal=["key"]).select("a", "b", "area_b", G.point(F.col("x0_a"), F.col("y0_a")).alias("point"))
    near = pairs.join(shells.select(F.col("ring").alias("b"), "xy").hint("merge"), "b").withColumn("shape", G.single_part("Polygon", _corners(F.col("xy"))))
    inside = near.withColumn("hit", insides_meet("point", "shape")).where("hit").groupBy("a").agg(F.min_by("b", F.struct("area_b", "b")).alias("shell"))
    held = shells.select("key", F.col("ring").alias("shell"), F.lit(False).alias("hole"), "ring", "xy").union(holes.join(inside.withColumnRenamed("a", "ring").hint("merge"), "ring").select("key", "shell", F.lit(True), "ring", "xy"))
    part = held.repartition("key").groupBy("key", "shell").agg(F.sort_array(F.collect_list(F.struct("hole", "ring", "xy"))).alias("rings"))
    whole = part.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shell", "rings"))).alias("shells"))
    numbered = lambda shell, i: F.transform(shell["rings"], lambda r, k: F.struct(i.cast("int").alias("part"), k.cast("int").alias("ring"), _corners(r["xy"]).alias("coords")))
    parts = F.flatten(F.transform("shells", numbered))
    kind = F.when(F.size("shells") == 1, "Polygon").otherwise("MultiPolygon")
    return whole.select("key", F.struct(kind.alias("type"), parts.alias("parts")).cast(G.GEOMETRY).alias("geometry"))


def gap_issues(layer: DataFrame, min_area: float = 0.0) -> DataFrame:
    """A raw issue for each gap of the layer; it belongs to no feature."""
    text = F.concat(F.lit("The layer's polygons leave a gap. Area: "), F.format_number("area", 6), F.lit("."))
    return gaps(layer, min_area).select(F.lit("polygon_gap_same_layer").alias("problem_name"), F.lit(None).cast("long").alias("feature_pos"), F.concat(F.lit("gap_"), F.col("gap")).alias("feature_id"), F.col("outline").alias("geometry"), text.alias("description"))


def mismatch_issues(layer: DataFrame, reference: DataFrame, max_ratio: float = 0.02) -> DataFrame:
    found = boundary_mismatch(layer, reference, max_ratio).withColumnRenamed("ratio", "ratio_").select("feature_pos", "ratio_")
    return raw(layer.join(found.hint("merge"), "feature_pos"), "boundary_mismatch_against_reference", F.concat(F.lit("The boundary differs from its reference by "), F.format_number(F.col("ratio_") * 100, 2), F.lit(" percent of their union.")))
