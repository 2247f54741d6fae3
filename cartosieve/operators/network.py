"""Checks of line networks over their end points: dangles, isolated lines, near misses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G
from cartosieve.functions.graphs import groups
from cartosieve.functions.storage import checkpointed
from cartosieve.operators.rows import raw

PLACES = 9
EARTH = 6371008.8  # metres, the radius that haversine_m has
SCAN_EDGES = 2_000_000
WIDE = 4  # cells of near places are so many tolerances wide


def ends(layer: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each line: feature_pos, end (0 or 1), x, y rounded to PLACES decimals. Lines with a z are left out."""
    lines = layer.select("feature_pos", *keep, G.endpoints(F.col("geometry")).alias("pair")).where("pair is not null and pair[0].z is null and pair[1].z is null")
    found = lines.select("feature_pos", *keep, F.posexplode("pair").alias("end", "c"))
    return found.select("feature_pos", *keep, "end", F.round("c.x", PLACES).alias("x"), F.round("c.y", PLACES).alias("y"))


def degrees(layer: DataFrame) -> DataFrame:
    """(x, y, degree): the number of line ends at each place."""
    return ends(layer).groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))


def end_degrees(layer: DataFrame, *keep: str) -> DataFrame:
    """ends with the degree of each; a place with very many ends is one row of the joined side."""
    return ends(layer, *keep).join(degrees(layer).hint("merge"), ["x", "y"])


def loose_ends(layer: DataFrame) -> DataFrame:
    """ends that meet no other: where there is one alone, the place's least is it, and nothing is joined."""
    places = ends(layer).groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"), F.min("feature_pos").alias("feature_pos"), F.min("end").alias("end"))
    return places.where("degree = 1").select("feature_pos", "end", "x", "y")


def _without_roles(layer: DataFrame, role_field: str | None, allowed: tuple[str, ...]) -> DataFrame:
    """The lines whose role is none of those allowed, in any case and with space around it."""
    if not role_field or role_field not in layer.columns:
        return layer
    return layer.where(~F.coalesce(F.lower(F.trim(F.col(role_field).cast("string"))).isin(*[a.lower() for a in allowed]), F.lit(False)))


def _loose(layer: DataFrame, role_field: str | None, allowed: tuple[str, ...], both: bool) -> DataFrame:
    """A derived layer looks small by its files: merge joins here and below keep it from being copied to all tasks."""
    found = loose_ends(layer).groupBy("feature_pos").agg(F.count(F.lit(1)).alias("loose")).where(F.col("loose") >= (2 if both else 1))
    return _without_roles(layer, role_field, allowed).join(found.select("feature_pos").hint("merge"), "feature_pos", "left_semi")


def line_dangle(layer: DataFrame, role_field: str | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Either end meets no other end, and the line's role does not allow that."""
    return raw(_loose(layer, role_field, allowed, both=False), "line_dangle", "An end of the line meets no other line.")


def isolated_segment(layer: DataFrame, role_field: str | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Neither end meets another end."""
    return raw(_loose(layer, role_field, allowed, both=True), "isolated_network_segment", "Neither end of the line meets another line.")


def network_summary(layer: DataFrame) -> DataFrame:
    """One row: segments, multipart, junctions (degree 3 or more), terminals (degree 1)."""
    lines = layer.agg(F.count_if(G.endpoints(F.col("geometry")).isNotNull()).alias("segments"), F.count_if(F.size("geometry.parts") > 1).alias("multipart"))
    nodes = degrees(layer).agg(F.count_if(F.col("degree") >= 3).alias("junctions"), F.count_if(F.col("degree") == 1).alias("terminals"))
    return lines.crossJoin(F.broadcast(nodes))  # one row each


def place_pairs(places: DataFrame, tolerance: float, geographic: bool) -> DataFrame:
    """places(x, y), distinct -> (xa, ya, xb, yb, distance) of each two with 0 < distance <= tolerance, in both directions.

    A grid of cells WIDE times the tolerance: of the plane or, with longitude and latitude and the tolerance in metres, of the space around the
    sphere, where a chord is no longer than its arc. So places near the poles and on both sides of the antimeridian meet like any others. One side
    is in its own cell, the other in all that its reach meets: few rows are copied, and each two meet in one cell.
    """
    if geographic:
        lon, lat = F.radians("x"), F.radians("y")
        at = [F.cos(lat) * F.cos(lon) * EARTH, F.cos(lat) * F.sin(lon) * EARTH, F.sin(lat) * EARTH]
        reach = tolerance * (1 + 1e-9) + 1e-6  # what the functions lose
    else:
        at, reach = [F.col("x"), F.col("y")], tolerance
    width = WIDE * reach
    cells = [f"c{i}" for i in range(len(at))]
    cell = lambda c: F.floor(c / width).cast("long")
    around = lambda c: F.explode(F.sequence(cell(c - reach - F.abs(c) * 1e-12), cell(c + reach + F.abs(c) * 1e-12)))
    left = places.select(F.col("x").alias("xa"), F.col("y").alias("ya"), *[cell(c).alias(name) for name, c in zip(cells, at, strict=True)])
    right = places
    for name, c in zip(cells, at, strict=True):
        right = right.withColumn(name, around(c))
    right = right.withColumnsRenamed({"x": "xb", "y": "yb"})
    if geographic:
        turn = F.pmod(F.col("xb") - F.col("xa") + 180, F.lit(360.0)) - 180  # the shorter way round
        distance = G.haversine_m(F.lit(0.0), F.col("ya"), turn, F.col("yb"))
    else:
        distance = F.sqrt(F.pow(F.col("xb") - F.col("xa"), 2) + F.pow(F.col("yb") - F.col("ya"), 2))
    near = left.join(right.hint("merge"), cells).withColumn("distance", distance)
    return near.where((F.col("distance") > 0) & (F.col("distance") <= tolerance)).select("xa", "ya", "xb", "yb", "distance")


def end_pairs(ends_: DataFrame, tolerance: float, geographic: bool = False) -> DataFrame:
    """Pairs of ends of different lines with 0 < distance <= tolerance, left before right.

    Distances are between distinct places, so that the many ends that meet in one are not compared with each other.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be above 0")
    near = checkpointed(place_pairs(ends_.select("x", "y").distinct(), tolerance, geographic))
    side = lambda s: ends_.select(F.col("feature_pos").alias(s), F.col("end").alias(f"e{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    return near.join(side("a").hint("merge"), ["xa", "ya"]).join(side("b").hint("merge"), ["xb", "yb"]).where("a < b").select("a", "ea", "xa", "ya", "b", "eb", "xb", "yb", "distance")


def _scan(edges: pd.DataFrame) -> pd.DataFrame:
    """(v, s): the centres (1) and flagged lines (2) of one component, its edges(a, b, upto) read in order; lines after `upto` stay undecided unless they are flagged."""
    flagged, centres = set(), set()
    for a, b in edges.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
        if a not in flagged:
            centres.add(a)
            flagged.add(b)
    upto = edges["upto"].iloc[0]
    rest = {b for b in set(edges["b"]) - flagged - centres if b <= upto}
    return pd.DataFrame({"v": [*centres, *rest, *flagged], "s": [1] * (len(centres) + len(rest)) + [2] * len(flagged)})


def first_centres(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """edges(a < b) -> (b, a): each line that a line-by-line scan would flag, with the centre that flags it.

    Scanning in order, a line not flagged yet flags all later neighbours. The centres are thus the first maximal independent
    set: in rounds, a line none of whose earlier neighbours is undecided or a centre becomes a centre, and its neighbours are flagged.
    A chain of lines settles one a round; so after some rounds what is undecided is scanned in order, each connected group
    in one task, its first SCAN_EDGES pairs or so at a time: a line is decided by earlier ones alone.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    state = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("s", F.lit(0)))  # 0 undecided, 1 centre, 2 flagged
    while True:
        for _ in range(rounds):
            seen = edges.join(state.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").groupBy(F.col("b").alias("v")).agg(F.max((F.col("sa") == 1).cast("int")).alias("hit"), F.max((F.col("sa") == 0).cast("int")).alias("waits"))
            state = state.join(seen, "v", "left").select("v", F.when(F.col("s") != 0, F.col("s")).when(F.col("hit") == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0).alias("s"))
            state = checkpointed(state)
            if state.where("s = 0").isEmpty():
                break
        open_ = state.where("s = 0").select("v")
        if open_.isEmpty():
            break
        hit = edges.join(state.where("s = 1").select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        open_ = open_.join(hit, "v", "left_anti")
        between = checkpointed(edges.join(open_.select(F.col("v").alias("a")), "a", "left_semi").join(open_.select(F.col("v").alias("b")), "b", "left_semi").select("a", "b"))
        of = checkpointed(groups(between))
        grouped = between.join(of.select(F.col("v").alias("a"), "g"), "a")
        largest = grouped.groupBy("g").count().agg(F.max("count")).first()[0] or 1
        share = min(1.0, SCAN_EDGES / largest)
        upto = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("a", share, max(10_000, int(10 / share))).alias("mark"), F.max("b").alias("last"))
        upto = upto.select("g", F.when(F.col("n") <= SCAN_EDGES, F.col("last")).otherwise(F.col("mark")).alias("upto"))
        found = grouped.join(upto, "g").where("a <= upto").groupBy("g").applyInPandas(_scan, "v long, s int").withColumnRenamed("s", "new")
        alone = open_.join(of, "v", "left_anti").select("v", F.lit(1).alias("new"))
        state = state.join(found.union(alone), "v", "left").join(hit.withColumn("hit", F.lit(2)), "v", "left")
        state = checkpointed(state.select("v", F.when(F.col("s") != 0, F.col("s")).otherwise(F.coalesce("hit", "new", "s")).alias("s")))
    return edges.join(state.where("s = 1").select(F.col("v").alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("a"))


def _closest(pairs: DataFrame, *order: str) -> DataFrame:
    """(a, b, distance, xa, ya, xb, yb) of the closest ends of each two lines, the first of equal ones."""
    return pairs.groupBy("a", "b").agg(F.min_by(F.struct("distance", "xa", "ya", "xb", "yb"), F.struct("distance", *order)).alias("m")).select("a", "b", "m.*")


def near_miss_pairs(layer: DataFrame, tolerance: float, role_field: str | None = None, allowed: tuple[str, ...] = (), geographic: bool = False) -> DataFrame:
    """(a, b, distance, xa, ya, xb, yb): ends that nearly meet; b is paired with the line a that a scan in order flags it by. On geographic layers the tolerance is in metres."""
    best = checkpointed(_closest(end_pairs(ends(_without_roles(layer, role_field, allowed)), tolerance, geographic), "ea", "eb"))
    return first_centres(best).join(best, ["a", "b"])


def unsnapped_pairs(layer: DataFrame, tolerance: float, role_field: str | None = None, allowed: tuple[str, ...] = (), geographic: bool = False) -> DataFrame:
    """As near_miss_pairs over loose ends; of a left end, the first right end in reach counts."""
    loose = loose_ends(layer).join(_without_roles(layer, role_field, allowed).select("feature_pos").hint("merge"), "feature_pos", "left_semi")
    pairs = end_pairs(loose, tolerance, geographic)
    first = pairs.groupBy("a", "b", "ea").agg(F.min_by(F.struct("distance", "xa", "ya", "xb", "yb"), "eb").alias("m")).select("a", "b", "ea", "m.*")
    best = checkpointed(_closest(first, "ea"))
    return first_centres(best).join(best, ["a", "b"])


def near_miss(layer: DataFrame, tolerance: float, role_field: str | None = None, allowed: tuple[str, ...] = (), geographic: bool = False) -> DataFrame:
    """(feature_pos, related_pos, distance) of near_miss_pairs."""
    return near_miss_pairs(layer, tolerance, role_field, allowed, geographic).select(F.col("a").alias("feature_pos"), F.col("b").alias("related_pos"), "distance")


def unsnapped(layer: DataFrame, tolerance: float, role_field: str | None = None, allowed: tuple[str, ...] = (), geographic: bool = False) -> DataFrame:
    """(feature_pos, related_pos, distance) of unsnapped_pairs."""
    return unsnapped_pairs(layer, tolerance, role_field, allowed, geographic).select(F.col("a").alias("feature_pos"), F.col("b").alias("related_pos"), "distance")


def pair_issues(layer: DataFrame, pairs: DataFrame, problem: str, text: str) -> DataFrame:
    """Raw issues of the left line of each pair; the geometry is the gap between the two ends."""
    gap = G.wkt(G.single_part("LineString", F.array(G.coord(F.col("xa"), F.col("ya")), G.coord(F.col("xb"), F.col("yb")))))
    named = pairs.select(F.col("a").alias("feature_pos"), gap.alias("gap_"), F.col("distance").alias("distance_"))
    rows = layer.join(named.hint("merge"), "feature_pos")
    return raw(rows, problem, F.concat(F.lit(f"{text} Distance: "), F.format_number("distance_", 6), F.lit(".")), F.col("gap_"))


def endpoint_overlay(layer: DataFrame, tolerance: float, geographic: bool = False) -> DataFrame:
    """(feature_pos, role, wkt): of each near miss the two ends that are closest (role endpoint) and the line between them (gap)."""
    pairs = checkpointed(end_pairs(ends(layer), tolerance, geographic))
    closest = pairs.groupBy("a", "b").agg(F.min_by(F.struct("xa", "ya", "xb", "yb"), F.struct("distance", "ea", "eb")).alias("m"))
    chosen = first_centres(pairs).join(closest, ["a", "b"]).select("a", "m.*")
    left, right = G.coord(F.col("xa"), F.col("ya")), G.coord(F.col("xb"), F.col("yb"))
    shape = lambda role, kind, *cs: F.struct(F.lit(role).alias("role"), G.wkt(G.single_part(kind, F.array(*cs))).alias("wkt"))
    shapes = F.array(shape("endpoint", "Point", left), shape("endpoint", "Point", right), shape("gap", "LineString", left, right))
    return chosen.select(F.col("a").alias("feature_pos"), F.explode(shapes).alias("s")).select("feature_pos", "s.role", "s.wkt")

