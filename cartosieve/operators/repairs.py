"""Conservative repairs: a layer in, a layer out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.functions import arrangement, codecs, planar
from cartosieve.functions import geometry as G

REPAIRS: dict[str, Callable[..., DataFrame]] = {}


def register_repair(name: str, repair: Callable[..., DataFrame]) -> None:
    REPAIRS[name] = repair


def drop_null_geometries(layer: DataFrame) -> DataFrame:
    return layer.where("geometry is not null")


def _without_repeats(c: Column) -> Column:
    return F.filter(c, lambda v, i: (i == 0) | ~G.same_place(v, F.get(c, F.greatest(i - 1, F.lit(0)))))


def remove_duplicate_vertices(layer: DataFrame) -> DataFrame:
    """A line that would keep fewer than two vertices, or an outer ring fewer than four, stays as it is; such a hole goes."""
    g = F.col("geometry")

    def repaired(p: Column) -> Column:
        clean = _without_repeats(p["coords"])
        least = F.when(G.is_a(g, G.POLYGONS), 4).when(G.is_a(g, G.LINES), 2).otherwise(1)
        kept = F.when((F.size(clean) >= least) | (p["ring"] > 0), clean).otherwise(p["coords"])
        return F.struct(p["part"].alias("part"), p["ring"].alias("ring"), kept.alias("coords"))

    parts = F.filter(F.transform(g["parts"], repaired), lambda p: (p["ring"] == 0) | (F.size(p["coords"]) >= 4))
    fixed = F.when(g.isNotNull() & ~G.is_a(g, G.POINTS), F.struct(g["type"].alias("type"), parts.alias("parts")).cast(G.GEOMETRY)).otherwise(g)
    return layer.withColumn("geometry", fixed)


@F.arrow_udf(codecs.GEOMETRY_TYPE)
def _made_valid(geometry: pa.Array) -> pa.Array:
    """Polygons that meet themselves, mended; null for all else."""
    bad = np.flatnonzero((arrangement.dimensions(geometry) == arrangement.POLYGON) & arrangement.meets_itself(geometry))
    own = geometry.take(pa.array(bad))
    sizes = np.bincount(arrangement.coordinates(own)[1])
    edges = arrangement.segments(own, close=True)
    found = planar.valid(edges.of(sizes[edges.ring] > 2), len(bad))
    parts = [[(i, k, ring) for i, polygon in enumerate(polygons) for k, ring in enumerate(polygon)] for polygons in found]
    mended = planar.shapes(["Polygon" if len(polygons) == 1 else "MultiPolygon" for polygons in found], parts)
    place, none = np.zeros(len(geometry), np.int64), np.ones(len(geometry), bool)
    place[bad], none[bad] = np.arange(len(bad)), False
    return mended.take(pa.array(place, mask=none))


_made_valid = _made_valid.asNondeterministic()  # its result is read several times over


def make_geometries_valid(layer: DataFrame) -> DataFrame:
    """Polygons whose rings meet themselves or each other become what they cover by even and odd crossings; all else stays as it is. A mended shape has no z.

    A shape goes through Python once, whether it is sound or not.
    """
    g = F.col("geometry")
    known = layer.withColumn("mended_", _made_valid(F.when(G.is_a(g, G.POLYGONS), g)))
    return known.withColumn("geometry", F.coalesce("mended_", g)).drop("mended_")


BUILTIN = {"drop_null_geometries": drop_null_geometries, "remove_duplicate_vertices": remove_duplicate_vertices, "make_geometries_valid": make_geometries_valid}


def apply_repairs(layer: DataFrame, enabled: tuple[str, ...] = ("drop_null_geometries", "remove_duplicate_vertices"), disabled: tuple[str, ...] = (), options: dict[str, dict] | None = None) -> DataFrame:
    """The built-in repairs in order, then registered ones by name; names in any case. No names enabled: all of them. options: a repair's own arguments by its name."""
    known = BUILTIN | {name: REPAIRS[name] for name in sorted(REPAIRS)}
    wanted, gone = {n.lower() for n in enabled}, {n.lower() for n in disabled}
    if unknown := wanted - {n.lower() for n in known}:
        raise KeyError(f"no repair {sorted(unknown)[0]}")
    for name, repair in known.items():
        if (not wanted or name.lower() in wanted) and name.lower() not in gone:
            layer = repair(layer, **(options or {}).get(name, {}))
    return layer


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(feature_pos, change): removed rows and rows whose geometry is another."""
    old = before.select("feature_pos", F.to_json("geometry").alias("old"))
    new = after.select("feature_pos", F.to_json("geometry").alias("new"), F.lit(True).alias("there"))
    both = old.join(new, "feature_pos", "left")
    change = F.when(F.col("there").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select("feature_pos", change.alias("change")).where("change is not null")
