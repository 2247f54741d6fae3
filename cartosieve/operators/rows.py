"""Checks of single features: geometry, attributes, precision. Each gives raw issues (see plans.issues.RAW)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G


def raw(rows: DataFrame, problem: str, description: Column | str, geometry: Column | None = None) -> DataFrame:
    description = F.lit(description) if isinstance(description, str) else description
    shape = G.wkt(F.col("geometry")) if geometry is None else geometry
    return rows.select(F.lit(problem).alias("problem_name"), "feature_pos", "feature_id", shape.alias("geometry"), description.alias("description"))


NULL_TEXT, VERTEX_TEXT = "Feature has no geometry.", "Two neighbouring vertices of the feature are the same."


def length_text(min_length: float) -> str:
    return f"Line is shorter than {min_length:g}."


def null_geometry(layer: DataFrame) -> DataFrame:
    """An empty geometry is not null."""
    return raw(layer.where("geometry is null"), "null_geometry", NULL_TEXT)


def duplicate_vertex(layer: DataFrame) -> DataFrame:
    return raw(layer.where(G.has_repeated_vertex(F.col("geometry"))), "duplicate_vertex", VERTEX_TEXT)


def below_minimum_length(layer: DataFrame, min_length: float | None = 0.0) -> DataFrame:
    min_length = 0.0 if min_length is None else min_length
    short = layer.where(G.is_a(F.col("geometry"), G.LINES) & (G.planar_length(F.col("geometry")) < min_length))
    return raw(short, "below_minimum_feature_length", length_text(min_length))


def sharp_angle(layer: DataFrame, min_degrees: float | None = 15.0) -> DataFrame:
    min_degrees = 15.0 if min_degrees is None else min_degrees
    angle = G.first_sharp_angle(F.col("geometry"), min_degrees)
    found = layer.where(G.is_a(F.col("geometry"), G.LINES)).withColumn("angle", angle).where("angle is not null")
    return raw(found, "sharp_angle_cutback", F.concat(F.lit("Line turns back at "), F.format_number("angle", 2), F.lit(" degrees.")))


def is_missing(layer: DataFrame, field: str) -> Column:
    missing = F.col(field).isNull()
    return missing | F.isnan(field) if layer.schema[field].dataType.typeName() in ("double", "float") else missing


def required_nulls(layer: DataFrame, fields: Iterable[str]) -> DataFrame:
    """One issue for each field and row without a value; a field that the layer lacks is missing in each row."""
    parts = []
    for field in fields:
        if field in layer.columns:
            parts.append(raw(layer.where(is_missing(layer, field)), "null_attribute_in_required_field", f"Required field {field} has no value."))
        else:
            parts.append(raw(layer, "null_attribute_in_required_field", f"The layer has no required field {field}."))
    return reduce(DataFrame.unionByName, parts)


def require_field(layer: DataFrame, field: str) -> None:
    if field not in layer.columns:
        raise ValueError(f"the layer has no field {field}")


def uniqueness(layer: DataFrame, field: str) -> DataFrame:
    """All rows whose value occurs more than once. Counts are made before the join, so a hot value is one row there."""
    require_field(layer, field)
    present = layer.where(~is_missing(layer, field))
    often = present.groupBy(F.col(field).alias("value_")).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    found = present.join(often, F.col(field) == F.col("value_"), "left_semi")
    return raw(found, "non_unique_attribute", F.concat(F.lit(f"Value of {field} occurs more than once: "), F.col(field).cast("string")))


def domain(layer: DataFrame, field: str, allowed: tuple | set | list | Callable[[Column], Column]) -> DataFrame:
    """allowed: a predicate on the column, an inclusive range (a pair), or values. No value passes."""
    require_field(layer, field)
    c = F.col(field)
    if callable(allowed):
        fits = allowed(c)
    elif isinstance(allowed, tuple) and len(allowed) == 2:
        fits = c.between(*allowed)
    else:
        fits = c.isin(*allowed)
    bad = layer.where(~is_missing(layer, field) & ~F.coalesce(fits, F.lit(False)))
    return raw(bad, "domain_violation", F.concat(F.lit(f"Value of {field} is outside its domain: "), c.cast("string")))


def positive_number(c: Column) -> Column:
    return c > 0


def coordinate_precision(layer: DataFrame, max_decimals: int | None, is_geographic: bool | None = None) -> DataFrame:
    """Without a threshold it follows from the layer's extent."""
    if max_decimals is None:
        max_decimals = adaptive_decimals(layer, is_geographic)
    found = layer.where("geometry is not null").withColumn("n_", G.max_decimals(F.col("geometry"))).where(F.col("n_") > max_decimals)
    return raw(found, "coordinate_precision_not_fit_for_use", F.concat(F.lit("Coordinates have "), F.col("n_").cast("string"), F.lit(f" decimals, more than {max_decimals}.")))


def layer_bounds(layer: DataFrame) -> DataFrame:
    """One row: minx, miny, maxx, maxy."""
    shapes = layer.where("geometry is not null").select(*[c.alias(n) for n, c in G.bounds(F.col("geometry")).items()])
    return shapes.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def adaptive_decimals(layer: DataFrame, is_geographic: bool | None) -> int:
    if is_geographic is None:
        return 9
    b = layer_bounds(layer).first()
    span = 0.0 if b["minx"] is None else max(b["maxx"] - b["minx"], b["maxy"] - b["miny"])
    if is_geographic:
        return 12 if span >= 20 else 11 if span >= 5 else 9
    return 4 if span >= 1e6 else 3


def total_vertices(layer: DataFrame) -> DataFrame:
    return layer.agg(F.coalesce(F.sum(G.vertex_count(F.col("geometry"))), F.lit(0)).alias("n_vertices"), F.count(F.lit(1)).alias("n_features"))
