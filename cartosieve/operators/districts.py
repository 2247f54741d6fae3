"""Rules for named districts: same-name and cross-name overlaps, split districts, dissolving by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G
from cartosieve.operators.topology import intersection, polygon_pairs, united, with_shapes

NESTED, LEAST_OVERLAP = 0.995, 1.0


def name_key(name: Column) -> Column:
    """Lower case; runs of underscores, hyphens and white space are one space; only a-z, 0-9 and spaces stay. Null: empty."""
    one_space = F.regexp_replace(F.lower(F.trim(name.cast("string"))), r"[_\-\s]+", " ")
    return F.coalesce(F.trim(F.regexp_replace(one_space, "[^a-z0-9 ]+", "")), F.lit(""))


def _pairs(layer: DataFrame, name: str, admin: str | None, same: bool) -> DataFrame:
    """Pairs of the same name, or of different names and the same office unless one has none. Only these are measured."""
    keyed = layer.withColumns({"key_": name_key(F.col(name)), "admin_": F.coalesce(F.col(admin).cast("string"), F.lit("")) if admin else F.lit("")}).where("key_ <> ''")
    if same:
        pairs = polygon_pairs(keyed, equal=["key_"])
    else:
        office = (F.col("admin__a") == "") | (F.col("admin__b") == "") | (F.col("admin__a") == F.col("admin__b"))
        pairs = polygon_pairs(keyed, keep=["key_", "admin_"], where=(F.col("key__a") != F.col("key__b")) & office)
    fraction = F.greatest(F.col("shared") / F.col("area_a"), F.col("shared") / F.col("area_b"))
    return pairs.where("area_a > 0 and area_b > 0").withColumn("fraction", fraction)


def _relation() -> Column:
    return F.when(F.col("relation") == "equal", "equal").when((F.col("relation") != "apart") & (F.col("fraction") >= NESTED), "nested")


def _first_of_left(pairs: DataFrame) -> DataFrame:
    """The first partner of each left feature that is equal to it or nested."""
    found = pairs.withColumn("relation", _relation()).where("relation is not null")
    return found.groupBy("a").agg(F.min_by(F.struct("b", "relation"), "b").alias("m")).select(F.col("a").alias("feature_pos"), F.col("m.b").alias("related_pos"), F.col("m.relation").alias("relation"))


def same_name(layer: DataFrame, name: str) -> DataFrame:
    return _first_of_left(_pairs(layer, name, None, same=True))


def cross_name_nested(layer: DataFrame, name: str, admin: str | None = None) -> DataFrame:
    return _first_of_left(_pairs(layer, name, admin, same=False))


def cross_name_overlap(layer: DataFrame, name: str, admin: str | None = None) -> DataFrame:
    """Every pair that shares LEAST_OVERLAP or more without being nested."""
    found = _pairs(layer, name, admin, same=False).where(f"shared >= {LEAST_OVERLAP} and fraction < {NESTED}")
    return found.select(F.col("a").alias("feature_pos"), F.col("b").alias("related_pos"), F.col("shared").alias("area"))


def overlap_shapes(layer: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(feature_pos, related_pos, ...) of polygons with the geometry of what they have in common."""
    shown = with_shapes(pairs.withColumnsRenamed({"feature_pos": "a", "related_pos": "b"}), layer, layer)
    return shown.withColumn("geometry", intersection("geometry_a", "geometry_b")).drop("geometry_a", "geometry_b").withColumnsRenamed({"a": "feature_pos", "b": "related_pos"})


def multipart(layer: DataFrame, name: str) -> DataFrame:
    """(key, parts, feature_pos): names whose polygons have more than one part in all; the first part's feature stands for them."""
    outer = layer.where(G.is_a(F.col("geometry"), G.POLYGONS)).select("feature_pos", name_key(F.col(name)).alias("key"), F.size(F.filter("geometry.parts", lambda p: p["ring"] == 0)).alias("n"))
    return outer.where("key <> ''").groupBy("key").agg(F.sum("n").alias("parts"), F.min("feature_pos").alias("feature_pos")).where("parts > 1")


def dissolve(layer: DataFrame, name: str) -> DataFrame:
    """(key, feature_pos, n_features, largest_area): each name's attributes are those of its largest feature (the first of equal ones). dissolved unites the geometries too."""
    shapes = layer.where(G.is_a(F.col("geometry"), G.POLYGONS)).select("feature_pos", name_key(F.col(name)).alias("key"), G.area(F.col("geometry")).alias("area"))
    return shapes.groupBy("key").agg(F.max_by("feature_pos", F.struct("area", -F.col("feature_pos"))).alias("feature_pos"), F.count(F.lit(1)).alias("n_features"), F.max("area").alias("largest_area"))


def dissolved(layer: DataFrame, name: str) -> DataFrame:
    """The layer with one feature for each name: the union of its polygons, the attributes of its largest one, and n_features. A blank name is a name; other geometry stays out."""
    polygons = layer.where(G.is_a(F.col("geometry"), G.POLYGONS)).withColumn("name_", name_key(F.col(name)))
    whole = united(polygons, "name_").withColumnRenamed("key", "name_")
    largest = F.max_by(F.struct(*[c for c in layer.columns if c != "geometry"]), F.struct(G.area(F.col("geometry")), -F.col("feature_pos")))
    chosen = polygons.groupBy("name_").agg(largest.alias("of_"), F.count(F.lit(1)).alias("n_features")).select("name_", "of_.*", "n_features")
    return chosen.join(whole.hint("merge"), "name_").select(*layer.columns, "n_features")
