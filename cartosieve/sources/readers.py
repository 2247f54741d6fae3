"""Layers from files: GeoJSON, CSV with well-known text or coordinates, GeoParquet; and back."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import codecs
from cartosieve.functions import geometry as G
from cartosieve.operators import layers
from cartosieve.operators.layers import LayerMeta
from cartosieve.sources import archives, files, las

#: Names of columns that hold coordinates or well-known text, first match wins.
X_NAMES = ["longitude", "lon", "x", "lng", "intptlong", "intptlong_num", "centroid_lon", "long"]
Y_NAMES = ["latitude", "lat", "y", "intptlat", "intptlat_num", "centroid_lat"]
WKT_NAMES = ["geometry", "geom", "wkt"]
UNREADABLE = {".gdb", ".dxf", ".pbf", ".laz"}


def _first(columns: list[str], names: list[str]) -> str | None:
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[n] for n in names if n in lower), None)


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, LayerMeta]:
    """A feature collection; the properties are one MAP column. Whole documents are parsed one to a task."""
    text = spark.read.text(path, wholetext=True)
    crs = text.select(F.get_json_object("value", "$.crs.properties.name")).first()[0]
    schema = "struct<features:array<struct<id:string,geometry:string,properties:map<string,string>>>>"
    rows = text.select(F.posexplode(F.from_json("value", schema)["features"]).alias("feature_pos", "f"))
    layer = rows.select(F.col("feature_pos").cast("long"), F.coalesce("f.id", F.col("feature_pos").cast("string")).alias("feature_id"), codecs.from_geojson(F.col("f.geometry")).alias("geometry"), "f.properties")
    return layer, LayerMeta(os.path.basename(path), path, crs or "EPSG:4326")


def read_csv(spark: SparkSession, path: str, x_field: str | None = None, y_field: str | None = None, crs: str = "EPSG:4326") -> tuple[DataFrame, LayerMeta]:
    """Attributes stay text. Blank or unreadable shapes are null; a file without rows is an error."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    wkt = _first(rows.columns, WKT_NAMES)
    if wkt and not (x_field or y_field):
        shaped = rows.withColumn("geometry_", codecs.or_null(codecs.from_wkt(F.col(wkt)))).drop(wkt)
    else:
        x, y = x_field or _first(rows.columns, X_NAMES), y_field or _first(rows.columns, Y_NAMES)
        if not x or not y:
            raise ValueError(f"{path} has no columns of coordinates or well-known text")
        px, py = F.col(x).try_cast("double"), F.col(y).try_cast("double")
        shaped = rows.withColumn("geometry_", F.when(px.isNotNull() & py.isNotNull(), G.point(px, py)))
    return _numbered(shaped.withColumnRenamed("geometry_", "geometry")), LayerMeta(os.path.basename(path), path, crs)


def geoparquet_crs(spark: SparkSession, path: str, column: str) -> str | None:
    """The reference system that the footer of one of the table's files names; without one it is longitude and latitude."""

    def footer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for content in batch["content"]:
                own = json.loads((pq.read_metadata(io.BytesIO(content)).metadata or {}).get(b"geo", b"{}")).get("columns", {}).get(column, {})
                code = (own.get("crs") or {}).get("id", {})
                yield pd.DataFrame({"crs": [None if "crs" in own and own["crs"] is None else f"{code['authority']}:{code['code']}" if "code" in code else "EPSG:4326"]}, dtype=object)

    one = sorted(spark.read.parquet(path).inputFiles())[:1]
    return spark.read.format("binaryFile").load(one).select("content").mapInPandas(footer, "crs string").first()["crs"] if one else "EPSG:4326"


def read_geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> tuple[DataFrame, LayerMeta]:
    rows = spark.read.parquet(path)
    shaped = rows.withColumn("geometry_", codecs.or_null(codecs.from_wkb(F.col(column)))).drop(column).withColumnRenamed("geometry_", "geometry")
    return _numbered(shaped), LayerMeta(os.path.basename(path), path, geoparquet_crs(spark, path, column))


def write_geoparquet(layer: DataFrame, path: str, crs: str | None = "EPSG:4326") -> None:
    """Well-known bytes and a footer that says so, a file for each partition; a task that runs again writes the same name again."""
    attributes = [c for c in layer.columns if c not in ("feature_pos", "geometry")]
    rows = layer.select(*attributes, codecs.to_wkb("geometry").alias("geometry"))
    code = layers.epsg_code(crs)
    own = {"encoding": "WKB", "geometry_types": []} | ({"crs": None} if crs is None else {} if code == 4326 else {"crs": {"id": {"authority": "EPSG", "code": code}}})
    geo = json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": own}}).encode()
    where = path if "://" in path else f"file://{os.path.abspath(path)}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        fs, folder = FileSystem.from_uri(where)
        task, out, n = TaskContext.get(), None, 0
        name, draft = f"{folder}/part-{task.partitionId():06d}.parquet", f"{folder}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = pq.ParquetWriter(draft, batch.schema.with_metadata({b"geo": geo}), filesystem=fs)
            out.write_batch(batch)
            n += batch.num_rows
        if out is not None:
            out.close()
            fs.move(draft, name)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()  # runs the tasks; one row


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions follow the order in which the source's partitions are read; the identifier is the first usual one."""
    id_field = next((c for c in ("feature_id", "ID", "id", "fid", "FID", "objectid", "OBJECTID", "source_id") if c in rows.columns), None)
    placed = rows.withColumn("feature_pos", F.monotonically_increasing_id())
    return placed.withColumn("feature_id", F.col(id_field).cast("string") if id_field else F.col("feature_pos").cast("string"))


def load_layer(spark: SparkSession, path: str, **options: str) -> tuple[DataFrame, LayerMeta]:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".geojson", ".json"):
        return read_geojson(spark, path)
    if suffix == ".csv":
        return read_csv(spark, path, **options)
    if suffix in (".parquet", ".geoparquet"):
        return read_geoparquet(spark, path, **options)
    if suffix in (".shp", ".gpkg", ".kml"):
        return files.read_files(spark, path, **options)
    if suffix == ".las":
        return las.read_las(spark, path, **options)
    if suffix in (".zip", ".kmz"):
        return archives.read_archives(spark, path, x_names=tuple(X_NAMES), y_names=tuple(Y_NAMES), wkt_names=tuple(WKT_NAMES), **options)
    raise ValueError(f"no reader for {suffix or path}" + (": convert it to GeoJSON, CSV or GeoParquet" if suffix in UNREADABLE else ""))


def unsafe_members(path: str) -> list[str]:
    """Why an archive should not be unpacked; empty if it may be."""
    with zipfile.ZipFile(path) as z:
        return archives.unsafe(z)


def write_layer(layer: DataFrame, path: str, form: str, crs: str | None = "EPSG:4326") -> None:
    """geojson: a feature a line; csv: the identifier as source_id and well-known text; parquet: well-known bytes with a footer that names the reference system."""
    attributes = [c for c in layer.columns if c not in ("feature_pos", "feature_id", "geometry")]
    if form == "geojson":
        properties = F.to_json(F.struct(*attributes)) if attributes else F.lit("{}")
        line = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array(F.col("feature_id").cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("feature_id").cast("string")))) - 2), F.lit(',"geometry":'), F.coalesce(codecs.geojson(F.col("geometry")), F.lit("null")), F.lit(',"properties":'), properties, F.lit("}"))
        layer.select(line.alias("value")).write.text(path)
    elif form == "csv":
        layer.select(F.col("feature_id").cast("string").alias("source_id"), *[F.col(c).cast("string").alias(c) for c in attributes], G.wkt(F.col("geometry")).alias("geometry")).write.csv(path, header=True)
    elif form == "parquet":
        write_geoparquet(layer, path, crs)
    else:
        raise ValueError(f"no writer for {form}")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_layer's geojson form wrote; splits like any text."""
    rows = spark.read.text(path).select(F.from_json("value", "struct<id:string,geometry:string,properties:map<string,string>>").alias("f"))
    return rows.select(F.col("f.id").alias("feature_id"), codecs.from_geojson(F.col("f.geometry")).alias("geometry"), "f.properties")

