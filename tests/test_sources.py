"""Codecs, readers, writers, profiles and archives."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cartosieve.functions import codecs
from cartosieve.functions import geometry as G
from cartosieve.operators.layers import LayerMeta
from cartosieve.plans import profiles
from cartosieve.sources import archives, files, readers


def test_well_known_text():
    assert codecs.parse_wkt("POINT (1 2)") == ("Point", [(0, 0, [(1.0, 2.0, None)])])
    assert codecs.parse_wkt("SRID=4326;LINESTRING Z (0 0 1, 1.5 -2e1 3)") == ("LineString", [(0, 0, [(0, 0, 1), (1.5, -20, 3)])])
    assert codecs.parse_wkt("MULTIPOINT ((1 1), (2 2))") == codecs.parse_wkt("MULTIPOINT (1 1, 2 2)")
    assert codecs.parse_wkt("POLYGON ((0 0, 1 0, 0 1, 0 0), (0 0, 1 0, 0 1, 0 0))")[1][1][:2] == (0, 1)
    assert [p[:2] for p in codecs.parse_wkt("MULTIPOLYGON (((0 0, 1 0, 0 1, 0 0)), ((0 0, 1 0, 0 1, 0 0), (0 0, 1 0, 0 1, 0 0)))")[1]] == [(0, 0), (1, 0), (1, 1)]
    assert codecs.parse_wkt("POLYGON EMPTY") == ("Polygon", [])
    assert codecs.parse_wkt("") is codecs.parse_wkt(None) is codecs.parse_wkt("nonsense (1)") is None


def test_well_known_bytes():
    assert codecs.parse_wkb(struct.pack("<BIdd", 1, 1, 1.0, 2.0)) == ("Point", [(0, 0, [(1.0, 2.0, None)])])
    assert codecs.parse_wkb(struct.pack(">BIIdddddd", 0, 1002, 2, 0, 0, 5, 1, 1, 6)) == ("LineString", [(0, 0, [(0, 0, 5), (1, 1, 6)])])
    square = struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 1, 0, 1, 1, 0, 0)
    assert codecs.parse_wkb(struct.pack("<BII", 1, 6, 2) + square * 2)[1][1][:2] == (1, 0)
    assert codecs.parse_wkb(None) is None


def test_geojson_document(spark, tmp_path):
    shapes = [{"type": "Point", "coordinates": [1, 2.5]}, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}, None, {"type": "LineString", "coordinates": []}]
    document = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": "b"}, "geometry": g} for g in shapes]}
    (tmp_path / "x.geojson").write_text(json.dumps(document))
    layer, meta = readers.load_layer(spark, str(tmp_path / "x.geojson"))
    got = [r[0] for r in layer.orderBy("feature_pos").select(codecs.geojson(F.col("geometry"))).collect()]
    assert [g and json.loads(g) for g in got] == shapes and meta.crs == "EPSG:4326"


def test_csv_layers(spark, tmp_path):
    (tmp_path / "w.csv").write_text('id,WKT,n\n7,"POINT (1 2)",x\n8,,y\n')
    layer, _ = readers.load_layer(spark, str(tmp_path / "w.csv"))
    assert {r["feature_id"]: r["w"] for r in layer.select("feature_id", G.wkt(F.col("geometry")).alias("w")).collect()} == {"7": "POINT (1 2)", "8": None}
    (tmp_path / "p.csv").write_text("name,lon,lat\na,1,2\nb,x,2\n")
    layer, _ = readers.load_layer(spark, str(tmp_path / "p.csv"))
    assert sorted((r["name"], r["geometry"] is None) for r in layer.collect()) == [("a", False), ("b", True)]
    (tmp_path / "e.csv").write_text("lon,lat\n")
    for bad in ("e.csv", "x.dxf", "x.abc"):
        with pytest.raises(ValueError):
            readers.load_layer(spark, str(tmp_path / bad))


def test_unsafe_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../up.txt", "x")
        z.writestr("zeros.txt", "0" * 1_000_000)
    assert len(readers.unsafe_members(str(tmp_path / "a.zip"))) == 2


def test_profile_run(spark):
    layer = spark.createDataFrame([(0, "0", None), (1, "1", ("Point", [(0, 0, [(1.0, 2.0, None)])]))], f"feature_pos long, feature_id string, geometry {G.GEOMETRY}")
    found, coverage = profiles.run_profile(layer, LayerMeta(crs="EPSG:4326", index_state="built"), "point_asset_quick")
    assert [r["problem_name"] for r in found.collect()] == ["null_geometry"]
    assert {r["check"] for r in coverage.where("status = 'skipped'").collect()} == {"self_intersection"}
    with pytest.raises(ValueError):
        profiles.run_profile(layer, LayerMeta(), "geometry", max_features=1)


def shapefile():
    """A square with a hole, and a null shape."""
    outer, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in outer + hole)
    null = struct.pack("<i", 0)
    shp = b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body + struct.pack(">2i", 2, len(null) // 2) + null
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, 2, 65, 6) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15 + b"\r" + b" ab   " + b"      "
    return shp, dbf


def test_shapefile(spark, tmp_path):
    shp, dbf = shapefile()
    (tmp_path / "s.shp").write_bytes(shp)
    (tmp_path / "s.dbf").write_bytes(dbf)
    layer, _ = readers.load_layer(spark, str(tmp_path / "s.shp"))
    got = layer.orderBy("feature_pos").select(G.area(F.col("geometry")).alias("area"), F.col("geometry").isNull().alias("none"), F.col("properties")["NAME"].alias("name")).collect()
    assert [tuple(r) for r in got] == [(15.0, False, "ab"), (None, True, None)] or [tuple(r) for r in got] == [(15.0, False, "ab"), (0.0, True, None)]


def test_geopackage_and_kml(spark, tmp_path):
    import sqlite3

    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("CREATE TABLE gpkg_contents (table_name, data_type)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name)")
    db.execute("CREATE TABLE wells (fid INTEGER, shape BLOB, depth REAL)")
    db.execute("INSERT INTO gpkg_contents VALUES ('wells', 'features')")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('wells', 'shape')")
    db.execute("INSERT INTO wells VALUES (1, ?, 2.5), (2, NULL, NULL)", (b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BIdd", 1, 1, 3.0, 4.0),))
    db.commit()
    db.close()
    layer, _ = readers.load_layer(spark, str(tmp_path / "g.gpkg"))
    assert [(r["w"], r["properties"]["depth"]) for r in layer.orderBy("feature_pos").select(G.wkt(F.col("geometry")).alias("w"), "properties").collect()] == [("POINT (3 4)", "2.5"), (None, None)]
    (tmp_path / "k.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>n</name><LineString><coordinates>0,0 1,1,5</coordinates></LineString></Placemark></Document></kml>')
    layer, meta = readers.load_layer(spark, str(tmp_path / "k.kml"))
    assert layer.first()["geometry"]["type"] == "LineString" and meta.crs == "EPSG:4326"


def test_geoparquet_round_trip_with_its_reference_system(spark, tmp_path):
    texts = ["POINT (1 2)", "LINESTRING (0 0, 1.5 2)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))", "MULTIPOLYGON (((0 0, 1 0, 0 1, 0 0)), ((5 5, 6 5, 5 6, 5 5)))", "MULTIPOINT ((1 1), (2 2))", None]
    rows = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "feature_pos long, feature_id string, w string")
    layer = rows.select("feature_pos", "feature_id", codecs.or_null(codecs.from_wkt("w")).alias("geometry"), F.lit("a").alias("kind")).repartition(3)
    for crs in ("EPSG:4326", "EPSG:3857", None):
        path = str(tmp_path / f"out{crs}.parquet".replace(":", ""))
        readers.write_layer(layer, path, "parquet", crs)
        back, meta = readers.load_layer(spark, path)
        assert meta.crs == crs
        got = {r["feature_id"]: r["w"] for r in back.select("feature_id", G.wkt(F.col("geometry")).alias("w")).collect()}
        assert got == {r["feature_id"]: r["w"] for r in layer.select("feature_id", G.wkt(F.col("geometry")).alias("w")).collect()}


def square_shp():
    ring = struct.pack("<i4d2ii8d", 5, 0, 0, 1, 1, 1, 4, 0, 0, 0, 0, 1, 1, 1, 0, 0)
    return b"\0" * 100 + struct.pack(">2i", 1, len(ring) // 2) + ring


def test_archives(spark, tmp_path):
    document = json.dumps({"features": [{"properties": {"a": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"properties": None, "geometry": None}]})
    kml = "<kml><Placemark><name>n</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark></kml>"
    for name, members in {"g.zip": {"d/x.geojson": document, "y.csv": "lon,lat\n5,6\n"}, "c.zip": {"y.csv": "id,lon,lat\n7,5,6\n8,x,6\n"}, "s.zip": {"a/b.shp": square_shp(), "r.json": document}, "k.kmz": {"doc.kml": kml, "x.csv": ""}, "n.zip": {"readme.txt": "x"}, "two.zip": {"a.shp": b"", "b.shp": b""}, "up.zip": {"../a.csv": "x"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, content in members.items():
                z.writestr(member, content)
    read = lambda name: [(r["feature_id"], r["w"], r["properties"]) for r in readers.load_layer(spark, str(tmp_path / name))[0].select("feature_id", G.wkt(F.col("geometry")).alias("w"), "properties").orderBy("feature_pos").collect()]
    assert read("g.zip") == [("0", "POINT (1 2)", {"a": "1"}), ("1", None, {})]
    assert read("c.zip") == [("0", "POINT (5 6)", {"id": "7", "lon": "5", "lat": "6"}), ("1", None, {"id": "8", "lon": "x", "lat": "6"})]
    assert read("s.zip")[0][1].startswith("POLYGON") and read("k.kmz")[0][1].startswith("MULTIPOINT")
    for bad in ("n.zip", "two.zip", "up.zip"):
        with pytest.raises(Exception, match="archive|safe"):
            read(bad)
    found = {tuple(r) for r in archives.discover(spark, str(tmp_path / "two.zip")).collect()}
    assert found == {("two.zip", "a", "a", "shp"), ("two.zip", "b", "b", "shp")}
    (tmp_path / "dir" / "sub").mkdir(parents=True)
    (tmp_path / "dir" / "sub" / "p.shp").write_bytes(square_shp())
    (tmp_path / "dir" / "q.geojson").write_text(document)
    assert {tuple(r) for r in archives.discover(spark, str(tmp_path / "dir")).collect()} == {("dir", "sub/p", "p", "shp"), ("dir", "q.geojson", "q", "geojson")}
    assert archives.default_layer(["a", "Points", "lines"]) == "lines" and archives.default_layer([]) is None
    assert archives.resolve_bundle(["a.shp", "a.dbf", "a.shx"]) == "a.shp"
    for bad in ([], ["a.shp"], ["a.shp", "a.dbf"], ["a.dbf", "a.shx"]):
        with pytest.raises(ValueError):
            archives.resolve_bundle(bad)


def test_reference_system_beside_a_shapefile(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(square_shp())
    assert readers.load_layer(spark, str(tmp_path / "a.shp"))[1].crs is None
    (tmp_path / "a.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')
    assert readers.load_layer(spark, str(tmp_path / "a.shp"))[1].crs == "EPSG:4326"
    assert files.prj_crs('PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["x"]]') == "EPSG:32633" and files.prj_crs('PROJCS["x",AUTHORITY["EPSG","27700"]]') == "EPSG:27700"
    assert files.prj_crs("") is None


def test_las_is_read_in_ranges_of_records(spark, tmp_path):
    """A file of point format 3 with longer records, made here byte by byte, in partitions of seven records; columns as wanted; what is no LAS file is an error."""
    import struct

    from cartosieve.sources import las

    n, size = 40, 36
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HIIBHI", head, 94, 227, 300, 0, 3, size, n)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.5, 100.0, 200.0, -5.0)
    body = b"".join(struct.pack("<3iHBB", i, -i, 2 * i, i * 3, (i % 8) | (i % 5) << 3, i % 32 | 0xE0).ljust(size, b"\0") for i in range(n))
    (tmp_path / "a.las").write_bytes(bytes(head) + b"\0" * 73 + body)
    layer, meta = readers.load_layer(spark, str(tmp_path / "a.las"), rows=7)
    assert layer.rdd.getNumPartitions() == 6 and meta.name == "a.las"
    rows = layer.orderBy("feature_pos").collect()
    for i, r in enumerate(rows):
        c = r["geometry"]["parts"][0]["coords"][0]
        assert (round(c["x"], 6), round(c["y"], 6), c["z"]) == (round(100 + i * 0.01, 6), round(200 - i * 0.01, 6), i - 5)
        assert (r["intensity"], r["return_number"], r["number_of_returns"], r["classification"]) == (i * 3, i % 8, i % 5, i % 32)
    assert len(rows) == n
    assert las.read_las(spark, str(tmp_path), ("classification",))[0].columns == ["feature_pos", "feature_id", "geometry", "classification"]
    las.write_las(layer.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for bad in (b"no", bytes(head[:104]) + b"\x83" + bytes(head[105:])):
        with pytest.raises(ValueError):
            las.parse_header(bad, "b.las")
