"""Operators on small layers with known findings."""

import math
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartosieve.functions import arrangement, planar
from cartosieve.functions import geometry as G
from cartosieve.operators import districts, features, layers, lookups, network, repairs, rows, topology
from cartosieve.plans import issues

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]


def layer(spark, shapes, **attributes):
    """shapes: (type, [rings]) or None."""
    data = []
    for i, shape in enumerate(shapes):
        g = None if shape is None else (shape[0], [(0, ring, [(float(x), float(y), None) for x, y in c]) for ring, c in enumerate(shape[1])])
        data.append((i, str(i), g, *[values[i] for values in attributes.values()]))
    extra = "".join(f", {name} {'string' if any(isinstance(v, str) for v in values) else 'double'}" for name, values in attributes.items())
    return spark.createDataFrame(data, f"feature_pos long, feature_id string, geometry {G.GEOMETRY}{extra}")


def line(*points):
    return ("LineString", [list(points)])


def box(x0, y0, x1, y1):
    return ("Polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])


def ids(df):
    return sorted(r["feature_id"] for r in df.select("feature_id").collect())


def test_geometry_rules(spark):
    data = layer(spark, [None, line((0, 0), (0, 0), (1, 0)), line((0, 0), (5, 0), (0, 0.1)), line((0, 0), (2, 2), (2, 0), (0, 2)), ("LineString", [])])
    assert ids(rows.null_geometry(data)) == ["0"]
    assert ids(rows.duplicate_vertex(data)) == ["1"]
    assert ids(rows.below_minimum_length(data, 2)) == ["1", "4"]
    assert ids(rows.sharp_angle(data, None)) == ["2"]
    assert ids(topology.self_intersection(data)) == ["3"]
    assert rows.total_vertices(data).first()["n_vertices"] == 10


def test_attribute_rules(spark):
    data = layer(spark, [None] * 4, name=["a", "a", None, "b"], size=[1.0, -2.0, float("nan"), None])
    assert ids(rows.required_nulls(data, ["size"])) == ["2", "3"]
    assert len(ids(rows.required_nulls(data, ["absent", "name"]))) == 5
    assert ids(rows.uniqueness(data, "name")) == ["0", "1"]
    assert ids(rows.domain(data, "name", {"a"})) == ["3"]
    assert ids(rows.domain(data, "size", rows.positive_number)) == ["1"]
    with pytest.raises(ValueError):
        rows.uniqueness(data, "absent")


def test_empty_layer(spark):
    data = layer(spark, [])
    for check in (rows.null_geometry, rows.duplicate_vertex, topology.overlaps, topology.line_intersections, topology.duplicate_geometry, network.line_dangle, network.isolated_segment):
        assert check(data).count() == 0
    assert issues.summary(issues.finished(rows.null_geometry(data))).count() == 0


def test_text_of_geometry(spark):
    data = layer(spark, [("Point", [[(1, 2.5)]]), line((0, 0), (2, 2)), ("Polygon", [SQUARE, [(1, 1), (2, 1), (2, 2), (1, 1)]]), ("LineString", [])])
    got = [r[0] for r in data.orderBy("feature_pos").select(G.wkt(F.col("geometry"))).collect()]
    assert got == ["POINT (1 2.5)", "LINESTRING (0 0, 2 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "LINESTRING EMPTY"]
    areas = [r[0] for r in data.orderBy("feature_pos").select(G.area(F.col("geometry"))).collect()]
    assert areas == [0, 0, 15.5, 0]


def test_decimals(spark):
    data = spark.createDataFrame([(1.0, 0), (0.25, 2), (1e-7, 7), (1.5e-7, 8), (123456.789, 3), (2e20, 0)], "x double, n int")
    assert [r[0] for r in data.select(G.decimals(F.col("x"))).collect()] == [r["n"] for r in data.collect()]


def test_polygon_pairs(spark):
    data = layer(spark, [box(0, 0, 4, 4), box(2, 2, 6, 6), box(1, 1, 2, 2), box(4, 0, 8, 2), box(20, 20, 21, 21), box(20, 20, 21, 21)])
    assert ids(topology.overlaps(data)) == ["0", "1", "3"] or ids(topology.overlaps(data)) == ["0", "1"]
    assert ids(topology.within(data)) == ["2", "4", "5"]
    assert ids(topology.duplicate_geometry(data)) == ["4", "5"]


def test_grid_finds_what_all_pairs_find(spark):
    import random

    rng = random.Random(5)
    boxes = [(x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.choice([1, 2, 30]), y + rng.choice([1, 3])) for _ in range(60)]
    data = layer(spark, [box(*b) for b in boxes])
    got = {(r["a"], r["b"]) for r in topology.polygon_pairs(data).where("shared > 0").collect()}
    want = {(i, j) for i, p in enumerate(boxes) for j, q in enumerate(boxes) if i < j and min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1])}
    assert got == want


def related(a, b):
    relation, shared = arrangement.relate(shape("Polygon", a), shape("Polygon", b))
    return arrangement.RELATIONS[relation[0]], round(float(shared[0]), 9)


def shape(kind, rings):
    """One geometry as the kernels take it; rings of a multi-part kind are parts of their own."""
    return planar.shapes([kind], [[(i if kind.startswith("Multi") else 0, 0 if kind.startswith("Multi") else i, np.array(r, float)) for i, r in enumerate(rings)]])


def lines_cross(a, b):
    return bool(arrangement.insides_meet(shape("MultiLineString", a), shape("MultiLineString", b))[0])


def crosses_itself(lines, kind="MultiLineString"):
    return bool(arrangement.meets_itself(shape(kind, lines))[0])


def gon(n, radius, x, y, turn):
    return [(x + radius * math.cos(turn + 2 * math.pi * i / n), y + radius * math.sin(turn + 2 * math.pi * i / n)) for i in [*range(n), 0]]


def test_relations_of_turned_shapes():
    """Nested, equal but begun elsewhere, side by side: on coordinates that no float holds exactly."""
    rng = np.random.default_rng(3)
    for _ in range(100):
        turn, other = rng.uniform(0, 6, 2)
        big, small = gon(9, 3, 5, 5, turn), gon(7, 1, 5, 5, other)
        assert related([small], [big])[0] == "a_within_b" and related([big], [small])[0] == "b_within_a"
        assert related([big], [(big[:-1] * 2)[4:14]])[0] == "equal" and related([big], [big[::-1]])[0] == "equal"
        assert related([big, gon(9, 1.5, 5, 5, turn)], [small])[0] == "apart"
        assert related([big], [gon(9, 3, 7, 5, turn)])[0] == "partial"
        ways = [[(x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)) for x, y in shape] for shape in ([(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)], [(2, 0.2), (3, 0.2), (3, 0.7), (2, 0.7), (2, 0.2)])]
        assert related([ways[0]], [ways[1]])[0] == "apart"


def test_shared_area_of_triangles_by_sampling():
    rng = np.random.default_rng(8)
    for _ in range(20):
        a, b = (rng.uniform(0, 1, (3, 2)) for _ in range(2))
        points = rng.uniform(0, 1, (40_000, 2))
        side = lambda t, p: np.stack([(t[i - 2, 0] - t[i - 3, 0]) * (p[:, 1] - t[i - 3, 1]) - (t[i - 2, 1] - t[i - 3, 1]) * (p[:, 0] - t[i - 3, 0]) for i in range(3)])
        inside = lambda t: (side(t, points) > 0).all(axis=0) | (side(t, points) < 0).all(axis=0)
        assert abs(related([a], [b])[1] - (inside(a) & inside(b)).mean()) < 0.02


def test_large_shape_among_small_ones(spark):
    boxes = [(i % 30, i // 30, i % 30 + 0.9, i // 30 + 0.9) for i in range(300)] + [(-5, -5, 500, 500), (3, 3, 40, 40)]
    data = layer(spark, [box(*b) for b in boxes])
    got = {(r["a"], r["b"], r["relation"]) for r in topology.polygon_pairs(data).where("relation <> 'apart'").collect()}
    want = {(i, 300, "a_within_b") for i in range(300)} | {(300, 301, "b_within_a")}
    want |= {(i, 301, "a_within_b") for i, b in enumerate(boxes[:300]) if b[0] >= 3 and b[1] >= 3}
    assert got == want


def test_kernels():
    tilted = [(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0), (2.0, 0.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
    assert related([SQUARE], [tilted]) == ("b_within_a", 8)
    assert related([SQUARE, hole], [tilted]) == ("partial", 4)
    assert related([hole], [SQUARE, hole]) == ("apart", 0)
    assert related([SQUARE, hole], [SQUARE[::-1]]) == ("a_within_b", 12)
    assert related([], [SQUARE]) == ("apart", 0)
    assert lines_cross([[(0, 0), (2, 2)]], [[(0, 2), (2, 0)]])
    assert not lines_cross([[(0, 0), (2, 2)]], [[(2, 2), (3, 0)]])
    assert not lines_cross([[(0, 0), (2, 0)]], [[(1, 0), (1, 5)]])
    assert lines_cross([[(0, 0), (2, 0)]], [[(1, 0), (5, 0)]])
    assert crosses_itself([[(0, 0), (1, 1), (1, 0), (0, 1)]])
    assert not crosses_itself([SQUARE], "Polygon")


def test_long_lines_against_all_segment_pairs():
    """Crossings and self-contact of random walks, by trying every pair of segments."""
    rng = np.random.default_rng(21)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def proper(s, t):
        return cross(*t, s[0]) * cross(*t, s[1]) < 0 and cross(*s, t[0]) * cross(*s, t[1]) < 0

    seen = set()
    for n in (3, 10, 60, 300):
        for _ in range(15):
            drift = rng.choice([0.3, 3.0, 30.0])
            a, b = (np.cumsum(rng.normal(0, 1, (n, 2)) + (drift / 3, 0), axis=0) + rng.normal(0, 20, 2) for _ in range(2))
            sa, sb = (list(zip(p[:-1].tolist(), p[1:].tolist(), strict=True)) for p in (a, b))
            itself = any(proper(sa[i], sa[j]) for i in range(len(sa)) for j in range(i + 2, len(sa)))
            assert crosses_itself([a]) == itself
            both = any(proper(s, t) for s in sa for t in sb)
            assert lines_cross([a], [b]) == both
            seen.add((itself, both))
    assert len(seen) >= 3


def jts(spark):
    return spark._jvm.org.locationtech.jts.io.WKTReader()


def text(kind, parts):
    """Well-known text of points, of lines, or of polygons, each a list of rings."""
    ring = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r) + ")"
    if kind == "MultiPoint":
        return "MULTIPOINT (" + ", ".join(f"({x} {y})" for (x, y), *_ in parts) + ")"
    if kind == "MultiLineString":
        return "MULTILINESTRING (" + ", ".join(map(ring, parts)) + ")"
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(ring, p)) + ")" for p in parts) + ")"


def arrow(kind, parts):
    flat = [(i, 0, np.array(p, float)) for i, p in enumerate(parts)] if kind != "MultiPolygon" else [(i, k, np.array(r, float)) for i, p in enumerate(parts) for k, r in enumerate(p)]
    return planar.shapes([kind], [flat])


def random_shape(rng, kind, n=6):
    """On a small grid, so that shapes touch, share edges and pass through corners."""
    point = lambda: tuple(int(v) for v in rng.integers(0, n, 2))
    if kind == "MultiPoint":
        return [[point()] for _ in range(rng.integers(1, 4))]
    if kind == "MultiLineString":
        parts = []
        for _ in range(rng.integers(1, 4)):
            line = [point() for _ in range(rng.integers(2, 5))]
            if len(set(line)) > 1:
                parts.append(line + ([line[0]] if rng.random() < 0.2 else []))
        return parts or [[(0, 0), (1, 1)]]
    parts = []
    for _ in range(rng.integers(1, 3)):
        if rng.random() < 0.5:
            x, y = point()
            w, h = (int(v) for v in rng.integers(1, 5, 2))
            outer = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        else:
            outer = [point() for _ in range(rng.integers(3, 5))]
            outer.append(outer[0])
        rings = [outer]
        if rng.random() < 0.4:
            a, b = point()
            rings.append([(a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1), (a, b)])
        parts.append(rings)
    return parts


def test_relations_of_all_kinds_against_another_library(spark):
    """Every pair of kinds, several parts, holes, shared borders and corners: which insides meet and which shape is within the other."""
    reader, rng, seen = jts(spark), np.random.default_rng(17), set()
    for _ in range(1500):
        kinds = [["MultiPoint", "MultiLineString", "MultiPolygon"][k] for k in rng.integers(0, 3, 2)]
        parts = [random_shape(rng, k) for k in kinds]
        a, b = (reader.read(text(k, p)) for k, p in zip(kinds, parts, strict=True))
        if not (a.isValid() and b.isValid() and a.isSimple() and b.isSimple()):
            continue
        relation, shared = arrangement.relate(arrow(kinds[0], parts[0]), arrow(kinds[1], parts[1]))
        matrix = spark._jvm.org.locationtech.jts.operation.relateng.RelateNG.relate(a, b)
        inner, outer, meet = matrix.isWithin(), matrix.isContains(), matrix.toString()[0] != "F"
        want = "equal" if inner and outer else "a_within_b" if inner else "b_within_a" if outer else "partial" if meet else "apart"
        assert arrangement.RELATIONS[relation[0]] == want, (a.toText(), b.toText())
        assert bool(arrangement.insides_meet(arrow(kinds[0], parts[0]), arrow(kinds[1], parts[1]))[0]) == meet
        if kinds[0] == kinds[1] == "MultiPolygon":
            assert abs(shared[0] - a.intersection(b).getArea()) < 1e-9
            polygons = planar.intersections(*(arrangement.oriented(arrow(k, p)) for k, p in zip(kinds, parts, strict=True)), 1)[0]
            ring_area = lambda r: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r.tolist(), r.tolist()[1:], strict=False))) / 2
            assert abs(sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in polygons) - shared[0]) < 1e-9
        seen.add((kinds[0], kinds[1], want))
    assert len(seen) > 20


def test_self_contact_against_another_library(spark):
    """Lines that are not simple, polygons that are not valid because of a self-intersection, all parts and rings seen together."""
    reader, rng, seen = jts(spark), np.random.default_rng(18), set()
    valid = spark._jvm.org.locationtech.jts.operation.valid.IsValidOp
    for _ in range(1500):
        kind = ["MultiLineString", "MultiPolygon"][int(rng.integers(0, 2))]
        parts = random_shape(rng, kind)
        a = reader.read(text(kind, parts))
        if kind == "MultiLineString":
            if any(p == q for line in parts for p, q in zip(line, line[1:], strict=False)):
                continue
            want = not a.isSimple()
        else:
            error = valid(a).getValidationError()
            reason = error.getMessage() if error is not None else ""
            if error is not None and "elf-intersection" not in reason:
                continue  # invalid for another reason: either may be found first
            want = error is not None
        assert bool(arrangement.meets_itself(arrow(kind, parts))[0]) == want, (a.toText(), want)
        seen.add((kind, want))
    assert len(seen) == 4


def test_outlines_of_many_vertices():
    """Time and memory go with the vertices: two circles of 20,000 corners."""
    circle = lambda x: shape("Polygon", [gon(20_000, 1.0, x, 0.0, 0.0)])
    start = time.time()
    tracemalloc.start()
    relation, shared = arrangement.relate(circle(0.0), circle(0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert arrangement.RELATIONS[relation[0]] == "partial" and abs(shared[0] - (2 * math.acos(0.25) - 0.25 * math.sqrt(4 - 0.25))) < 1e-6
    assert time.time() - start < 5 and peak < 100e6
    assert not arrangement.meets_itself(circle(0.0))[0]


def test_network(spark):
    data = layer(spark, [line((0, 0), (1, 0)), line((1, 0), (2, 0)), line((2.05, 0), (3, 0)), line((9, 9), (9, 9.5)), line((5, 5), (6, 5), (6, 6), (5, 5))], role=["x", "x", " Hydrant ", "x", "x"])
    assert ids(network.line_dangle(data)) == ["0", "1", "2", "3"]
    assert ids(network.line_dangle(data, "role", ("hydrant",))) == ["0", "1", "3"]
    assert ids(network.isolated_segment(data)) == ["2", "3"]
    near = [(r["feature_pos"], r["related_pos"], round(r["distance"], 6)) for r in network.near_miss(data, 0.1).collect()]
    assert near == [(1, 2, 0.05)]
    assert network.network_summary(data).first().asDict() == {"segments": 5, "multipart": 0, "junctions": 0, "terminals": 6}


def test_first_centres_match_a_scan_in_order(spark):
    import random

    rng = random.Random(11)
    edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)})
    flagged, want = set(), set()
    for a in range(25):
        if a not in flagged:
            for x, b in edges:
                if x == a and b not in flagged:
                    want.add((b, a))
                    flagged.add(b)
    want = {(b, min(a for c, a in want if c == b)) for b, _ in want}
    got = {(r["b"], r["a"]) for r in network.first_centres(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_districts(spark):
    data = layer(spark, [box(0, 0, 4, 4), box(0, 0, 4, 4), box(1, 1, 2, 2), box(3, 3, 6, 6), box(50, 50, 51, 51)], name=["North-A", "north a", "South", "south ", None])
    assert [tuple(r) for r in districts.same_name(data, "name").collect()] == [(0, 1, "equal")]
    assert sorted(tuple(r) for r in districts.cross_name_nested(data, "name").collect()) == [(0, 2, "nested"), (1, 2, "nested")]
    assert sorted(tuple(r) for r in districts.cross_name_overlap(data, "name").collect()) == [(0, 3, 1.0), (1, 3, 1.0)]
    assert sorted((r["key"], r["parts"]) for r in districts.multipart(data, "name").collect()) == [("north a", 2), ("south", 2)]


def test_repairs(spark):
    data = layer(spark, [None, line((0, 0), (0, 0), (1, 0)), line((0, 0), (0, 0)), box(0, 0, 1, 1)])
    fixed = repairs.apply_repairs(data)
    assert [len(r["geometry"]["parts"][0]["coords"]) for r in fixed.orderBy("feature_pos").collect()] == [2, 2, 5]
    assert sorted(tuple(r) for r in repairs.changes(data, fixed).collect()) == [(0, "removed"), (1, "changed")]


def test_issue_values(spark):
    raw = rows.null_geometry(layer(spark, [None])).withColumn("feature_id", F.lit('a"b'))
    got = issues.finished(raw).first()
    import hashlib
    import json

    want = json.dumps({"problem_name": "null_geometry", "feature_id": 'a"b', "geometry": None, "description": "Feature has no geometry."}, sort_keys=True)
    assert got["issue_id"] == hashlib.sha1(want.encode()).hexdigest()[:16]
    assert (got["severity"], got["priority_score"], got["iso_category"]) == ("critical", 100, "Completeness")


def test_priority_rounds_halves_to_even(spark):
    score = issues.priority_score(F.lit("medium"), F.lit("high"), F.lit(False), F.lit("data_issue"))
    assert spark.range(1).select(score).first()[0] == round(50 * 0.45)


def test_reference_system_codes(spark):
    assert [layers.epsg_code(c) for c in ("EPSG:4326", "urn:ogc:def:crs:EPSG::3857", "OGC:CRS84", 'GEOGCS["x",AUTHORITY["EPSG","4269"]]', "local", None)] == [4326, 3857, 4326, 4269, None, None]
    meta = layers.LayerMeta(crs="EPSG:3857", attrs={"spatial_index_status": "stale", "xy_tolerance": 0.5}, index_state="built")
    assert layers.missing_crs(spark, meta).count() == 0
    assert layers.invalid_crs(spark, meta, "EPSG:4326").count() == 1
    assert layers.invalid_crs(spark, meta, "3857").count() == 0
    assert layers.spatial_index(spark, meta).count() == layers.outdated_index(spark, meta).count() == layers.xy_tolerance(spark, meta, 0.1).count() == 1
    assert [r[0] for r in layers.metadata_gaps(spark, {"title": "t", "abstract": " "}).collect()] == ["missing_metadata_abstract", "missing_metadata_extent", "missing_metadata_lineage"]


def test_features(spark):
    data = layer(spark, [None, line((0, 0), (0, 0), (1, 0))])
    found = issues.finished(rows.null_geometry(data)).unionByName(issues.finished(rows.duplicate_vertex(data)))
    marked = {r["feature_id"]: r for r in features.annotated(data, found).collect()}
    assert marked["0"]["qa_quality_score"] == 0.1 and marked["1"]["qa_quality_score"] == 0.6
    assert features.annotated(data, found.where("false")).where("qa_quality_score = 1 and not qa_has_issue").count() == 2


def test_layer_wide_gaps(spark):
    """A frame of four boxes turned by some angle, two holes that touch in a point, a box with a hole of its own, and one hole filled in."""

    def turned(ring, by):
        return [(x * math.cos(by) - y * math.sin(by), x * math.sin(by) + y * math.cos(by)) for x, y in ring]

    def ring(x0, y0, x1, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]

    shapes = [[ring(0, 0, 4, 1)], [ring(0, 1, 1, 3)], [ring(3, 1, 4, 3)], [ring(0, 3, 4, 4)], [ring(10, 0, 20, 10), ring(11, 11 - 10, 13, 3), ring(13, 3, 15, 5)], [ring(30, 0, 40, 10), ring(32, 2, 34, 4)], [ring(31.5, 1.5, 34.5, 4.5)]]
    for by in (0.0, 0.7, 2.1):
        rows = [(i, i, ("Polygon", [(0, k, [(float(x), float(y), None) for x, y in turned(r, by)]) for k, r in enumerate(shape)])) for i, shape in enumerate(shapes)]
        data = spark.createDataFrame(rows, f"feature_pos long, feature_id long, geometry {G.GEOMETRY}")
        got = topology.gaps(data).collect()
        assert sorted(round(r["area"], 6) for r in got) == [4, 4, 4]
        assert all(r["outline"].startswith("POLYGON ((") and r["outline"].count(",") >= 4 for r in got)
        assert topology.gaps(data, 4.5).count() == 0
    assert topology.gaps(data.where("false")).count() == 0


def test_long_chains_settle(spark):
    """A scan in order along 3000 lines, each near the next, and its end near the first of another chain."""
    edges = [(i, i + 1) for i in range(3000)] + [(5000 + i, 5001 + i) for i in range(500)] + [(100, 5000), (9000, 9001), (9000, 9002)]
    flagged, want = set(), set()
    by = {}
    for a, b in sorted(edges):
        by.setdefault(a, []).append(b)
    for a in sorted({v for e in edges for v in e}):
        if a not in flagged:
            for b in by.get(a, []):
                flagged.add(b)
                want.add((b, a))
    got = {(r["b"], r["a"]) for r in network.first_centres(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {b for b, _ in got} == flagged and got <= want


def test_near_misses_in_metres(spark):
    """Twenty metres are 0.00018 degrees of latitude, and more of longitude further north."""
    data = layer(spark, [line((10, 60), (10.01, 60)), line((10.0103, 60), (10.02, 60)), line((10.03, 60), (10.04, 60)), line((10.04, 60.00015), (10.05, 60.1)), line((10, 0), (10.01, 0)), line((10.0103, 0), (10.02, 0))])
    got = [(r["feature_pos"], r["related_pos"]) for r in network.near_miss(data, 20.0, geographic=True).collect()]
    assert sorted(got) == [(0, 1), (2, 3)]
    issues_ = network.pair_issues(data, network.near_miss_pairs(data, 20.0, geographic=True), "suspicious_near_miss_endpoints", "Near.").collect()
    assert sorted(r["feature_pos"] for r in issues_) == [0, 2] and all(r["geometry"].startswith("LINESTRING") for r in issues_)


def test_many_ends_in_one_place(spark):
    spokes = [line((0, 0), (math.cos(i), math.sin(i))) for i in range(300)]
    data = layer(spark, [*spokes, line((0.01, 0), (5, 5))])
    assert network.place_pairs(network.ends(data).select("x", "y").distinct(), 0.02, False).where("xa = 0 and ya = 0").count() == 1
    assert {r["related_pos"] for r in network.near_miss(data, 0.02).collect()} >= {300}


def test_profiles_exist_and_go_on_after_a_failure(spark):
    from cartosieve.plans import profiles as P

    assert len(P.PROFILES) == 18
    assert all(c in P.CHECKS for p in P.PROFILES.values() for c in p.checks)
    types = spark.createDataFrame([(t, n) for t in ("Point", "LineString", "Polygon", "None") for n in ("water mains", "land parcels", "x")], "t string, n string")
    assert all(r[0] in P.PROFILES for r in types.select(layers.profile_for(F.col("t"), F.col("n"))).collect())
    assert P.water_schema(["pipe_id", "matl", "status", "x"]).strength == "moderate" and P.water_schema(["asset_id", "diameter", "material", "status"]).missing == ["role"]
    data = layer(spark, [line((0, 0), (1, 0)), line((0, 0), (1, 1), (1, 0), (0, 1))])
    found, coverage = P.run_profile(data, layers.LayerMeta("l", crs="EPSG:3857"), "generic_quick", {"missing_crs": {"no": 1}})
    status = {r["check"]: r["status"] for r in coverage.collect()}
    assert status["missing_crs"] == "failed" and status["self_intersection"] == "completed"
    assert {r["problem_name"] for r in found.collect()} == {"validation_runtime_error", "self_intersection", "missing_or_stale_spatial_index"}
    broken = F.udf(lambda g: 1 // 0, "int")
    P.register_check("breaks_as_it_runs", P.Check("geometry", 1, (), lambda layer, meta: layer.where(broken("geometry") == 1).select(F.lit("p").alias("problem_name"), "feature_pos", "feature_id", F.lit(None).cast("string").alias("geometry"), F.lit("").alias("description"))))
    P.register_check("unknown_column", P.Check("geometry", 1, (), lambda layer, meta: None, lambda: (F.col("no_such") == 1, "p", "t")))
    try:
        own = P.Profile("own", ("null_geometry", "breaks_as_it_runs", "unknown_column", "below_minimum_feature_length", "self_intersection"))
        found, coverage = P.run_profile(data, layers.LayerMeta("l", crs="EPSG:3857"), own, {"below_minimum_feature_length": {"unknown": 1}})
        status = {r["check"]: r["status"] for r in coverage.collect()}
        assert status == {"null_geometry": "completed", "breaks_as_it_runs": "failed", "unknown_column": "failed", "below_minimum_feature_length": "failed", "self_intersection": "completed"}
        rows_ = found.groupBy("problem_name").count().collect()
        assert {r["problem_name"]: r["count"] for r in rows_} == {"validation_runtime_error": 3, "self_intersection": 1}
    finally:
        P.CHECKS.pop("breaks_as_it_runs"), P.CHECKS.pop("unknown_column")


@pytest.mark.parametrize("scan_edges", [2_000_000, 40])
def test_scans_of_large_groups_go_on_in_parts(spark, monkeypatch, scan_edges):
    """A random graph that is one group, against the line-by-line scan; also where a task may read 40 pairs only."""
    monkeypatch.setattr(network, "SCAN_EDGES", scan_edges)
    rng = np.random.default_rng(6)
    edges = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 150, (260, 2)).tolist() if a != b} | {(i, i + 1) for i in range(149)})
    got = {(r["b"], r["a"]) for r in network.first_centres(spark.createDataFrame(edges, "a long, b long"), rounds=2).collect()}
    flagged, want = {}, set()
    for a, b in edges:
        if a not in flagged:
            flagged.setdefault(b, a)
    centres = {a for a, _ in edges} | {b for _, b in edges}
    want = {(b, min(a for a, c in edges if c == b and a not in flagged)) for b in flagged}
    assert got == want and centres


def test_near_ends_across_the_antimeridian_and_near_the_poles(spark):
    """Against all pairs by the haversine formula, in metres."""
    rng = np.random.default_rng(9)
    at = [(179.9999, 10.0), (-179.9999, 10.0), (180.0, -5.0), (-180.0, -5.0), (0.0, 89.9999), (90.0, 89.9999), (180.0, 89.9999), (-135.0, -89.99995), (45.0, -89.99995), (12.0, 50.0), (12.0002, 50.0)]
    at += [(float(x), float(y)) for x, y in zip((rng.uniform(-1, 1, 40) * 2e-4 + 180 + 180) % 360 - 180, rng.uniform(-1, 1, 40) * 2e-4, strict=True)]
    got = {((r["xa"], r["ya"]), (r["xb"], r["yb"])) for r in network.place_pairs(spark.createDataFrame(at, "x double, y double"), 25.0, True).collect()}

    def metres(a, b):
        dx, dy = math.radians((b[0] - a[0] + 180) % 360 - 180), math.radians(b[1] - a[1])
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin(dy / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(dx / 2) ** 2))

    want = {(a, b) for a in at for b in at if 0 < metres(a, b) <= 25}
    assert got == want and ((179.9999, 10.0), (-179.9999, 10.0)) in got and ((0.0, 89.9999), (180.0, 89.9999)) in got and len(want) > 40


def test_issue_ids_of_any_text(spark):
    import hashlib
    import json

    for text in ("plain", 'q"\\', "straße", "漢字 😀", "a\nb\tc\x01", ""):
        df = spark.createDataFrame([("p", 0, text, None, text)], "problem_name string, feature_pos long, feature_id string, geometry string, description string")
        want = hashlib.sha1(json.dumps({"description": text, "feature_id": text, "geometry": None, "problem_name": "p"}, sort_keys=True).encode()).hexdigest()[:16]
        assert issues.finished(df).first()["issue_id"] == want


def test_projections(spark):
    """Known places: the equator's end and half the globe in Mercator, UTM of a point in zone 33."""
    from cartosieve.functions import projections

    at = lambda code, x, y: spark.range(1).select(F.get(G.coords(projections.transformed(G.point(F.lit(x), F.lit(y)), *code)), F.lit(0)).alias("c")).first()["c"]
    assert abs(at((4326, 3857), 180.0, 0.0)["x"] - 20037508.342789) < 1e-5 and abs(at((4326, 3857), 0.0, 85.05112877980659)["y"] - 20037508.342789) < 1e-4
    middle = at((4326, 32633), 15.0, 0.0)
    assert abs(middle["x"] - 500000) < 1e-6 and abs(middle["y"]) < 1e-6
    assert abs(at((4326, 32733), 15.0, -1e-9)["y"] - 10_000_000) < 1e-3
    assert abs(at((4326, 32633), 15.0, 90.0)["y"] - 9997964.943) < 1e-2  # the quarter meridian times the scale
    back = at((32633, 3857), *(lambda c: (c["x"], c["y"]))(at((4326, 32633), 13.4, 52.5)))
    assert abs(back["x"] - math.radians(13.4) * 6378137) < 1e-3
    data = layer(spark, [line((1, 2), (3, 4)), None])
    same, meta = lookups.fix_crs(data, layers.LayerMeta(crs="EPSG:4326"), "urn:ogc:def:crs:EPSG::4326")
    assert same is data and meta.crs == "EPSG:4326"
    found, fixed, meta = lookups.crs_validation(data, layers.LayerMeta(crs="EPSG:4326"), "EPSG:3857", fix=True)
    assert [r["problem_name"] for r in found.collect()] == ["invalid_spatial_reference"] and meta.crs == "EPSG:3857" and fixed.where("geometry is null").count() == 1
    with pytest.raises(ValueError):
        lookups.fix_crs(data, layers.LayerMeta(crs="EPSG:27700"), "EPSG:4326")


def test_lookups(spark):
    assert lookups.dataset_type(["X", "Zoning"]) == "land_use" and lookups.dataset_type(["a"]) == "generic" and lookups.dataset_type(["ASSET_ID", "zoning"]) == "water_network"
    data = layer(spark, [box(0, 0, 1, 1)], DMA_NAME=["x"], office=["o"])
    hints = lookups.district_hints(data, layers.LayerMeta())
    assert (hints.name_field, hints.admin_field, hints.created_field, hints.is_district_layer) == ("DMA_NAME", "office", None, True)
    assert not lookups.district_hints(layer(spark, [line((0, 0), (1, 1))], dma=["x"]), layers.LayerMeta()).is_district_layer
    kinds = spark.createDataFrame([("duplicate_vertex", "d", "x"), ("polygon_gap_same_layer", None, "x"), ("line_dangle", None, "hydrants"), ("line_dangle", None, "roads"), ("missing_or_stale_spatial_index", None, None), ("coordinate_precision_not_fit_for_use", None, None)], "p string, d string, n string")
    assert [r[0] for r in kinds.select(lookups.reading(F.col("p"), F.col("d"), F.col("n"))).collect()] == ["duplicate", "coverage", "review", "review", "index", "precision"]
    flags = spark.createDataFrame([("validation_runtime_error", None), ("line_dangle", "3"), ("missing_metadata_title", "1")], "p string, f string")
    got = [tuple(r) for r in flags.select(lookups.is_operational(F.col("p")), lookups.is_endpoint_issue(F.col("p")), lookups.is_layer_level(F.col("p"), F.col("f"))).collect()]
    assert got == [(True, False, True), (False, True, False), (False, False, True)]
    odd = spark.createDataFrame([(0, 0, ("Point", [(0, 0, [(float("nan"), 1.0, None)])])), (1, 1, ("Point", [(0, 0, [(2.0, 1.0, None)])])), (2, 2, ("Point", []))], f"feature_pos long, feature_id long, geometry {G.GEOMETRY}")
    assert [r["feature_pos"] for r in lookups.sanitised(odd).where("geometry is not null").collect()] == [1]
    best = lookups.default_layer(spark.createDataFrame([("a", 0), ("mains", 5), ("b", 5)], "layer_name string, n_features long"), "main").first()
    assert best["layer_name"] == "mains"


def test_reports_read_back(spark, tmp_path):
    from cartosieve.plans import report

    found = issues.finished(rows.null_geometry(layer(spark, [None, line((0, 0), (1, 1))])))
    report.write_payload(found, str(tmp_path / "p"))
    assert report.read_report(spark, str(tmp_path / "p" / "issues")).first()["problem_name"] == "null_geometry"
    assert {r["issue_count"] for r in spark.read.json(str(tmp_path / "p" / "summary")).collect()} == {1}
    for name, text in {"list.json": '[{"problem_name": "a"}, {"problem_name": "b"}]', "object.json": '{\n "issue_count": 2,\n "issues": [{"problem_name": "a"}, {"problem_name": "b"}]}', "one.json": '{"issues": [{"problem_name": "a"}, {"problem_name": "b"}]}'}.items():
        (tmp_path / name).write_text(text)
        assert sorted(r["problem_name"] for r in report.read_report(spark, str(tmp_path / name)).collect()) == ["a", "b"], name
    fixes = spark.createDataFrame([("drop_null_geometries", 1)], "fix string, n int")
    for _ in range(2):
        report.log_fixes(fixes, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert {r["row_type"] for r in report.run_report(found, fixes).collect()} == {"issue", "fix_action"}


def test_made_valid():
    def areas_of(rings):
        shoelace = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))) / 2
        return sorted(round(shoelace(p[0]) - sum(map(shoelace, p[1:])), 6) for p in (([q.tolist() for q in polygon]) for polygon in planar.valid_polygons([np.array(r, float) for r in rings])))

    for turn in (0.0, 0.4, 1.9):
        t = lambda ring: [(x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)) for x, y in ring]  # noqa: B023, E731
        square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
        assert areas_of([t([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])]) == [1, 1]
        assert areas_of([t(square)]) == [16] and areas_of([t(square), t([(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)])]) == [15]
        assert areas_of([t(square), t([(3, 1), (6, 1), (6, 2), (3, 2), (3, 1)])]) == [2, 15]  # what both cover is out
        assert areas_of([t([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)])]) == [4, 4]  # touches itself on an edge
        assert areas_of([t([(0, 0), (1, 0), (2, 0), (0, 0)])]) == [] == areas_of([])
    star = [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(6)]
    assert len(areas_of([star])) == 5


def test_repair_plan(spark):
    data = layer(spark, [None, line((0, 0), (0, 0), (1, 1)), ("Polygon", [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])])
    repairs.register_repair("tag", lambda layer, value="x": layer.withColumn("tag", F.lit(value)))
    try:
        all_ = repairs.apply_repairs(data, (), ("TAG",))
        assert all_.count() == 2 and "tag" not in all_.columns and all_.where("geometry.type = 'MultiPolygon'").count() == 1
        assert repairs.apply_repairs(data, ("Drop_Null_Geometries", "tag"), options={"tag": {"value": "y"}}).select("tag").distinct().collect()[0][0] == "y"
        with pytest.raises(KeyError):
            repairs.apply_repairs(data, ("nothing",))
    finally:
        repairs.REPAIRS.pop("tag")


def test_nearest_against_another_library(spark):
    """Points, lines and polygons with holes, dense and far apart, equal distances, repeated and empty shapes."""
    from cartosieve.operators import nearest

    reader, rng = jts(spark), np.random.default_rng(23)

    def some(n, spread):
        found = []
        for i in range(n):
            kind = ["MultiPoint", "MultiLineString", "MultiPolygon"][i % 3]
            parts = random_shape(rng, kind)
            while not reader.read(text(kind, parts)).isValid():
                parts = random_shape(rng, kind)
            x, y = rng.integers(0, spread, 2).tolist() if i % 5 else (3, 3)
            move = lambda r: [(px + x, py + y) for px, py in r]  # noqa: B023, E731
            found.append((kind, [[move(r) for r in p] for p in parts] if kind == "MultiPolygon" else [move(p) for p in parts]))
        return found

    a, b = some(60, 4000) + [("MultiPoint", [[(-90_000, 5)]])], some(90, 1000)
    rows_of = lambda shapes: spark.createDataFrame([(i, planar.shapes([k], [[(n, m, np.array(r, float)) for n, p in enumerate(parts) for m, r in enumerate(p if k == "MultiPolygon" else [p])]]).to_pylist()[0]) for i, (k, parts) in enumerate(shapes)], f"feature_pos long, geometry {G.GEOMETRY}").withColumn("feature_id", F.col("feature_pos"))
    left, right = rows_of(a), rows_of(b)
    got = {r["feature_pos"]: r for r in nearest.nearest(left, right).collect()}
    read = [[reader.read(text(k, p)) for k, p in shapes] for shapes in (a, b)]
    assert len(got) == len(a)
    for i, shape_a in enumerate(read[0]):
        away = [shape_a.distance(shape_b) for shape_b in read[1]]
        assert abs(got[i]["distance"] - min(away)) < 1e-9 and abs(away[got[i]["reference_pos"]] - min(away)) < 1e-9
    zero = {r["feature_pos"] for r in got.values() if r["distance"] == 0}
    assert zero and {int(i) for i in ids(nearest.positional_accuracy(left, right, 0))} == set(range(len(a))) - zero
    assert nearest.nearest(left, right.where("false")).count() == 0 and len(ids(nearest.positional_accuracy(left, right.where("false"), 5))) == len(a)
    assert nearest.nearest(left.where("false"), right).count() == 0


def test_dissolved_shapes(spark):
    """A ring of four with a hole, one inside the hole, two that touch in a corner, a blank name; attributes of the largest."""
    data = layer(spark, [box(0, 0, 5, 1), box(0, 0, 1, 5), box(4, 0, 5, 5), box(0, 4, 5, 5), box(2, 2, 3, 3), box(10, 0, 11, 1), box(11, 1, 13, 2), box(0, 0, 9, 9), None], name=["A", "a ", "A", "a", "A", "b", "B", "", "A"])
    got = {r["name"]: r for r in districts.dissolved(data, "name").withColumn("area", G.area(F.col("geometry"))).collect()}
    assert {k.strip().lower(): (r["n_features"], r["area"], r["geometry"]["type"], sorted((p["part"], p["ring"]) for p in r["geometry"]["parts"])) for k, r in got.items()} == {
        "a": (5, 17, "MultiPolygon", [(0, 0), (0, 1), (1, 0)]) if [p["ring"] for p in got["A"]["geometry"]["parts"]] == [0, 1, 0] else (5, 17, "MultiPolygon", [(0, 0), (1, 0), (1, 1)]),
        "b": (2, 3, "MultiPolygon", [(0, 0), (1, 0)]), "": (1, 81, "Polygon", [(0, 0)]),
    }
