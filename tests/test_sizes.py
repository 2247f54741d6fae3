"""What grows with a layer's rows must not be copied to all tasks, nor be one task's."""

import pytest
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G
from cartosieve.operators import districts, topology
from cartosieve.sources import derived

N = 400


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parts whose file is small, as it always is before the shapes are made of it."""
    path = str(tmp_path_factory.mktemp("tables"))
    key = F.col("id")
    spark.range(N).select(key.alias("p_partkey"), F.lit("name").alias("p_name"), F.concat(F.lit("Brand#"), key % 2).alias("p_brand"), F.lit("type").alias("p_type"), (key % 50).cast("int").alias("p_size")).write.parquet(f"{path}/part.parquet")
    spark.range(N).select(key.alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-HIGH").alias("o_orderpriority")).write.parquet(f"{path}/orders.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().toString()


def joins(df):
    return plan(df).split("== Physical Plan ==")[1]


def test_pairs_and_their_shapes_are_not_broadcast(spark, tables):
    for layer in (derived.zones(spark, tables), derived.plots(spark, tables), derived.mixed(spark, tables)):
        for found in (topology.shape_pairs(layer), topology.polygon_pairs(layer), topology.crossing_pairs(layer)):
            assert "SortMergeJoin" in joins(found) and "Broadcast" not in joins(found)
    zones = derived.zones(spark, tables)
    pairs = spark.createDataFrame([(0, 1)], "feature_pos long, related_pos long")
    assert "Broadcast" not in joins(districts.overlap_shapes(zones, pairs))


def test_rows_of_a_small_file_are_dealt_to_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(derived, "TASK_ROWS", 50)
    for layer in (derived.zones(spark, tables), derived.roads(spark, tables)):
        sizes = layer.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == N // 50 and sum(r["count"] for r in sizes) == N and max(r["count"] for r in sizes) < 100


def test_the_union_of_a_name_is_numbered_without_a_look_up_for_each_ring(spark):
    square = G.rectangle(F.col("id") * 3, F.lit(0), F.col("id") * 3 + 2, F.lit(2))
    layer = spark.range(1200).select(F.col("id").alias("feature_pos"), F.col("id").alias("feature_id"), square.alias("geometry"), F.lit("one").alias("name"))
    found = topology.united(layer, "name")
    assert "array_distinct" not in plan(found) and "array_position" not in plan(found)
    shape = found.collect()[0]["geometry"]
    assert shape["type"] == "MultiPolygon" and [p["part"] for p in shape["parts"]] == list(range(1200)) and {p["ring"] for p in shape["parts"]} == {0}


def test_layers_with_joined_attributes_are_not_broadcast(spark, tables):
    from cartosieve.plans import registry

    for layer in (derived.named_plots(spark, tables), registry._coded_zones(spark, tables)):
        assert "SortMergeJoin" in joins(layer) and "Broadcast" not in joins(layer)


def test_near_places_are_copied_to_few_cells(spark):
    """Points on a fine grid, many at just the tolerance from each other and on the borders of cells."""
    from cartosieve.operators import network

    places = spark.range(900).select(((F.col("id") % 30) * 0.05 - 0.75).alias("x"), (F.floor(F.col("id") / 30) * 0.05 - 0.75).alias("y"))
    found = {tuple(r) for r in network.place_pairs(places, 0.1, False).select("xa", "ya", "xb", "yb").collect()}
    points = [tuple(r) for r in places.collect()]
    want = {(*p, *q) for p in points for q in points if 0 < ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) ** 0.5 <= 0.1}
    assert found == want
    spread = spark.range(4000).select((F.col("id") * 7.3 % 211).alias("x"), (F.col("id") * 3.7 % 197).alias("y"))
    text = plan(network.place_pairs(spread, 0.1, False)).split("== Physical Plan ==")[1]
    assert "Broadcast" not in text and "array(-1, 0, 1)" not in text and text.count("explode(sequence(") == 2


def test_squared_distances_are_those_of_lists(spark, monkeypatch):
    """Nulls, empty and uneven vectors, several blocks and chunks; vectors are not evaluated list by list."""
    from cartosieve.operators import features

    monkeypatch.setattr(features, "BLOCK_ROWS", 7)
    monkeypatch.setattr(features, "CHUNK_QUERIES", 2)
    vectors = [None, [], [1.5], [1.0, None], [float("nan"), 1.0], *[[i * 0.37, i * i * 0.011] for i in range(15)]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<float>")
    asked = rows.where("id < 8")
    found = features.squared_distances(rows, asked)
    assert "zip_with" not in plan(found)
    want = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q")).crossJoin(rows).select("query_id", F.col("id").alias("vec_id"), features.squared_distance(F.col("q"), F.col("vector")).alias("distance"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 160


def test_a_line_is_made_once_whatever_reads_it(spark, tables):
    """Filters on a derived shape must not make it again for each of their parts."""
    for layer, mark in ((derived.roads(spark, tables), "SIN("), (derived.pipes(spark, tables), "0.125"), (derived.tracks(spark, tables), "% 37")):
        once = joins(layer).count(mark)
        read = layer.where("geometry is not null and size(geometry.parts) > 0").where(G.endpoints(F.col("geometry")).isNotNull() & ~G.has_repeated_vertex(F.col("geometry")))
        assert 0 < joins(read).count(mark) <= once


def test_lines_that_go_on_in_one_direction_are_not_swept(spark, monkeypatch):
    """What goes on in x or y with each segment, up or down, cannot meet itself; all else is judged as before."""
    import numpy as np

    from cartosieve.functions import arrangement, planar

    rng = np.random.default_rng(5)
    lines = [np.column_stack((np.arange(20.0), rng.normal(size=20))), np.column_stack((rng.normal(size=20), -np.arange(20.0)))]  # onward
    lines += [rng.integers(0, 6, (n, 2)).astype(float) for n in (2, 3, 4, 5, 6, 8)] * 2 + [np.array([(0, 0), (0, 2), (0, 1)], float), np.array([(1, 1), (1, 1)], float)]
    parts = [[(0, 0, c)] for c in lines] + [[(0, 0, np.array([(0, 0), (2, 2)], float)), (1, 0, np.array([(0, 2), (2, 0)], float))]]
    shapes = planar.shapes(["LineString"] * len(lines) + ["MultiLineString"], parts)
    swept, near = [], arrangement.near
    monkeypatch.setattr(arrangement, "near", lambda own, *rest: swept.append(set(own.job)) or near(own, *rest))
    found = arrangement.meets_itself(shapes)
    assert found[-1] and not swept[0] & {0, 1} and len(parts) - 1 in swept[0]
    monkeypatch.setattr(arrangement, "onward", lambda own, jobs: np.zeros(jobs, bool))
    assert (found == arrangement.meets_itself(shapes)).all() and found.any() and not found.all()


def test_checks_of_networks_copy_no_layer_to_all_tasks(spark, tables):
    from cartosieve.operators import network

    pipes = derived.pipes(spark, tables)
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    ends = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 1.0, 1.0)], "a long, b long, xa double, ya double, xb double, yb double, distance double")
    found = {
        "dangle": network.line_dangle(pipes, "asset_class", ("high",)), "isolated": network.isolated_segment(pipes), "degrees": network.end_degrees(pipes), "gaps": network.pair_issues(pipes, ends, "p", "t"),
        "pairs": network.end_pairs(network.ends(pipes), 0.1), "crossing": topology.line_intersections(pipes, pairs), "same": topology.duplicate_geometry(pipes),
    }
    assert not [name for name, df in found.items() if "Broadcast" in joins(df)]
    assert joins(found["dangle"]).count("SortMergeJoin") == 1  # the ends themselves are grouped, not joined


def test_lines_that_touch_at_an_end_are_no_pairs_of_shapes(spark):
    """Boxes with one point in common: an end of either line there is a touch; the middle of both, a corner, is a crossing. Rings and many-part lines are left to their shapes."""
    from cartosieve.functions import codecs

    texts = ["LINESTRING (0 0, 1 0)", "LINESTRING (1 0, 2 0)", "LINESTRING (1 0, 1 1, 3 1)", "LINESTRING (5 5, 6 6, 5 6)", "LINESTRING (7 6, 6 6, 6 7, 7 7)", "LINESTRING (8 8, 9 8, 9 9, 8 8)", "LINESTRING (9 8, 10 8)", "LINESTRING (9 7, 9 8, 10 7)"]
    layer = spark.createDataFrame(list(enumerate(texts)), "feature_pos long, w string").select("feature_pos", F.col("feature_pos").alias("feature_id"), codecs.from_wkt("w").alias("geometry"))
    known = layer.select("*")
    both = topology.with_shapes(topology.candidate_pairs(known, known, topology.cell_size(known)).select("a", "b"), known, known)
    want = {(r["a"], r["b"]) for r in both.withColumn("hit", topology.insides_meet("geometry_a", "geometry_b")).where("hit").collect()}
    found = topology.crossing_pairs(layer)
    assert {(r["a"], r["b"]) for r in found.collect()} == want and "array_contains" in joins(found) and (3, 4) in want and (0, 1) not in want


def test_nearest_deals_no_boxes_to_cells_without_polygons(spark, monkeypatch):
    from cartosieve.operators import nearest

    at = lambda shape, n=3: spark.range(n).select(F.col("id").alias("feature_pos"), F.col("id").alias("feature_id"), shape.alias("geometry"))
    x = F.col("id") * 10
    points, squares = at(G.point(x + 1, F.lit(1))), at(F.when(F.col("id") != 1, G.rectangle(x, F.lit(0), x + 2, F.lit(2))).otherwise(G.point(x, F.lit(1))))
    met, real = [], nearest.candidate_pairs
    monkeypatch.setattr(nearest, "candidate_pairs", lambda left, right, *rest: met.append((left.count(), right.count())) or real(left, right, *rest))
    rows = lambda *layers: sorted((r["feature_pos"], r["reference_pos"], r["distance"]) for r in nearest.nearest(*layers).collect())
    assert rows(points, at(G.point(x, F.lit(1)))) == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)] and met == []
    assert rows(points, squares) == [(0, 0, 0.0), (1, 1, 1.0), (2, 2, 0.0)] and rows(squares, points) == [(0, 0, 0.0), (1, 1, 1.0), (2, 2, 0.0)]
    assert met == [(3, 2), (2, 3)] and rows(squares, squares) == [(0, 0, 0.0), (1, 1, 0.0), (2, 2, 0.0)]


def test_polygons_are_mended_in_one_pass(spark, monkeypatch):
    """A shape goes through Python once, and all shapes of a batch are cut at once, with the polygons that each gives alone."""
    import numpy as np

    from cartosieve.functions import arrangement, codecs, planar
    from cartosieve.operators import repairs

    texts = ["POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", None, "LINESTRING (0 0, 2 2, 2 0, 0 2)", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POINT (1 1)", "POLYGON EMPTY", "POLYGON ((0 0, 1 0, 2 0, 0 0))"]
    layer = spark.createDataFrame(list(enumerate(texts)), "feature_pos long, w string").select("feature_pos", codecs.from_wkt("w").alias("geometry"))
    layer = layer.localCheckpoint()
    for some in (layer, layer.where("feature_pos in (1, 2, 3)")):
        found = repairs.make_geometries_valid(some)
        assert found.columns == some.columns and "Union" not in joins(found) and joins(found).count("EvalPython") == 1
        old, new = ({r["feature_pos"]: r["geometry"] for r in df.collect()} for df in (some, found))
        assert old.keys() == new.keys() and all(old[k] == new[k] for k in old.keys() & {1, 2, 3, 4, 5})
    shapes = {r["feature_pos"]: r["geometry"] for r in repairs.make_geometries_valid(layer).collect()}
    assert shapes[0]["type"] == "MultiPolygon" and len(shapes[0]["parts"]) == 2 and shapes[6]["type"] == "MultiPolygon" and shapes[6]["parts"] == []

    rng = np.random.default_rng(3)
    rings = [[rng.integers(0, 7, (rng.integers(1, 9), 2)).astype(float) + k for _ in range(rng.integers(1, 4))] for k in range(60)]
    batch = planar.shapes(["Polygon"] * len(rings), [[(0, i, r) for i, r in enumerate(own)] for own in rings])
    edges, sizes = arrangement.segments(batch, close=True), np.bincount(arrangement.coordinates(batch)[1])
    calls, real = [], planar.parts_of
    monkeypatch.setattr(planar, "parts_of", lambda *a, **k: calls.append(1) or real(*a, **k))
    together = planar.valid(edges.of(sizes[edges.ring] > 2), len(rings))
    assert len(calls) == 1
    plain = lambda polygons: [[r.tolist() for r in p] for p in polygons]
    assert [plain(p) for p in together] == [plain(planar.valid_polygons(own)) for own in rings] and sum(map(bool, together)) > 30


def test_what_neighbours_leave_of_an_edge_is_found_without_python(spark):
    """Stretches unordered, nested, overlapping, touching, on the whole edge, on an edge that is not there, and none; the key may be null."""
    import random

    from cartosieve.functions.arrangement import ON_LINE

    rng = random.Random(4)
    at = lambda: rng.choice([0.0, 0.25, 0.5, 0.75, 1.0, 1 - ON_LINE / 2, ON_LINE / 2, rng.random()])
    gone = {(f, e): [tuple(sorted((at(), at()))) for _ in range(rng.randint(0, 4))] for f in range(12) for e in range(5)}
    gone[0, 0], gone[0, 1], gone[11, 4] = [], [(0.0, 1.0)], [(0.5, 0.75), (0.0, 0.5), (0.1, 0.2)]
    edges = spark.createDataFrame([(f, None if f == 3 else f"k{f}", e, float(f), float(e), f + 1.0, e + 1.0) for f, e in gone], "feature_pos long, key string, edge long, x0 double, y0 double, x1 double, y1 double")
    stretches = spark.createDataFrame([(f, e, lo, hi) for (f, e), own in gone.items() for lo, hi in own] + [(99, 0, 0.0, 0.5)], "feature_pos long, edge long, lo double, hi double")
    want = []
    for (f, e), own in gone.items():
        reached = 0.0
        for lo, hi in sorted(own):
            if lo > reached + ON_LINE:
                want.append((None if f == 3 else f"k{f}", float(f), float(e), reached, lo))
            reached = max(reached, hi)
        if reached < 1 - ON_LINE:
            want.append((None if f == 3 else f"k{f}", float(f), float(e), reached, 1.0))
    found = topology._left_over(edges, stretches)
    assert "EvalPython" not in joins(found) and "Join" not in joins(found)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select("key", "x0", "y0", "t.lo", "t.hi").collect())


def test_rings_are_put_in_order_without_a_record_for_each_edge():
    """Squares, two that touch in a corner, one that is not closed (followed from its lowest corner), none: and a full batch in some megabytes."""
    import tracemalloc

    import pyarrow as pa

    kind = pa.list_(pa.struct([("edge", pa.int64()), ("b", pa.int64()), *((c, pa.float64()) for c in ("x0", "y0")), *((c, pa.int64()) for c in ("k0x", "k0y"))]))
    ring = lambda first, corners: [{"edge": first + i, "b": first + (i + 1) % len(corners), "x0": float(x), "y0": float(y), "k0x": x, "k0y": y} for i, (x, y) in enumerate(corners)]
    square = [(1, 1), (0, 1), (0, 0), (1, 0)]
    open_ = ring(40, square)
    open_[3]["b"] = 999
    found = topology._in_order.func(pa.array([ring(7, square)[::-1], ring(20, [*square, (1, 1), (2, 1), (2, 2), (1, 2)]), open_, []], kind)).to_pylist()
    plain = [[(r["ring"], [(c["x"], c["y"]) for c in r["coords"]]) for r in rings] for rings in found]
    closed = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert plain == [[(7, closed)], [(24, [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]), (20, closed)], [(42, [(0, 0), (1, 0), (0, 0)])], []]
    corners = [(k, 0) for k in range(8)] + [(k, 1) for k in range(7, -1, -1)]
    batch = pa.array([ring(k * 16, corners) for k in range(10_000)], kind)
    tracemalloc.start()
    assert len(topology._in_order.func(batch)) == 10_000
    assert tracemalloc.get_traced_memory()[1] < 80 << 20


def test_shapes_are_made_after_their_names_are_joined(spark, tables):
    text = joins(derived.named_plots(spark, tables))
    assert 0 < text.index("Generate posexplode") < text.index("SortMergeJoin")  # the upper of the two comes first


def test_only_what_neighbours_cut_is_put_together_from_lines(spark, monkeypatch):
    """200 squares apart, one that holds another, and three that overlap in a row: the latter give lines, all others are whole rings."""
    made, real = [], topology.groups
    monkeypatch.setattr(topology, "groups", lambda edges, *rest: made.append(edges.count()) or real(edges, *rest))
    x, k = F.col("id") * 10, F.col("id") - 201
    square = F.when(k < -1, G.rectangle(x, F.lit(0), x + 2, F.lit(2))).when(k == -1, G.rectangle(F.lit(0.5), F.lit(0.5), F.lit(1), F.lit(1))).otherwise(G.rectangle(k * 3, F.lit(50) + k, k * 3 + 4, F.lit(52) + k))
    layer = spark.range(204).select(F.col("id").alias("feature_pos"), F.col("id").alias("feature_id"), square.alias("geometry"), F.lit("one").alias("name"))
    shape = topology.united(layer, "name").select(F.size("geometry.parts").alias("n"), G.area(F.col("geometry")).alias("area"), topology.meets_itself("geometry").alias("bad")).first()
    assert (shape["n"], shape["area"], shape["bad"]) == (201, 200 * 4 + 3 * 8 - 2, False)
    assert len(made) == 1 and 0 < made[0] <= 12


def test_groups_of_several_tasks_are_those_of_one(spark, monkeypatch):
    """With edges dealt by any order and by columns that keep components together."""
    import random

    from cartosieve.functions import graphs

    rng = random.Random(8)
    edges = [(c * 10 + i, c * 10 + (i + 1) % 10, c) for c in range(60) for i in range(10)] + [(c * 10, c * 10 + 10, c) for c in range(40, 59)] + [(7001, 7002, 80)]
    rng.shuffle(edges)
    want = {v: 400 if 400 <= v < 600 else 7001 if v > 7000 else v // 10 * 10 for e in edges for v in e[:2]}
    rows = spark.createDataFrame(edges, "a long, b long, c long")
    for size in (100, 1000):
        monkeypatch.setattr(graphs, "TASK_EDGES", size)
        for near in ((), ["c"]):
            assert {r["v"]: r["g"] for r in graphs.groups(rows, near).collect()} == want


def test_checks_of_single_features_read_a_layer_once(spark):
    """Kinds of geometry, null shapes, repeated vertices and outlines that meet themselves, in one scan; one check that fails as it runs leaves the others."""
    from cartosieve.functions import codecs
    from cartosieve.operators.layers import LayerMeta
    from cartosieve.plans import profiles

    texts = ["LINESTRING (0 0, 1 1, 2 0)", "LINESTRING (0 0, 1 1, 1 0, 0 1)", "LINESTRING (0 0, 0 0, 1 0)", None, "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "POINT (1 1)"]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(list(enumerate(texts)), "feature_pos long, w string")
    layer = rows.mapInArrow(counted, rows.schema).select("feature_pos", F.col("feature_pos").alias("feature_id"), codecs.from_wkt("w").alias("geometry")).withColumn("geometry", codecs.or_null(F.col("geometry")))
    want = {("null_geometry", 3), ("duplicate_vertex", 2), ("self_intersection", 1), ("self_intersection", 4)}
    found, coverage = profiles.run_profile(layer, LayerMeta("l", crs="EPSG:3857"), "geometry")
    assert {(r["problem_name"], r["feature_pos"]) for r in found.collect()} == want and {r["status"] for r in coverage.collect()} == {"completed"}
    assert read.value == len(texts)
    bad = F.when(F.col("feature_pos") == 5, F.raise_error(F.lit("no"))).otherwise(F.lit(False)).cast("boolean")
    profiles.register_check("bad", profiles.Check("geometry", 1, (), lambda layer, meta: layer.where(bad).select(F.lit("bad").alias("problem_name"), "feature_pos", "feature_id", F.lit("").alias("geometry"), F.lit("").alias("description")), lambda: (bad, "bad", "bad")))
    try:
        found, coverage = profiles.run_profile(layer, LayerMeta("l", crs="EPSG:3857"), profiles.Profile("p", (*profiles.BASIC, "bad")))
        assert {(r["problem_name"], r["feature_pos"]) for r in found.collect()} == want | {("validation_runtime_error", None)}
        assert {r["check"]: r["status"] for r in coverage.collect()} == {**dict.fromkeys(profiles.BASIC, "completed"), "bad": "failed"}
    finally:
        del profiles.CHECKS["bad"]
    empty, coverage = profiles.run_profile(layer.where("false"), LayerMeta("l", crs="EPSG:3857"), "geometry")
    assert empty.count() == 0 and {r["status"] for r in coverage.collect()} == {"completed"}


def test_lines_that_go_on_are_known_without_python(spark):
    """As arrangement.onward says it of shapes without repeated vertices; else no more than it, and never where a vertex is repeated."""
    import numpy as np

    from cartosieve.functions import arrangement, planar

    rng = np.random.default_rng(9)
    nan = float("nan")
    lines = [np.column_stack((np.arange(9.0), rng.normal(size=9))), np.column_stack((rng.normal(size=9), -np.arange(9.0))), *(rng.integers(0, 5, (n, 2)).astype(float) for n in (1, 2, 3, 3, 4, 4, 5, 6) for _ in range(12))]
    lines += [np.array(c, float) for c in ([(0, 0), (1, 1), (1, 1), (2, 0)], [(0, 0), (nan, 1), (2, 0)], [(nan, 0), (nan, 0)], [(0, 0), (0, 1), (0, 2)], [(-0.0, 0), (0.0, 1)], [(2, 0), (1, 1), (0, 0)])]
    made = planar.shapes(["LineString"] * len(lines) + ["MultiLineString", "Polygon", "LineString", None], [[(0, 0, c)] for c in lines] + [[(0, 0, np.array([(0, 0), (1, 1)], float)), (1, 0, np.array([(2, 2), (3, 3)], float))], [(0, 0, np.array([(0, 0), (1, 0), (2, 5)], float))], [], []])
    layer = spark.createDataFrame([(i, g) for i, g in enumerate(made.to_pylist())], f"i long, geometry {G.GEOMETRY}")
    rows = layer.select("i", G.goes_onward(F.col("geometry")).alias("onward"), G.has_repeated_vertex(F.col("geometry")).alias("again")).collect()
    found = {r["i"]: r["onward"] for r in rows}
    known = arrangement.onward(arrangement.segments(made), len(made))
    meets = arrangement.meets_itself(made)
    assert not [r["i"] for r in rows if r["onward"] and (r["again"] or meets[r["i"]])]
    plain = [i for i, c in enumerate(lines) if len(c) > 1 and not np.isnan(c).any() and (c[1:] != c[:-1]).any(axis=1).all()]
    assert [found[i] for i in plain] == known[plain].tolist() and sum(found[i] for i in plain) > 20 and not any(found[i] for i in range(len(lines), len(made)))
