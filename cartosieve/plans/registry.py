"""Queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import codecs, projections, storage
from cartosieve.functions import geometry as G
from cartosieve.operators import districts, features, layers, lookups, nearest, network, repairs, rows, topology
from cartosieve.plans import audit, issues, profiles, report
from cartosieve.sources import derived as D
from cartosieve.sources import las, readers
from cartosieve.streaming import checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shared parts of the oracles.
NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
PAIRS = f"""z AS ({D.ZONES_SQL}), pairs AS (SELECT a.fid AS a, b.fid AS b, a.dma_name AS name_a, b.dma_name AS name_b,
    greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared,
    (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b FROM z a JOIN z b ON a.fid < b.fid AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"""
ENDS = f"p AS ({D.PIPES_SQL}), ends AS (SELECT fid, sx AS x, sy AS y FROM p UNION ALL SELECT fid, ex, ey FROM p), deg AS (SELECT x, y, count(*) AS degree FROM ends GROUP BY x, y), loose AS (SELECT fid, count(*) FILTER (WHERE degree <= 1) AS n FROM ends JOIN deg USING (x, y) GROUP BY fid)"
CROSSING = f"p AS ({D.PIPES_SQL}), c AS (SELECT p.fid AS b, q.fid AS a FROM p JOIN p q ON q.fid = p.fid - 1 WHERE p.across AND p.fid % 100 <> 0)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def found(df: DataFrame) -> DataFrame:
    return df.select("problem_name", F.col("feature_id").alias("feature_id"))


def flag(problem: str, body: str) -> str:
    return f"SELECT '{problem}' AS problem_name, fid AS feature_id FROM {body}"


# single features


@query(f"""SELECT 'null_geometry' AS problem_name, fid AS feature_id, 'critical' AS severity, 100 AS priority_score,
    substr(sha1('{{"description": "Feature has no geometry.", "feature_id": ' || fid || ', "geometry": null, "problem_name": "null_geometry"}}'), 1, 16) AS issue_id FROM ({D.POINTS_SQL}) WHERE missing""")
def geom_null(spark, sf_dir):
    return issues.finished(rows.null_geometry(D.asset_points(spark, sf_dir))).select("problem_name", "feature_id", "severity", "priority_score", "issue_id")


@query(f"""WITH p AS ({D.PIPES_SQL}) SELECT fid AS feature_id, 'LINESTRING (' || {NUM.format("sx")} || ' ' || {NUM.format("sy")} || ', ' || {NUM.format("sx")} || ' ' || {NUM.format("sy")} || ', '
    || CASE WHEN bend THEN {NUM.format("(fid % 100 + 0.5)::DOUBLE")} || ' ' || {NUM.format("(sy + 0.125)")} || ', ' ELSE '' END || {NUM.format("ex")} || ' ' || {NUM.format("ey")} || ')' AS geometry FROM p WHERE again""")
def geom_dup_vertex(spark, sf_dir):
    return rows.duplicate_vertex(D.pipes(spark, sf_dir)).select("feature_id", "geometry")


BEND = "sqrt(power(fid % 100 + 0.5 - sx, 2) + 0.015625) + sqrt(0.25 + 0.015625)"


@query(f"WITH p AS ({D.PIPES_SQL}) SELECT 'below_minimum_feature_length' AS problem_name, fid AS feature_id FROM p WHERE CASE WHEN bend THEN {BEND} ELSE sqrt(power(ex - sx, 2) + power(ey - sy, 2)) END < 0.96")
def geom_min_length(spark, sf_dir):
    return found(rows.below_minimum_length(D.pipes(spark, sf_dir), 0.96))


@query(f"""WITH p AS ({D.PIPES_SQL}) SELECT 'sharp_angle_cutback' AS problem_name, fid AS feature_id FROM p WHERE bend
    AND degrees(acos(((sx - fid % 100 - 0.5) * 0.5 + 0.015625) / (sqrt(power(sx - fid % 100 - 0.5, 2) + 0.015625) * sqrt(0.265625)))) < 151""")
def geom_sharp_angle(spark, sf_dir):
    return found(rows.sharp_angle(D.pipes(spark, sf_dir), 151.0))


@query(f"WITH p AS ({D.PIPES_SQL}) SELECT CAST(sum(2 + again::INT + bend::INT) AS BIGINT) AS n_vertices, count(*) AS n_features FROM p")
def geom_vertex_count(spark, sf_dir):
    return rows.total_vertices(D.pipes(spark, sf_dir))


@query("SELECT 'self_intersection' AS problem_name, o_orderkey AS feature_id FROM orders WHERE o_orderkey % 37 = 0")
def geom_self_intersection(spark, sf_dir):
    return found(topology.self_intersection(D.tracks(spark, sf_dir)))


@query(f"SELECT CASE WHEN missing THEN 'None' ELSE 'Point' END AS geometry_type, count(*) AS n FROM ({D.POINTS_SQL}) GROUP BY 1")
def geom_type_counts(spark, sf_dir):
    return layers.type_counts(D.asset_points(spark, sf_dir))


@query(f"SELECT 'Point' AS geometry_type, count(*) AS n FROM ({D.POINTS_SQL}) WHERE NOT missing")
def geom_dominant_type(spark, sf_dir):
    return layers.dominant_type(D.asset_points(spark, sf_dir))


@query(f"SELECT fid AS feature_id, (x1 - x0) * (y1 - y0) AS area, 'POLYGON ((' || CAST(x0 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || ', ' || CAST(x1 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || ', ' || CAST(x1 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) || ', ' || CAST(x0 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) || ', ' || CAST(x0 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || '))' AS wkt FROM ({D.ZONES_SQL})")
def geom_area_wkt(spark, sf_dir):
    return D.zones(spark, sf_dir).select("feature_id", G.area(F.col("geometry")).alias("area"), G.wkt(F.col("geometry")).alias("wkt"))


@query(f"SELECT fid AS feature_id, round(2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(45 - y) / 2), 2) + cos(radians(y)) * cos(radians(45)) * power(sin(radians(10 - x) / 2), 2)))), 3) AS metres FROM (SELECT fid, x, y % 181 - 90 AS y, missing FROM ({D.POINTS_SQL})) WHERE NOT missing")
def geom_haversine(spark, sf_dir):
    """From each point, its y folded into the range of latitudes, to one place."""
    c = F.get(G.coords(F.col("geometry")), F.lit(0))
    near = D.asset_points(spark, sf_dir).where("geometry is not null").withColumn("c", c)
    return near.select("feature_id", F.round(G.haversine_m(F.col("c.x"), F.col("c.y") % 181 - 90, F.lit(10), F.lit(45)), 3).alias("metres"))


# attributes


@query(flag("null_attribute_in_required_field", f"({D.PIPES_SQL}) WHERE status = 'P'"))
def attr_required_nulls(spark, sf_dir):
    layer = D.pipes(spark, sf_dir).withColumn("status", F.expr("nullif(status, 'P')"))
    return found(rows.required_nulls(layer, ["status", "asset_class"]))


@query(flag("null_attribute_in_required_field", f"({D.ZONES_SQL})"))
def attr_missing_field(spark, sf_dir):
    return found(rows.required_nulls(D.zones(spark, sf_dir), ["no_such_field"]))


@query("SELECT 'non_unique_attribute' AS problem_name, o_orderkey AS feature_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def attr_uniqueness(spark, sf_dir):
    layer = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("feature_pos"), F.col("o_orderkey").alias("feature_id"), F.lit(None).cast(G.GEOMETRY).alias("geometry"), "o_custkey")
    return found(rows.uniqueness(layer, "o_custkey"))


@query(flag("domain_violation", f"({D.PIPES_SQL}) WHERE status NOT IN ('O', 'F')"))
def attr_domain_set(spark, sf_dir):
    return found(rows.domain(D.pipes(spark, sf_dir), "status", {"O", "F"}))


@query("SELECT 'domain_violation' AS problem_name, l_orderkey * 10 + l_linenumber AS feature_id FROM lineitem WHERE l_discount NOT BETWEEN 0.02 AND 0.08")
def attr_domain_range(spark, sf_dir):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    layer = D.table(spark, sf_dir, "lineitem").select(key.alias("feature_pos"), key.alias("feature_id"), F.lit(None).cast(G.GEOMETRY).alias("geometry"), "l_discount")
    return found(rows.domain(layer, "l_discount", (0.02, 0.08)))


@query("SELECT 'domain_violation' AS problem_name, c_custkey AS feature_id FROM customer WHERE NOT c_acctbal > 0")
def attr_positive_number(spark, sf_dir):
    layer = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_pos"), F.col("c_custkey").alias("feature_id"), F.lit(None).cast(G.GEOMETRY).alias("geometry"), "c_acctbal")
    return found(rows.domain(layer, "c_acctbal", rows.positive_number))


# precision, reference systems, metadata


@query(flag("coordinate_precision_not_fit_for_use", f"({D.PIPES_SQL}) WHERE NOT across AND fid % 23 = 0"))
def acc_precision(spark, sf_dir):
    return found(rows.coordinate_precision(D.pipes(spark, sf_dir), 3))


@query(flag("coordinate_precision_not_fit_for_use", f"({D.PIPES_SQL}) WHERE NOT across AND fid % 23 = 0"))
def acc_precision_adaptive(spark, sf_dir):
    return found(rows.coordinate_precision(D.pipes(spark, sf_dir), None, is_geographic=False))


@query(f"WITH p AS ({D.POINTS_SQL}), r AS ({D.REFERENCE_SQL}) SELECT 'positional_accuracy_exceeds_reference_tolerance' AS problem_name, fid AS feature_id FROM p WHERE NOT missing AND NOT EXISTS (SELECT 1 FROM r WHERE power(rx - x, 2) + power(ry - y, 2) <= 9)")
def acc_positional(spark, sf_dir):
    return found(nearest.positional_accuracy(D.asset_points(spark, sf_dir), D.reference_points(spark, sf_dir), 3.0))


@query(f"""WITH p AS ({D.PIPES_SQL}), s AS (SELECT fid, sx AS x0, sy AS y0, CASE WHEN bend THEN fid % 100 + 0.5 ELSE ex END AS x1, CASE WHEN bend THEN sy + 0.125 ELSE ey END AS y1 FROM p
        UNION ALL SELECT fid, fid % 100 + 0.5, sy + 0.125, ex, ey FROM p WHERE bend),
    q AS (SELECT rid, rx + 0.3 AS px, ry * 11 - 40.4 AS py FROM ({D.REFERENCE_SQL})),
    t AS (SELECT rid, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, px, py, greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM q, s)
    SELECT rid AS feature_pos, round(min(sqrt(power(px - x0 - t * dx, 2) + power(py - y0 - t * dy, 2))), 6) AS distance FROM t GROUP BY rid""")
def acc_nearest(spark, sf_dir):
    """From points on and far off the lines' grid to the nearest line."""
    c = F.get(G.coords(F.col("geometry")), F.lit(0))
    moved = D.reference_points(spark, sf_dir).withColumn("geometry", G.point(c["x"] + 0.3, c["y"] * 11 - 40.4))
    return nearest.nearest(moved, D.pipes(spark, sf_dir)).select("feature_pos", F.round("distance", 6).alias("distance"))


CODE = "CASE WHEN crs IN ('EPSG:4326', 'urn:ogc:def:crs:EPSG::4326') THEN 4326 WHEN crs = 'EPSG:3857' THEN 3857 END"


@query(f"SELECT layer_id, {CODE} AS epsg, CASE WHEN crs IS NULL THEN 'missing' WHEN {CODE} IS NULL THEN 'unreadable' WHEN {CODE} <> 4326 THEN 'other' ELSE 'ok' END AS status FROM ({D.INVENTORY_SQL})")
def crs_review(spark, sf_dir):
    return layers.crs_review(D.inventory(spark, sf_dir))


@query(f"""WITH i AS ({D.INVENTORY_SQL}) SELECT layer_id, 'missing_metadata_title' AS problem_name FROM i WHERE title IS NULL UNION ALL SELECT layer_id, 'missing_metadata_extent' FROM i WHERE trim(extent) = ''
    UNION ALL SELECT layer_id, 'missing_spatial_reference' FROM i WHERE crs IS NULL UNION ALL SELECT layer_id, 'invalid_spatial_reference' FROM i WHERE crs = 'local grid'
    UNION ALL SELECT layer_id, 'missing_or_stale_spatial_index' FROM i WHERE index_status IN ('stale', 'missing') UNION ALL SELECT layer_id, 'outdated_attribute_or_spatial_indexes' FROM i WHERE index_status = 'stale'""")
def layer_inventory_issues(spark, sf_dir):
    return layers.inventory_issues(D.inventory(spark, sf_dir))


@query(f"SELECT layer_id, CASE geometry_type WHEN 'Point' THEN 'point_asset_quick' WHEN 'LineString' THEN 'line_network_quick' ELSE 'boundaries_quick' END AS profile FROM ({D.INVENTORY_SQL})")
def profile_recommend(spark, sf_dir):
    return D.inventory(spark, sf_dir).select("layer_id", layers.profile_for(F.col("geometry_type"), F.col("layer_name")).alias("profile"))


@query(f"SELECT min(least(sx, ex)) AS minx, min(least(sy, ey)) AS miny, max(greatest(sx, ex)) AS maxx, max(greatest(sy + CASE WHEN bend THEN 0.125 ELSE 0 END, ey)) AS maxy FROM ({D.PIPES_SQL})")
def layer_bounds(spark, sf_dir):
    return rows.layer_bounds(D.pipes(spark, sf_dir))


@query(f"""WITH p AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y FROM ({D.POINTS_SQL}) WHERE NOT missing), n AS (SELECT count(*) - 1 AS m FROM p),
    rx AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r FROM p), ry AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS r FROM p)
    SELECT (SELECT x FROM rx, n WHERE r = floor(0.02::DOUBLE * m + 0.5)) AS minx, (SELECT y FROM ry, n WHERE r = floor(0.02::DOUBLE * m + 0.5)) AS miny,
    (SELECT x FROM rx, n WHERE r = floor(0.98::DOUBLE * m + 0.5)) AS maxx, (SELECT y FROM ry, n WHERE r = floor(0.98::DOUBLE * m + 0.5)) AS maxy""")
def layer_robust_bounds(spark, sf_dir):
    return layers.robust_bounds(D.asset_points(spark, sf_dir))


@query(f"SELECT fid AS feature_id FROM ({D.POINTS_SQL}) ORDER BY fid LIMIT 20")
def layer_demo_sample(spark, sf_dir):
    return layers.sample(D.asset_points(spark, sf_dir), 20).select("feature_id")


# pairs


@query(f"WITH {PAIRS}, o AS (SELECT * FROM pairs WHERE shared > 0 AND shared < area_a AND shared < area_b) SELECT DISTINCT 'polygon_overlap_same_layer' AS problem_name, fid AS feature_id FROM (SELECT a AS fid FROM o UNION ALL SELECT b FROM o)")
def topo_overlap(spark, sf_dir):
    return found(topology.overlaps(D.zones(spark, sf_dir)))


@query(f"WITH {PAIRS} SELECT DISTINCT 'feature_within_feature' AS problem_name, fid AS feature_id FROM (SELECT a AS fid FROM pairs WHERE shared > 0 AND shared = area_a UNION ALL SELECT b FROM pairs WHERE shared > 0 AND shared = area_b)")
def topo_within(spark, sf_dir):
    return found(topology.within(D.zones(spark, sf_dir)))


@query(f"SELECT 'polygon_overlap_same_layer' AS problem_name, fid AS feature_id FROM ({D.PLOTS_SQL}) WHERE kind = 2")
def topo_overlap_turned(spark, sf_dir):
    """Shapes with irrational coordinates and holes; how they lie is known from how they were made."""
    return found(topology.overlaps(D.plots(spark, sf_dir)))


@query(f"SELECT 'feature_within_feature' AS problem_name, fid AS feature_id FROM ({D.PLOTS_SQL}) WHERE kind = 1 OR kind = 0 AND i = 1")
def topo_within_turned(spark, sf_dir):
    return found(topology.within(D.plots(spark, sf_dir)))


@query("SELECT 'self_intersection' AS problem_name, p_partkey * 2 AS feature_id FROM part WHERE p_partkey % 8 IN (0, 2, 3, 5, 7)")
def geom_self_intersection_parts(spark, sf_dir):
    """Lines of several parts that cross, touch or meet at their ends, polygons whose holes cross or touch their shells, and of parts that overlap or touch."""
    return found(topology.self_intersection(D.mixed(spark, sf_dir)))


@query("SELECT 'feature_within_feature' AS problem_name, p_partkey * 2 + 1 AS feature_id FROM part WHERE p_partkey % 8 IN (0, 3, 6, 7)")
def topo_within_mixed(spark, sf_dir):
    """Points and lines within lines and polygons of several parts."""
    return found(topology.within(D.mixed(spark, sf_dir)))


@query("SELECT 'line_intersection_same_layer' AS problem_name, p_partkey * 2 + i AS feature_id FROM part, (VALUES (0), (1)) s(i) WHERE p_partkey % 8 IN (0, 2, 3, 6, 7)")
def topo_intersection_mixed(spark, sf_dir):
    """Lines against points, lines and polygons: the insides meet, not merely the borders."""
    return found(topology.line_intersections(D.mixed(spark, sf_dir)))


@query(f"WITH {CROSSING} SELECT DISTINCT 'line_intersection_same_layer' AS problem_name, fid AS feature_id FROM (SELECT a AS fid FROM c UNION ALL SELECT b FROM c)")
def topo_line_intersection(spark, sf_dir):
    return found(topology.line_intersections(D.pipes(spark, sf_dir)))


@query(f"WITH {CROSSING} SELECT DISTINCT 'feature_not_split_at_intersection' AS problem_name, fid AS feature_id FROM (SELECT a AS fid FROM c UNION ALL SELECT b FROM c)")
def topo_not_split(spark, sf_dir):
    return found(topology.not_split(D.pipes(spark, sf_dir)))


@query(f"WITH p AS (SELECT * FROM ({D.POINTS_SQL}) WHERE NOT missing) SELECT fid AS feature_id, CASE WHEN fid = min(fid) OVER w THEN 'The geometry is duplicated by another feature.' ELSE 'The geometry duplicates another feature''s.' END AS description FROM p WINDOW w AS (PARTITION BY x, y) QUALIFY count(*) OVER w > 1")
def topo_dup_geometry(spark, sf_dir):
    return topology.duplicate_geometry(D.asset_points(spark, sf_dir)).select("feature_id", "description")


@query("SELECT s_suppkey AS block, 1.0 + s_suppkey % 3 AS area FROM supplier WHERE s_suppkey % 2 = 0")
def topo_gap(spark, sf_dir):
    """Over the whole layer: the frames stand ten apart, so a gap's place says whose it is."""
    return topology.gaps(D.frames(spark, sf_dir)).select(F.floor(F.col("x") / 10).cast("long").alias("block"), "area")


@query(f"""WITH z AS ({D.ZONES_SQL}), r AS (SELECT fid, x0 + CASE WHEN fid % 2 = 0 THEN 0.25 ELSE 0 END AS x0, y0, x1 + CASE WHEN fid % 2 = 0 THEN 0.25 ELSE 0 END AS x1, y1 FROM z),
    m AS (SELECT a.fid AS a, b.fid AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS total
        FROM z a JOIN r b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
    best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) = 1)
    SELECT a AS feature_pos, b AS reference_pos, round((total - 2 * shared) / (total - shared), 6) AS ratio FROM best WHERE (total - 2 * shared) / (total - shared) > 0.02""")
def topo_boundary_mismatch(spark, sf_dir):
    found_ = topology.boundary_mismatch(D.zones(spark, sf_dir), D.zones(spark, sf_dir, shift=0.25), 0.02)
    return found_.select("feature_pos", "reference_pos", F.round("ratio", 6).alias("ratio"))


# networks


@query(f"WITH {ENDS} " + flag("line_dangle", "p JOIN loose USING (fid) WHERE n >= 1 AND asset_class <> 'low'"))
def net_dangle(spark, sf_dir):
    return found(network.line_dangle(D.pipes(spark, sf_dir), "asset_class", ("LOW",)))


@query(f"WITH {ENDS} " + flag("isolated_network_segment", "p JOIN loose USING (fid) WHERE n >= 2"))
def net_isolated(spark, sf_dir):
    return found(network.isolated_segment(D.pipes(spark, sf_dir)))


@query(f"WITH {ENDS} SELECT x, y, degree FROM deg")
def net_degree(spark, sf_dir):
    return network.degrees(D.pipes(spark, sf_dir))


@query(f"WITH {ENDS} SELECT (SELECT count(*) FROM p) AS segments, 0 AS multipart, count(*) FILTER (WHERE degree >= 3) AS junctions, count(*) FILTER (WHERE degree = 1) AS terminals FROM deg")
def net_pack_summary(spark, sf_dir):
    return network.network_summary(D.pipes(spark, sf_dir))


NEAR = "FROM p a JOIN p b ON b.fid = a.fid + 1 WHERE NOT a.across AND NOT b.across AND b.fid % 23 = 0 AND b.fid % 100 <> 0 AND a.ey = b.sy"


@query(f"WITH p AS ({D.PIPES_SQL}) SELECT a.fid AS feature_pos, b.fid AS related_pos, 0.0625 AS distance {NEAR}")
def net_near_miss(spark, sf_dir):
    return network.near_miss(D.pipes(spark, sf_dir), 0.1)


@query(f"WITH {ENDS} SELECT a.fid AS feature_pos, b.fid AS related_pos, 0.0625 AS distance {NEAR} AND (SELECT degree FROM deg WHERE x = a.ex AND y = a.ey) <= 1 AND (SELECT degree FROM deg WHERE x = b.sx AND y = b.sy) <= 1")
def net_unsnapped(spark, sf_dir):
    return network.unsnapped(D.pipes(spark, sf_dir), 0.1)


# districts

RELATED = "first AS (SELECT *, CASE WHEN shared = area_a AND shared = area_b THEN 'equal' ELSE 'nested' END AS relation FROM pairs WHERE {0} AND greatest(shared / area_a, shared / area_b) >= 0.995 QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) = 1) SELECT a AS feature_pos, b AS related_pos, relation FROM first"


@query("SELECT p_partkey AS feature_id, trim(regexp_replace(regexp_replace(lower(trim(p_type)), '[_\\-\\s]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g')) AS key FROM part")
def dma_norm_key(spark, sf_dir):
    return D.zones(spark, sf_dir).select("feature_id", districts.name_key(F.col("office")).alias("key"))


@query(f"WITH {PAIRS}, " + RELATED.format("name_a = name_b"))
def dma_same_name(spark, sf_dir):
    return districts.same_name(D.zones(spark, sf_dir), "dma_name")


@query(f"WITH {PAIRS}, " + RELATED.format("name_a <> name_b"))
def dma_cross_nested(spark, sf_dir):
    return districts.cross_name_nested(D.zones(spark, sf_dir), "dma_name")


@query(f"WITH {PAIRS} SELECT a AS feature_pos, b AS related_pos, shared AS area FROM pairs WHERE name_a <> name_b AND shared >= 1 AND greatest(shared / area_a, shared / area_b) < 0.995")
def dma_cross_overlap(spark, sf_dir):
    return districts.cross_name_overlap(D.zones(spark, sf_dir), "dma_name")


KEY = "trim(regexp_replace(lower(trim(dma_name)), '[^a-z0-9 ]+', '', 'g'))"


@query(f"SELECT {KEY} AS key, count(*) AS parts, min(fid) AS feature_pos FROM ({D.ZONES_SQL}) GROUP BY 1 HAVING count(*) > 1")
def dma_multipart(spark, sf_dir):
    return districts.multipart(D.zones(spark, sf_dir), "dma_name")


CELLS = f"""z AS (SELECT {KEY} AS key, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1 FROM ({D.ZONES_SQL})),
    columns AS (SELECT key, unnest(range(x0, x1)) AS x, y0, y1 FROM z), c AS (SELECT DISTINCT key, x, unnest(range(y0, y1)) AS y FROM columns)"""


@query(f"""WITH {CELLS}, f AS (SELECT key, count(*) AS n FROM c GROUP BY key),
    e AS (SELECT key, count(*) AS n FROM (SELECT a.key FROM c a JOIN c b ON a.key = b.key AND a.x + 1 = b.x AND a.y = b.y UNION ALL SELECT a.key FROM c a JOIN c b ON a.key = b.key AND a.x = b.x AND a.y + 1 = b.y) GROUP BY key)
    SELECT f.key, f.n::DOUBLE AS area, (4 * f.n - 2 * coalesce(e.n, 0))::DOUBLE AS outline, false AS meets_itself FROM f LEFT JOIN e USING (key)""")
def dma_dissolve_union(spark, sf_dir):
    """Area, length of the outline and soundness of each name's union; the SQL counts unit cells and their common edges."""
    shown = districts.dissolved(D.zones(spark, sf_dir), "dma_name")
    return shown.select(
        districts.name_key(F.col("dma_name")).alias("key"), F.round(G.area(F.col("geometry")), 6).alias("area"), F.round(G.planar_length(F.col("geometry")), 6).alias("outline"), topology.meets_itself("geometry").alias("meets_itself"),
    )


NONAGON = "9 * sin(2 * pi() / 9) / 2"


@query(f"""SELECT lower(p_brand) AS brand, p_partkey % 4 AS kind, count(*) * CASE p_partkey % 4 WHEN 3 THEN 2 ELSE 1 END AS shells, CASE p_partkey % 4 WHEN 3 THEN count(*) ELSE 0 END AS holes,
    CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN round(count(*) * ({NONAGON} * (9 - 2.25) + 7 * sin(2 * pi() / 7) / 2), 4) ELSE round(count(*) * {NONAGON} * 9, 4) END AS area FROM part GROUP BY 1, 2""")
def dma_dissolve_turned(spark, sf_dir):
    """Unions of turned shapes by brand and kind: nested, equal, overlapping (their area is not known in advance), and one in the other's hole."""
    shown = districts.dissolved(D.named_plots(spark, sf_dir), "name")
    kind = F.element_at(F.split("name", " "), -1).cast("long")
    count = lambda hole: F.size(F.filter("geometry.parts", lambda p: (p["ring"] > 0) == F.lit(hole))).cast("long")
    return shown.select(F.lower(F.substring_index("name", " ", 1)).alias("brand"), kind.alias("kind"), count(False).alias("shells"), count(True).alias("holes"), F.when(kind != 2, F.round(G.area(F.col("geometry")), 4)).alias("area"))


@query(f"WITH {PAIRS} SELECT a AS feature_pos, b AS related_pos, shared AS area, 1 AS parts FROM pairs WHERE name_a <> name_b AND shared >= 1 AND greatest(shared / area_a, shared / area_b) < 0.995")
def dma_overlap_shapes(spark, sf_dir):
    """The area is that of the shape that the pair has in common."""
    layer = D.zones(spark, sf_dir)
    shapes = districts.overlap_shapes(layer, districts.cross_name_overlap(layer, "dma_name").drop("area"))
    return shapes.select("feature_pos", "related_pos", F.round(G.area(F.col("geometry")), 9).alias("area"), F.size("geometry.parts").alias("parts"))


@query(f"SELECT part * 2 AS feature_pos, part * 2 + 1 AS related_pos, 0.0::DOUBLE AS difference, CASE WHEN kind = 3 THEN 0 ELSE 1 END AS parts FROM ({D.PLOTS_SQL}) WHERE i = 0")
def topo_common_shapes(spark, sf_dir):
    """Of pairs of turned and holed shapes, how the area of what they have in common differs from the shared area that their relation states."""
    layer = D.plots(spark, sf_dir)
    pairs = topology.polygon_pairs(layer).select(F.col("a").alias("feature_pos"), F.col("b").alias("related_pos"), "shared")
    shapes = districts.overlap_shapes(layer, pairs)
    return shapes.select("feature_pos", "related_pos", F.round(F.abs(G.area(F.col("geometry")) - F.col("shared")), 6).alias("difference"), F.size("geometry.parts").alias("parts"))


@query(f"WITH z AS (SELECT {KEY} AS key, fid, (x1 - x0) * (y1 - y0) AS area FROM ({D.ZONES_SQL})) SELECT key, (array_agg(fid ORDER BY area DESC, fid))[1] AS feature_pos, count(*) AS n_features, max(area) AS largest_area FROM z GROUP BY key")
def dma_dissolve(spark, sf_dir):
    return districts.dissolve(D.zones(spark, sf_dir), "dma_name")


# issues and what follows from them


def layer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row checks over points and pipes, as one table of issues."""
    points, pipes = D.asset_points(spark, sf_dir), D.pipes(spark, sf_dir)
    checks = [rows.null_geometry(points), rows.duplicate_vertex(pipes), rows.coordinate_precision(pipes, 3), rows.domain(pipes, "status", {"O", "F"})]
    raw = checks[0]
    for check in checks[1:]:
        raw = raw.unionByName(check)
    return issues.finished(raw)


ISSUES = f"""p AS ({D.PIPES_SQL}), q AS ({D.POINTS_SQL}), i AS (
    SELECT 'null_geometry' AS problem_name, fid, 'critical' AS severity, 'geometry' AS category, 'Completeness' AS iso_category, 100 AS priority_score, true AS actionable FROM q WHERE missing
    UNION ALL SELECT 'duplicate_vertex', fid, 'medium', 'geometry', 'Logical Consistency', 50, true FROM p WHERE again
    UNION ALL SELECT 'coordinate_precision_not_fit_for_use', fid, 'low', 'accuracy', 'Positional Accuracy', 7, false FROM p WHERE NOT across AND fid % 23 = 0
    UNION ALL SELECT 'domain_violation', fid, 'medium', 'attributes', 'Thematic Accuracy', 40, true FROM p WHERE status NOT IN ('O', 'F'))"""
BAND = "CASE WHEN priority_score >= 80 THEN 'critical' WHEN priority_score >= 60 THEN 'high' WHEN priority_score >= 35 THEN 'medium' ELSE 'low' END"


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the row checks, summarised."""
    return issues.summary(layer_issues(spark, sf_dir))


@query(f"WITH {ISSUES} SELECT problem_name, fid AS feature_id, severity, priority_score, iso_category, actionable FROM i")
def issue_rows(spark, sf_dir):
    return layer_issues(spark, sf_dir).select("problem_name", "feature_id", "severity", "priority_score", "iso_category", "actionable")


@query(f"""WITH {ISSUES}, d AS (SELECT unnest([{{'dimension': 'problem_name', 'value': problem_name}}, {{'dimension': 'severity', 'value': severity}}, {{'dimension': 'issue_class', 'value': 'data_issue'}}, {{'dimension': 'validator_name', 'value': problem_name}},
    {{'dimension': 'iso_category', 'value': iso_category}}, {{'dimension': 'root_cause', 'value': category}}, {{'dimension': 'priority_band', 'value': {BAND}}}], recursive := true) FROM i)
    SELECT dimension, value, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM i), 2) AS percent FROM d GROUP BY 1, 2""")
def issue_summary(spark, sf_dir):
    return FLAGSHIP(spark, sf_dir)


@query(f"WITH {ISSUES} SELECT problem_name, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, problem_name LIMIT 5")
def issue_top_problems(spark, sf_dir):
    return layer_issues(spark, sf_dir).groupBy("problem_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "problem_name").limit(5)


@query(f"WITH {ISSUES} SELECT problem_name, fid AS feature_id, priority_score FROM i WHERE actionable ORDER BY priority_score DESC, problem_name, fid::VARCHAR LIMIT 5")
def issue_top_actionable(spark, sf_dir):
    ranked = layer_issues(spark, sf_dir).where("actionable").orderBy(F.desc("priority_score"), "problem_name", F.col("feature_id").cast("string"))
    return ranked.limit(5).select("problem_name", "feature_id", "priority_score")


POLICIES = issues.Policies(
    severity_overrides={"duplicate_vertex": "low"}, downgrades={"null_geometry": "high"},
    problems=(issues.Policy("domain_violation", priority_score=3, actionable=False), issues.Policy("coordinate_precision_not_fit_for_use", suppress=True, reason="Known.")),
)


@query(f"""WITH {ISSUES} SELECT problem_name, fid AS feature_id, CASE problem_name WHEN 'duplicate_vertex' THEN 'low' WHEN 'null_geometry' THEN 'high' ELSE severity END AS severity,
    CASE WHEN problem_name = 'domain_violation' THEN 3 ELSE priority_score END AS priority_score, problem_name <> 'domain_violation' AND actionable AS actionable,
    problem_name = 'coordinate_precision_not_fit_for_use' AS suppressed, CASE WHEN problem_name = 'coordinate_precision_not_fit_for_use' THEN 'Known.' END AS suppression_reason FROM i""")
def issue_policies(spark, sf_dir):
    kept = issues.apply_policies(layer_issues(spark, sf_dir), POLICIES, "example")
    return kept.select("problem_name", "feature_id", "severity", "priority_score", "actionable", "suppressed", "suppression_reason")


PENALTY = "CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 0.85 WHEN 3 THEN 0.6 WHEN 2 THEN 0.35 ELSE 0.15 END"
SCORE = "greatest(0, round_even(1 - {0} - least(0.05 * {1}, 0.5), 4))::DOUBLE"


@query(f"WITH {ISSUES} SELECT {SCORE.format(PENALTY, 'count(*)')} AS conservative, {SCORE.format(PENALTY, 'count(*) FILTER (WHERE actionable)')} AS ml_ready, count(*) AS n, count(*) FILTER (WHERE actionable) AS n_actionable FROM i")
def issue_scores(spark, sf_dir):
    return issues.layer_scores(layer_issues(spark, sf_dir))


@query(f"""WITH {ISSUES} SELECT fid AS feature_id, count(*) AS issue_count, array_to_string(list_sort(list_distinct(array_agg(problem_name))), ',') AS problem_names,
    CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity, {SCORE.format(PENALTY, 'count(*)')} AS quality_score FROM i GROUP BY fid""")
def ml_feature_summary(spark, sf_dir):
    return features.by_feature(layer_issues(spark, sf_dir)).withColumn("problem_names", F.array_join("problem_names", ","))


@query(f"WITH {ISSUES} SELECT fid AS feature_id, max((problem_name = 'null_geometry')::INT) AS qa_problem_null_geometry, max((problem_name = 'duplicate_vertex')::INT) AS qa_problem_duplicate_vertex FROM i GROUP BY fid")
def ml_indicators(spark, sf_dir):
    return features.indicators(layer_issues(spark, sf_dir), ["null_geometry", "duplicate_vertex"])


@query(f"WITH p AS ({D.PIPES_SQL}) SELECT fid AS feature_id, again AS qa_has_issue, again::BIGINT AS qa_issue_count, CASE WHEN again THEN 'medium' END AS qa_max_severity, CASE WHEN again THEN 0.6 ELSE 1.0 END AS qa_quality_score FROM p")
def ml_annotate(spark, sf_dir):
    pipes = D.pipes(spark, sf_dir)
    marked = features.annotated(pipes, issues.finished(rows.duplicate_vertex(pipes)))
    return marked.select("feature_id", "qa_has_issue", "qa_issue_count", "qa_max_severity", "qa_quality_score")


# repairs


@query(f"SELECT fid AS feature_id FROM ({D.POINTS_SQL}) WHERE NOT missing")
def fix_drop_null(spark, sf_dir):
    return repairs.drop_null_geometries(D.asset_points(spark, sf_dir)).select("feature_id")


@query(f"SELECT fid AS feature_id, 2 + bend::INT AS n_vertices FROM ({D.PIPES_SQL})")
def fix_dedupe_vertices(spark, sf_dir):
    return repairs.remove_duplicate_vertices(D.pipes(spark, sf_dir)).select("feature_id", G.vertex_count(F.col("geometry")).alias("n_vertices"))


@query(f"SELECT fid AS feature_pos, 'changed' AS change FROM ({D.PIPES_SQL}) WHERE again")
def fix_changes(spark, sf_dir):
    pipes = D.pipes(spark, sf_dir)
    return repairs.changes(pipes, repairs.apply_repairs(pipes))


# vectors


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS denominator, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS top FROM embeddings")
def vec_softmax(spark, sf_dir):
    top = F.array_max(features.softmax(F.col("embedding")))
    return D.table(spark, sf_dir, "embeddings").select("vec_id", F.round(1 / top, 6).alias("denominator"), F.round(top, 6).alias("top"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, e.vec_id, round(list_sum(list_transform(list_zip(q, e.embedding), lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2))), 5) AS distance FROM q, embeddings e""")
def vec_pairwise_sqdist(spark, sf_dir):
    """Every hundredth vector against all: blocks of rows meet chunks of queries."""
    rows_ = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return features.squared_distances(rows_, rows_.where("id % 100 = 0")).withColumn("distance", F.round("distance", 5))


# files, profiles, streams


@query(f"SELECT fid AS feature_id, CASE WHEN missing THEN NULL ELSE '{{\"type\":\"Point\",\"coordinates\":[' || x || ',' || y || ']}}' END AS geometry FROM ({D.POINTS_SQL})")
def io_geojson_rows(spark, sf_dir):
    return D.asset_points(spark, sf_dir).select("feature_id", codecs.geojson(F.col("geometry")).alias("geometry"))


@query(f"SELECT fid AS feature_id, 2 + again::INT + bend::INT AS n_vertices, sx AS minx, greatest(sy + CASE WHEN bend THEN 0.125 ELSE 0 END, ey) AS maxy FROM ({D.PIPES_SQL})")
def io_geojson_round_trip(spark, sf_dir):
    """Pipes written as GeoJSON lines to the shared folder and read again."""
    path = f"{storage.shared_folder(spark, 'geojson')}/pipes"
    readers.write_layer(D.pipes(spark, sf_dir).select("feature_pos", "feature_id", "geometry", "status"), path, "geojson")
    back, g = readers.read_geojson_lines(spark, path), F.col("geometry")
    return back.select(F.col("feature_id").cast("long"), G.vertex_count(g).alias("n_vertices"), G.bounds(g)["minx"].alias("minx"), G.bounds(g)["maxy"].alias("maxy"))


@query(f"SELECT fid AS feature_id, 'Polygon' AS type, (x1 - x0) * (y1 - y0) AS area FROM ({D.ZONES_SQL})")
def io_csv_round_trip(spark, sf_dir):
    """Zones written as CSV with well-known text to the shared folder and read again."""
    path = f"{storage.shared_folder(spark, 'csv')}/zones"
    readers.write_layer(D.zones(spark, sf_dir).select("feature_pos", "feature_id", "geometry", "dma_name"), path, "csv")
    back, _ = readers.read_csv(spark, path)
    return back.select(F.col("source_id").cast("long").alias("feature_id"), "geometry.type", G.area(F.col("geometry")).alias("area"))


@query(f"SELECT x::DOUBLE AS x, y::DOUBLE AS y, fid % 7 / 4.0 AS z, (fid % 65536)::INT AS intensity, (district % 32)::INT AS classification, count(*) AS n FROM ({D.POINTS_SQL}) WHERE NOT missing GROUP BY ALL")
def io_las_round_trip(spark, sf_dir):
    """The customers' points written as LAS files to the shared folder and read in ranges of 1,000 records."""
    path = f"{storage.shared_folder(spark, 'las')}/points"
    c = F.get(G.coords(F.col("geometry")), F.lit(0))
    raised = G.single_part("Point", F.array(G.coord(c["x"], c["y"], F.col("feature_pos") % 7 / 4)))
    points = D.asset_points(spark, sf_dir).withColumn("geometry", F.when(F.col("geometry").isNotNull(), raised))
    las.write_las(points.withColumns({"intensity": F.col("feature_pos") % 65536, "classification": F.col("district") % 32}).repartition(3), path)
    back, _ = las.read_las(spark, path, ("intensity", "classification"), rows=1000)
    return back.select(c["x"].alias("x"), c["y"].alias("y"), F.round(c["z"], 6).alias("z"), "intensity", "classification").groupBy("x", "y", "z", "intensity", "classification").agg(F.count(F.lit(1)).alias("n"))


META = layers.LayerMeta("pipes", "orders", crs=None)


@query(f"""WITH {ISSUES} SELECT 'duplicate_vertex' AS problem_name, 'duplicate_vertex' AS validator_name, fid::VARCHAR AS feature_id, 'medium' AS severity FROM p WHERE again
    UNION ALL SELECT 'missing_spatial_reference', 'missing_crs', NULL, 'critical' UNION ALL SELECT 'missing_or_stale_spatial_index', 'missing_spatial_index', NULL, 'medium'""")
def profile_issues(spark, sf_dir):
    """generic_quick over the pipes, whose lines are simple and whose reference system is not declared."""
    found_, _ = profiles.run_profile(D.pipes(spark, sf_dir), META, "generic_quick")
    return found_.select("problem_name", "validator_name", "feature_id", "severity")


@query("""SELECT * FROM (VALUES ('null_geometry', 'completed', NULL), ('duplicate_vertex', 'completed', NULL), ('self_intersection', 'skipped', 'incompatible_geometry_type'), ('missing_crs', 'completed', NULL), ('invalid_crs', 'completed', NULL),
    ('coordinate_precision', 'completed', NULL), ('xy_tolerance', 'completed', NULL), ('missing_spatial_index', 'completed', NULL), ('outdated_index', 'completed', NULL), ('polygon_overlap_same_layer', 'skipped', 'incompatible_geometry_type'),
    ('feature_within_feature', 'skipped', 'incompatible_geometry_type'), ('line_intersection_same_layer', 'skipped', 'incompatible_geometry_type')) AS t("check", status, reason) WHERE EXISTS (SELECT 1 FROM customer)""")
def profile_coverage(spark, sf_dir):
    """generic_strict over points: checks of lines and polygons are skipped."""
    _, coverage = profiles.run_profile(D.asset_points(spark, sf_dir), META, "generic_strict")
    return coverage.select("check", "status", "reason")


@query(f"SELECT fid AS feature_id, CASE WHEN kind = 2 AND i = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS type, CASE WHEN kind = 2 AND i = 0 THEN 2.0 WHEN i = 0 THEN 4.0 ELSE 1.0 END AS area FROM ({D.PLOTS_SQL})")
def fix_make_valid(spark, sf_dir):
    """Two shapes for each part: a square, for one in four a bow tie whose two triangles are parted; and a unit square."""
    p, x, y = F.col("p_partkey"), F.col("p_partkey") % 40 * 10, F.floor(F.col("p_partkey") / 40) * 10
    bow = G.single_part("Polygon", F.array(G.coord(x, y), G.coord(x + 2, y + 2), G.coord(x + 2, y), G.coord(x, y + 2), G.coord(x, y)))
    shapes = F.array(F.when(p % 4 == 2, bow).otherwise(G.rectangle(x, y, x + 2, y + 2)), G.rectangle(x, y, x + 1, y + 1))
    made = D.table(spark, sf_dir, "part").select(p.alias("part"), F.posexplode(shapes).alias("i", "geometry")).select((F.col("part") * 2 + F.col("i")).alias("feature_id"), "geometry")
    fixed = repairs.make_geometries_valid(made)
    return fixed.select("feature_id", "geometry.type", F.round(G.area(F.col("geometry")), 6).alias("area"))


# looking up


GLOBE = "SELECT c_custkey AS fid, c_custkey % 360 - 180 AS lon, c_custkey % 161 - 80 AS lat FROM customer"


def globe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each customer, all over the globe up to 80 degrees."""
    k = F.col("c_custkey")
    return D.table(spark, sf_dir, "customer").select(k.alias("feature_pos"), k.alias("feature_id"), G.point(k % 360 - 180, k % 161 - 80).alias("geometry"))


def placed(layer: DataFrame, digits: int) -> DataFrame:
    at = F.get(G.coords(F.col("geometry")), F.lit(0))
    return layer.select("feature_id", (F.round(at["x"], digits) + 0.0).alias("x"), (F.round(at["y"], digits) + 0.0).alias("y"))


@query(f"SELECT fid AS feature_id, round(radians(lon) * 6378137.0, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) + 0.0 AS y FROM ({GLOBE})")
def crs_to_mercator(spark, sf_dir):
    fixed, _ = lookups.fix_crs(globe(spark, sf_dir), layers.LayerMeta(crs="EPSG:4326"), "EPSG:3857")
    return placed(fixed, 3)


@query(f"SELECT fid AS feature_id, lon + 0.0 AS x, lat + 0.0 AS y FROM ({GLOBE}) WHERE lon BETWEEN 12 AND 18 AND lat >= 0")
def crs_utm_round_trip(spark, sf_dir):
    """Zone 33 and back, over the points in it."""
    meta = layers.LayerMeta(crs="EPSG:4326")
    there, meta = lookups.fix_crs(globe(spark, sf_dir).where("feature_pos % 360 - 180 between 12 and 18 and feature_pos % 161 - 80 >= 0"), meta, "EPSG:32633")
    return placed(lookups.fix_crs(there, meta, "EPSG:4326")[0], 6)


@query(f"""WITH {ISSUES}, hit AS (SELECT fid FROM p WHERE again) SELECT h.fid AS asked, min(q.fid) AS feature_pos FROM hit h JOIN p q ON q.fid IN (h.fid, h.fid - 1) GROUP BY h.fid""")
def issue_feature_lookup(spark, sf_dir):
    """Repeated vertices, each with the feature it is about: by identifier, or the place before it."""
    pipes_ = D.pipes(spark, sf_dir)
    found_ = issues.finished(rows.duplicate_vertex(pipes_))
    return lookups.issue_features(pipes_, found_).join(found_.select("issue_id", F.col("feature_id").alias("asked")), "issue_id").select("asked", "feature_pos")


@query(f"WITH p AS (SELECT fid, x, y, status, min(fid) OVER (PARTITION BY x, y) AS a FROM ({D.POINTS_SQL}) WHERE NOT missing), b AS (SELECT p.fid AS b, p.a, p.status AS r, q.status AS l FROM p JOIN p q ON q.fid = p.a WHERE p.fid > p.a) SELECT a, b, 'status' AS field, l AS \"left\", r AS \"right\", l <> r AS differs FROM b")
def issue_side_by_side(spark, sf_dir):
    """The status of points that stand in one place, each beside the first there."""
    points = D.asset_points(spark, sf_dir).where("geometry is not null")
    first = points.groupBy(G.wkt(F.col("geometry")).alias("w")).agg(F.min("feature_pos").alias("a"))
    pairs = points.select(F.col("feature_pos").alias("b"), G.wkt(F.col("geometry")).alias("w")).join(first, "w").where("b > a")
    return lookups.side_by_side(points.select("feature_pos", "geometry", "status"), pairs)


@query(f"SELECT count(*) AS row_count, count(*) FILTER (WHERE NOT missing) AS points, count(*) FILTER (WHERE missing) AS none FROM ({D.POINTS_SQL})")
def layer_signature(spark, sf_dir):
    found_ = lookups.signature(D.asset_points(spark, sf_dir), META)
    return found_.select("row_count", F.col("geometry_types")["Point"].alias("points"), F.col("geometry_types")["None"].alias("none"))


@query("SELECT count(*) AS datasets, (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(DISTINCT p_type) FROM part) AS checks, sum(p_size)::BIGINT AS issues FROM part")
def gallery_stats(spark, sf_dir):
    """The parts as datasets: brand and type as the checks that found something, the size as the number of issues."""
    parts = D.table(spark, sf_dir, "part")
    return lookups.gallery(parts.select(F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("checks"), F.col("p_size").alias("issue_count")))


@query("""SELECT p_name AS problem_name, 'unknown severity' AS error FROM part WHERE p_size % 5 = 4 UNION ALL SELECT p_name, 'no severity' FROM part WHERE p_size % 5 = 3
    UNION ALL SELECT p_name, 'repeated name' FROM part GROUP BY p_name HAVING count(*) > 1""")
def catalog_check(spark, sf_dir):
    """The parts as a catalog of problems, with severities by size."""
    size = F.col("p_size") % 5
    severity = F.when(size == 0, "low").when(size == 1, "medium").when(size == 2, "high").when(size == 4, "fatal")
    return lookups.catalog_errors(D.table(spark, sf_dir, "part").select(F.col("p_name").alias("problem_name"), F.lit("geometry").alias("category"), severity.alias("severity")))


@query("SELECT p_partkey AS part, trim(regexp_replace(p_type || '/' || p_brand || '.', '[^A-Za-z0-9_.-]+', '_', 'g'), '._') AS slug FROM part")
def text_slug(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), lookups.slug(F.concat("p_type", F.lit("/"), "p_brand", F.lit("."))).alias("slug"))


@query(f"SELECT fid AS feature_pos, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y, x1 - x0 AS width, y1 - y0 AS height, false AS is_point FROM ({D.ZONES_SQL})")
def shape_frames(spark, sf_dir):
    return lookups.frames_of(D.zones(spark, sf_dir))


def counted(issues_: DataFrame) -> DataFrame:
    return issues_.where("not suppressed").groupBy("problem_name", "severity", "priority_score").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'polygon_overlap_same_layer' AS problem_name, 'critical' AS severity, 9 AS priority_score, sum(3 + CAST(s_suppkey % 2 = 0 AS INT))::BIGINT AS n FROM supplier
    UNION ALL SELECT 'polygon_gap_same_layer', 'high', 8, count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'missing_spatial_reference', 'critical', 100, 1""")
def profile_boundaries(spark, sf_dir):
    """boundaries_quick over the frames, whose sides overlap at the corners and leave a gap between four."""
    found_, _ = profiles.run_profile(D.frames(spark, sf_dir), META, "boundaries_quick")
    return counted(found_)


@query(f"""WITH {PAIRS} SELECT 'domain_violation' AS problem_name, 'high' AS severity, 8 AS priority_score, count(*) AS n FROM part WHERE p_size % 5 NOT IN (1, 2, 3)
    UNION ALL SELECT 'polygon_overlap_same_layer', 'high', 8, count(DISTINCT fid) FROM (SELECT unnest([a, b]) AS fid FROM pairs WHERE shared > 0 AND shared < area_a AND shared < area_b)
    UNION ALL SELECT 'missing_spatial_reference', 'critical', 100, 1""")
def profile_land_use(spark, sf_dir):
    """land_use_quick over the zones with a code for each part's size."""
    sizes = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_pos"), (F.col("p_size") % 5).alias("zoning"))
    found_, _ = profiles.run_profile(D.zones(spark, sf_dir).join(sizes.hint("merge"), "feature_pos"), META, "land_use_quick")
    return counted(found_)


@query(f"""WITH {ENDS}, {CROSSING.removeprefix(f"p AS ({D.PIPES_SQL}), ")}, hit AS (SELECT count(DISTINCT fid) AS n FROM (SELECT a AS fid FROM c UNION ALL SELECT b FROM c))
    SELECT 'domain_violation' AS problem_name, 'medium' AS severity, 6 AS priority_score, count(*) AS n FROM p
    UNION ALL SELECT 'duplicate_vertex', 'medium', 7, count(*) FROM p WHERE again
    UNION ALL SELECT 'line_dangle', 'medium', 6, count(*) FROM loose WHERE n >= 1 UNION ALL SELECT 'isolated_network_segment', 'high', 8, count(*) FROM loose WHERE n >= 2
    UNION ALL SELECT 'line_intersection_same_layer', 'high', 8, n FROM hit UNION ALL SELECT 'feature_not_split_at_intersection', 'high', 8, n FROM hit
    UNION ALL SELECT 'missing_spatial_reference', 'critical', 100, 1""")
def profile_water_network(spark, sf_dir):
    """water_network_quick over the pipes; the two checks of near ends have queries of their own."""
    profile = profiles.PROFILES["water_network_quick"]
    own = profiles.Profile("water_network_quick", tuple(c for c in profile.checks if "endpoints" not in c), profile.options, profile.policies, profile.context)
    found_, _ = profiles.run_profile(D.pipes(spark, sf_dir), META, own)
    return counted(found_)


AUDITED = f"""i AS ({D.INVENTORY_SQL}), f AS (SELECT layer_id, layer_id % 3 AS kind, layer_id % 13 = 0 AS bare FROM i), t AS (
    SELECT layer_id, 'null_geometry' AS problem_name, 1 AS n FROM f WHERE kind = 0 AND NOT bare UNION ALL SELECT layer_id, 'duplicate_geometry_same_layer', 2 FROM f WHERE kind = 0 AND NOT bare
    UNION ALL SELECT layer_id, 'duplicate_vertex', 1 FROM f WHERE kind = 1 AND NOT bare UNION ALL SELECT layer_id, 'line_intersection_same_layer', 2 FROM f WHERE kind = 1 AND NOT bare
    UNION ALL SELECT layer_id, 'feature_not_split_at_intersection', 2 FROM f WHERE kind = 1 AND NOT bare UNION ALL SELECT layer_id, 'line_dangle', 4 FROM f WHERE kind = 1 AND NOT bare
    UNION ALL SELECT layer_id, 'polygon_overlap_same_layer', 4 FROM f WHERE kind = 2 AND NOT bare UNION ALL SELECT layer_id, 'polygon_gap_same_layer', 1 FROM f WHERE kind = 2 AND NOT bare
    UNION ALL SELECT layer_id, 'missing_spatial_reference', 1 FROM i WHERE crs IS NULL UNION ALL SELECT layer_id, 'invalid_spatial_reference', 1 FROM i WHERE crs = 'local grid' OR crs = 'EPSG:3857'
    UNION ALL SELECT layer_id, 'missing_or_stale_spatial_index', 1 FROM i WHERE index_status IN ('stale', 'missing') AND (layer_id % 3 <> 2 OR layer_id % 13 = 0)
    UNION ALL SELECT layer_id, 'outdated_attribute_or_spatial_indexes', 1 FROM i WHERE index_status = 'stale' AND (layer_id % 3 <> 2 OR layer_id % 13 = 0))"""


@query(f"WITH {AUDITED} SELECT layer_id, problem_name, n FROM t")
def audit_issues(spark, sf_dir):
    """An archive of a layer for each supplier, all checked in one plan, each by the profile its geometry suggests."""
    return audit.audit(*D.archive(spark, sf_dir), "EPSG:4326")["row_level_issues"].groupBy("layer_id", "problem_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {AUDITED} SELECT problem_name AS issue_type, CAST(sum(n) AS BIGINT) AS affected_features_count, count(*) AS layers FROM t GROUP BY 1")
def audit_issue_summary(spark, sf_dir):
    return audit.audit(*D.archive(spark, sf_dir), "EPSG:4326")["issue_summary"].select("issue_type", "affected_features_count", "layers")


@query(f"""WITH {AUDITED} SELECT i.layer_id, CASE WHEN bare THEN 0 ELSE 4 END AS feature_count, CASE WHEN NOT bare THEN CASE kind WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END END AS geometry_type,
    CASE WHEN bare THEN 'generic_quick' WHEN kind = 0 THEN 'point_asset_quick' WHEN kind = 1 THEN 'line_network_quick' ELSE 'boundaries_quick' END AS recommended_profile,
    CASE WHEN bare THEN NULL WHEN kind = 0 THEN i.layer_id WHEN kind = 1 THEN 10 ELSE 3 + i.layer_id % 3 END::DOUBLE AS maxx, CAST(coalesce((SELECT sum(n) FROM t WHERE t.layer_id = i.layer_id), 0) AS BIGINT) AS issue_count
    FROM i JOIN f ON i.layer_id = f.layer_id""")
def audit_inventory(spark, sf_dir):
    return audit.audit(*D.archive(spark, sf_dir), "EPSG:4326")["layer_inventory"].select("layer_id", "feature_count", "geometry_type", "recommended_profile", "maxx", "issue_count")


@query("SELECT s_suppkey AS layer_id, CASE s_suppkey % 5 WHEN 0 THEN 'missing' WHEN 2 THEN 'expected_crs_mismatch' WHEN 4 THEN 'expected_crs_mismatch' ELSE 'valid' END AS crs_status, s_suppkey % 5 <> 0 AS transformation_available FROM supplier")
def audit_crs_review(spark, sf_dir):
    return audit.audit(*D.archive(spark, sf_dir), "EPSG:4326")["crs_review"].select("layer_id", "crs_status", "transformation_available")


COUNTS = {
    "points": f"""WITH p AS (SELECT * FROM ({D.POINTS_SQL})), t AS (SELECT 'null_geometry' AS problem_name, count(*) AS n FROM p WHERE missing UNION ALL
        SELECT 'duplicate_geometry_same_layer', count(*) FROM (SELECT fid FROM p WHERE NOT missing QUALIFY count(*) OVER (PARTITION BY x, y) > 1) UNION ALL SELECT 'missing_spatial_reference', 1 UNION ALL SELECT 'missing_or_stale_spatial_index', 1)""",
    "pipes": f"""WITH {ENDS}, {CROSSING.removeprefix(f"p AS ({D.PIPES_SQL}), ")}, near AS (SELECT count(*) AS n {NEAR}), hit AS (SELECT count(DISTINCT fid) AS n FROM (SELECT a AS fid FROM c UNION ALL SELECT b FROM c)),
        t AS (SELECT 'duplicate_vertex' AS problem_name, count(*) AS n FROM p WHERE again UNION ALL SELECT 'line_dangle', count(*) FROM loose WHERE n >= 1 UNION ALL SELECT 'isolated_network_segment', count(*) FROM loose WHERE n >= 2
        UNION ALL SELECT 'line_intersection_same_layer', n FROM hit UNION ALL SELECT 'feature_not_split_at_intersection', n FROM hit UNION ALL SELECT 'domain_violation', count(*) FROM p
        UNION ALL SELECT 'suspicious_near_miss_endpoints', n FROM near
        UNION ALL SELECT 'unsnapped_endpoints_within_tolerance', count(*) {NEAR} AND (SELECT degree FROM deg WHERE x = a.ex AND y = a.ey) <= 1 AND (SELECT degree FROM deg WHERE x = b.sx AND y = b.sy) <= 1
        UNION ALL SELECT 'missing_spatial_reference', 1 UNION ALL SELECT 'missing_or_stale_spatial_index', 1)""",
    "zones": f"""WITH {PAIRS}, t AS (SELECT 'polygon_overlap_same_layer' AS problem_name, count(DISTINCT fid) AS n FROM (SELECT unnest([a, b]) AS fid FROM pairs WHERE shared > 0 AND shared < area_a AND shared < area_b)
        UNION ALL SELECT 'feature_within_feature', count(DISTINCT fid) FROM (SELECT a AS fid FROM pairs WHERE shared > 0 AND shared = area_a UNION ALL SELECT b FROM pairs WHERE shared > 0 AND shared = area_b)
        UNION ALL SELECT 'domain_violation', count(*) FROM part WHERE p_size % 5 NOT IN (1, 2, 3) UNION ALL SELECT 'missing_spatial_reference', 1 UNION ALL SELECT 'missing_or_stale_spatial_index', 1)""",
    "frames": """WITH t AS (SELECT 'polygon_overlap_same_layer' AS problem_name, sum(3 + CAST(s_suppkey % 2 = 0 AS INT))::BIGINT AS n FROM supplier UNION ALL SELECT 'polygon_gap_same_layer', count(*) FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'missing_spatial_reference', 1 UNION ALL SELECT 'missing_or_stale_spatial_index', 1)""",
}
#: The profiles that the queries above leave, each with a layer and what it must find there; near ends within 0.1 of the layer's units.
NETWORK_PROBLEMS = ("duplicate_vertex", "line_dangle", "isolated_network_segment", "line_intersection_same_layer", "feature_not_split_at_intersection", "domain_violation", "suspicious_near_miss_endpoints", "unsnapped_endpoints_within_tolerance", "missing_spatial_reference")
WHOLE_PROFILES = {
    "geometry": ("points", ("null_geometry",)),
    "point_asset_quick": ("points", ("null_geometry", "duplicate_geometry_same_layer", "missing_spatial_reference", "missing_or_stale_spatial_index")),
    "line_network_quick": ("pipes", ("duplicate_vertex", "line_intersection_same_layer", "feature_not_split_at_intersection", "line_dangle", "missing_spatial_reference", "missing_or_stale_spatial_index")),
    "generic_strict": ("zones", ("polygon_overlap_same_layer", "feature_within_feature", "missing_spatial_reference", "missing_or_stale_spatial_index")),
    "generic_audit": ("pipes", ("duplicate_vertex", "line_intersection_same_layer", "missing_spatial_reference", "missing_or_stale_spatial_index")),
    **{f"water_network{variant}": ("pipes", NETWORK_PROBLEMS) for variant in ("_quick", "", "_strict", "_audit")},
    **{f"boundaries{variant}": ("frames", ("polygon_overlap_same_layer", "polygon_gap_same_layer", "missing_spatial_reference", "missing_or_stale_spatial_index")) for variant in ("", "_strict", "_audit")},
    **{f"land_use{variant}": ("zones", ("domain_violation", "polygon_overlap_same_layer", "feature_within_feature", "missing_spatial_reference", *(("missing_or_stale_spatial_index",) if variant == "_audit" else ()))) for variant in ("", "_strict", "_audit")},
}
NEAR_ENDS = {name: {"tolerance": 0.1} for name in ("suspicious_near_miss_endpoints", "unsnapped_endpoints_within_tolerance")}


def _coded_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_pos"), (F.col("p_size") % 5).alias("zoning"))
    return D.zones(spark, sf_dir).join(sizes.hint("merge"), "feature_pos")


def _whole_profile(profile: str, layer: str):
    make = {"points": D.asset_points, "pipes": D.pipes, "zones": _coded_zones, "frames": D.frames}[layer]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found_, _ = profiles.run_profile(make(spark, sf_dir), META, profile, NEAR_ENDS)
        return found_.groupBy("problem_name").agg(F.count(F.lit(1)).alias("n"))

    return run


for name_, (layer_, problems_) in WHOLE_PROFILES.items():
    QUERIES[f"profile_all_{name_}"] = _whole_profile(name_, layer_)
    ORACLES[f"profile_all_{name_}"] = f"{COUNTS[layer_]} SELECT problem_name, n FROM t WHERE n > 0 AND problem_name IN ({', '.join(map(repr, problems_))})"


@query("""SELECT * FROM (SELECT 'self_intersection' AS problem_name, 'high' AS severity, 75 AS priority_score, count(*) AS n FROM orders WHERE o_orderkey % 997 = 0
    UNION ALL SELECT 'duplicate_vertex', 'medium', 50, count(*) FROM orders WHERE o_orderkey % 1349 = 0 UNION ALL SELECT 'missing_spatial_reference', 'critical', 100, 1 UNION ALL SELECT 'missing_or_stale_spatial_index', 'medium', 40, 1) WHERE n > 0""")
def profile_roads(spark, sf_dir):
    """generic_quick over long winding lines."""
    found_, _ = profiles.run_profile(D.roads(spark, sf_dir), META, "generic_quick")
    return counted(found_)


@query(f"SELECT 'null_geometry' AS problem_name, fid AS feature_id, 100 AS priority_score FROM ({D.POINTS_SQL}) WHERE missing")
def stream_null_geometry(spark, sf_dir):
    """The customers as a stream, checked batch by batch."""
    schema = D.table(spark, sf_dir, "customer").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/customer.parquet*")  # a pattern, as the table may be one file
    found_ = checks.issue_stream(D.points_of(source), rows.null_geometry)
    return checks.run_available(found_.select("problem_name", "feature_id", "priority_score"), "stream")


@query(f"WITH p AS ({D.PIPES_SQL}), n AS (SELECT a.fid AS a, b.fid AS b, a.ex AS ax, a.ey AS ay, b.sx AS bx, b.sy AS by_ {NEAR}) SELECT a AS feature_pos, unnest(['endpoint', 'endpoint', 'gap']) AS role, unnest(['POINT (' || {NUM.format('ax')} || ' ' || {NUM.format('ay')} || ')', 'POINT (' || {NUM.format('bx')} || ' ' || {NUM.format('by_')} || ')', 'LINESTRING (' || {NUM.format('ax')} || ' ' || {NUM.format('ay')} || ', ' || {NUM.format('bx')} || ' ' || {NUM.format('by_')} || ')']) AS wkt FROM n")
def net_endpoint_overlay(spark, sf_dir):
    """For each near miss its two ends and the gap between them, as shapes to draw."""
    return network.endpoint_overlay(D.pipes(spark, sf_dir), 0.1)


@query(f"""WITH {ISSUES} SELECT problem_name, count(*) AS n, (array_agg(fid::VARCHAR ORDER BY fid::VARCHAR))[1] AS first_feature, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' ELSE 'low' END AS worst FROM i GROUP BY 1""")
def issue_groups(spark, sf_dir):
    """Issues grouped for review: how many, an example and the worst severity of each problem."""
    rank = issues.lookup(features.RANK, F.col("severity"), 0)
    return layer_issues(spark, sf_dir).groupBy("problem_name").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("feature_id").cast("string")).alias("first_feature"), F.max_by("severity", rank).alias("worst"))


@query(f"""WITH {ISSUES} SELECT problem_name, fid AS feature_id, CASE problem_name WHEN 'null_geometry' THEN 'A record has no shape.' WHEN 'duplicate_vertex' THEN 'Two neighbouring vertices of the feature are the same.'
    WHEN 'domain_violation' THEN 'Value of status is outside its domain: P' ELSE 'Coordinates have 4 decimals, more than 3.' END AS what,
    CASE problem_name WHEN 'null_geometry' THEN 'Restore the shape or drop the record.' ELSE 'Review the feature.' END AS action FROM i""")
def issue_explained(spark, sf_dir):
    return report.explained(layer_issues(spark, sf_dir)).select("problem_name", "feature_id", "what", "action")


@query(f"WITH {ISSUES} SELECT problem_name, fid AS feature_id, count(*) AS n FROM i GROUP BY 1, 2")
def issue_examples(spark, sf_dir):
    return report.grouped_examples(layer_issues(spark, sf_dir)).select("problem_name", "feature_id", "n")
