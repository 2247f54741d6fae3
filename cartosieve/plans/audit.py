"""An audit of many layers in one plan: every check runs once over the features of all layers, keyed by layer_id.

What a layer's profile asks for, and with which options, is a table joined to the features, not a plan of its own; pairs of features meet within one layer only. The
result is eight tables, each a DataFrame, so that an archive of any number of layers takes as many jobs as one of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G
from cartosieve.functions.storage import checkpointed
from cartosieve.operators import layers as L
from cartosieve.operators import rows, topology
from cartosieve.plans import issues as I
from cartosieve.plans import profiles, report

RAW = "problem_name string, validator string, layer_id long, feature_pos long, feature_id string, geometry string, description string"
#: Checks of an inventory's own columns, by the profile checks they belong to.
OF_LAYERS = {"missing_spatial_reference": "missing_crs", "invalid_spatial_reference": "invalid_crs", "missing_or_stale_spatial_index": "missing_spatial_index", "outdated_attribute_or_spatial_indexes": "outdated_index"}
OF_FEATURES = ("null_geometry", "duplicate_vertex", "below_minimum_feature_length", "sharp_angle_cutback", "coordinate_precision", "self_intersection", "duplicate_geometry_same_layer", "polygon_overlap_same_layer", "feature_within_feature", "line_intersection_same_layer", "feature_not_split_at_intersection", "polygon_gap_same_layer", "line_dangle", "isolated_network_segment")


def planned(spark: SparkSession) -> DataFrame:
    """(profile, check, kinds, in_audit, options): what each profile asks for; a fixed table."""
    known = {*OF_FEATURES, *OF_LAYERS.values()}
    options = {"below_minimum_feature_length": "min_length", "sharp_angle_cutback": "min_degrees", "coordinate_precision": "max_decimals"}
    defaults = {"min_length": 0.0, "min_degrees": 15.0, "max_decimals": 9.0}
    made = []
    for p in profiles.PROFILES.values():
        for check in p.checks:
            of = options.get(check)
            value = p.options.get(check, {}).get(of)
            made.append((p.name, check, list(profiles.CHECKS[check].kinds), check in known, float(defaults[of] if value is None else value) if of else None))
    return spark.createDataFrame(made, "profile string, check string, kinds array<string>, in_audit boolean, option double")


def inventory(layers: DataFrame, features: DataFrame) -> DataFrame:
    """layers with feature_count, geometry_type (the most frequent, of equal ones the first by name), geometry_types, the bounds and the recommended profile."""
    kind = features.groupBy("layer_id", F.col("geometry.type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("geometry.parts") > 0).alias("shown"), *[f(c).alias(n) for n, f, c in zip(("minx", "miny", "maxx", "maxy"), (F.min, F.min, F.max, F.max), G.bounds(F.col("geometry")).values(), strict=True)])
    own = kind.groupBy("layer_id").agg(
        F.sum("n").alias("feature_count"), F.max_by("kind", F.struct(F.col("kind").isNotNull().alias("known"), "n", F.transform(F.split("kind", ""), lambda c: -F.ascii(c)).alias("name"))).alias("geometry_type"),
        F.array_sort(F.collect_set(F.when(F.col("shown") > 0, F.col("kind")))).alias("geometry_types"), *[f(c).alias(c) for c, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))],
    )
    joined = layers.drop("geometry_type").join(own, "layer_id", "left").withColumns({"feature_count": F.coalesce("feature_count", F.lit(0).cast("long")), "geometry_types": F.coalesce("geometry_types", F.array().cast("array<string>"))})
    return joined.withColumn("recommended_profile", L.profile_for(F.col("geometry_type"), F.col("layer_name")))


def _single(features: DataFrame) -> DataFrame:
    """Checks of single features in one scan; the layer's options are columns."""
    g = F.col("geometry")
    tests = [
        ("null_geometry", g.isNull(), "null_geometry", F.lit(rows.NULL_TEXT)), ("duplicate_vertex", G.has_repeated_vertex(g), "duplicate_vertex", F.lit(rows.VERTEX_TEXT)),
        ("below_minimum_feature_length", G.is_a(g, G.LINES) & (G.planar_length(g) < F.col("below_minimum_feature_length")), "below_minimum_feature_length", F.lit("The line is shorter than its layer allows.")),
        ("sharp_angle_cutback", G.is_a(g, G.LINES) & F.exists(F.flatten(F.transform(g["parts"], lambda p: G.corner_angles(p["coords"]))), lambda a: a < F.col("sharp_angle_cutback")), "sharp_angle_cutback", F.lit("The line turns back sharply.")),
        ("coordinate_precision", G.max_decimals(g) > F.col("coordinate_precision"), "coordinate_precision_not_fit_for_use", F.lit("The coordinates have more decimals than fit their use.")),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("validator"), F.lit(problem).alias("problem_name"), text.alias("description"))) for name, test, problem, text in tests]), lambda f: f.isNotNull())
    return features.select("layer_id", "feature_pos", "feature_id", "geometry", F.explode(found).alias("f")).select("f.problem_name", "f.validator", "layer_id", "feature_pos", "feature_id", G.wkt(g).alias("geometry"), "f.description")


def _hits(features: DataFrame, positions: DataFrame, check: str, text: str, problem: str | None = None) -> DataFrame:
    return features.join(positions.select("feature_pos").distinct(), "feature_pos", "left_semi").select(
        F.lit(problem or check).alias("problem_name"), F.lit(check).alias("validator"), "layer_id", "feature_pos", "feature_id", G.wkt(F.col("geometry")).alias("geometry"), F.lit(text).alias("description"))


def found_in_features(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """RAW issues of the features of all layers; wanted(layer_id, check, option) says which checks a layer has."""
    options = wanted.where("option is not null").groupBy("layer_id").pivot("check", ["below_minimum_feature_length", "sharp_angle_cutback", "coordinate_precision"]).agg(F.first("option"))
    ends = lambda c: F.explode(F.array("a", "b")).alias(c)
    asks = lambda *checks: features.join(wanted.where(F.col("check").isin(*checks)).select("layer_id").distinct(), "layer_id", "left_semi")
    pairs = checkpointed(topology.shape_pairs(asks("polygon_overlap_same_layer", "feature_within_feature"), equal=["layer_id"]))
    crossing = checkpointed(topology.crossing_pairs(asks("line_intersection_same_layer", "feature_not_split_at_intersection"), equal=["layer_id"]))
    inner = F.when(F.col("relation") == "equal", F.array("a", "b")).when(F.col("relation") == "a_within_b", F.array("a")).when(F.col("relation") == "b_within_a", F.array("b"))
    outlines = asks("self_intersection").where(G.is_a(F.col("geometry"), G.LINES) | G.is_a(F.col("geometry"), G.POLYGONS)).withColumn("hit", topology.meets_itself("geometry")).where("hit")
    shaped = features.where("geometry is not null").select("layer_id", "feature_pos", F.sha2(F.to_json("geometry"), 256).alias("shape"))
    twice = shaped.groupBy("layer_id", "shape").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    nodes = features.select("layer_id", "feature_pos", F.explode(G.endpoints(F.col("geometry"))).alias("c")).select("layer_id", "feature_pos", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))
    degree = nodes.groupBy("layer_id", "x", "y").agg(F.count(F.lit(1)).alias("degree"))
    loose = nodes.join(degree, ["layer_id", "x", "y"]).groupBy("feature_pos").agg(F.count_if(F.col("degree") <= 1).alias("loose"))
    gaps = topology.gaps(asks("polygon_gap_same_layer"), key="layer_id").select(
        F.lit("polygon_gap_same_layer").alias("problem_name"), F.lit("polygon_gap_same_layer").alias("validator"), F.col("key").cast("long").alias("layer_id"), F.lit(None).cast("long").alias("feature_pos"),
        F.concat(F.lit("gap_"), F.col("gap")).alias("feature_id"), F.col("outline").alias("geometry"), F.lit("The layer's polygons leave a gap.").alias("description"),
    )
    found = [
        _single(features.join(options, "layer_id", "left")),
        _hits(features, outlines, "self_intersection", "The feature's outline meets itself."),
        _hits(features, shaped.join(twice, ["layer_id", "shape"]), "duplicate_geometry_same_layer", "Another feature of the layer has the same geometry."),
        _hits(features, pairs.where("relation = 'partial' and shared > 0").select(ends("feature_pos")), "polygon_overlap_same_layer", "The polygon overlaps another of its layer."),
        _hits(features, pairs.select(F.explode(inner).alias("feature_pos")), "feature_within_feature", "The feature lies within another of its layer."),
        *[_hits(features, crossing.select(ends("feature_pos")), check, text) for check, text in (("line_intersection_same_layer", "The line crosses another of its layer."), ("feature_not_split_at_intersection", "The line is not split where it crosses another."))],
        _hits(features, loose.where("loose >= 1"), "line_dangle", "An end of the line meets no other line."),
        _hits(features, loose.where("loose >= 2"), "isolated_network_segment", "Neither end of the line meets another line."),
        gaps,
    ]
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union.join(wanted.select("layer_id", F.col("check").alias("validator")), ["layer_id", "validator"], "left_semi")


def _policies(spark: SparkSession) -> DataFrame:
    """What every profile says about a problem, a fixed table."""
    made = [(p.name, q.problem_name.lower(), q.severity, q.confidence, q.actionable, q.priority_score, q.suppress) for p in profiles.PROFILES.values() for q in p.policies.problems]
    return spark.createDataFrame(made, "recommended_profile string, p_name string, p_severity string, p_confidence string, p_actionable boolean, p_priority int, p_suppress boolean")


def audit(layers: DataFrame, features: DataFrame, expected: str | None = None) -> dict[str, DataFrame]:
    """layers(layer_id, layer_name, crs, index_status, title, extent) and features(layer_id, feature_pos, feature_id, geometry), positions unique over all layers -> eight tables by name.

    executive_summary, layer_inventory, issue_summary, row_level_issues, validator_coverage, crs_review, fix_plan, metadata. Each layer is checked by the profile that its geometry and name suggest;
    suppressed issues are left out. Checks that need two ends within reach, a reference layer or columns by meaning are skipped with that reason. Layers without features are checked as layers.
    """
    spark = layers.sparkSession
    features = features.withColumn("feature_id", F.col("feature_id").cast("string"))
    known = checkpointed(inventory(layers, features))
    asked = known.select("layer_id", "layer_name", "geometry_types", F.col("recommended_profile").alias("profile")).join(F.broadcast(planned(spark)), "profile")  # a fixed table
    fits = (F.size("kinds") == 0) | (F.size("geometry_types") == 0) | F.arrays_overlap("kinds", "geometry_types")
    coverage = asked.select(
        "layer_id", "layer_name", F.col("check").alias("validator_name"), F.when(fits & F.col("in_audit"), "completed").otherwise("skipped").alias("status"),
        F.when(~fits, "incompatible_geometry_type").when(~F.col("in_audit"), "not_in_audit").alias("reason"), "profile", F.col("kinds").alias("expected_geometry_types"), "option",
    )
    wanted = checkpointed(coverage.where("status = 'completed'").select("layer_id", F.col("validator_name").alias("check"), "option"))
    of_layer = F.create_map(*[F.lit(x) for pair in OF_LAYERS.items() for x in pair])
    named = L.inventory_issues(known).select("layer_id", "problem_name").where(F.col("problem_name").isin(*OF_LAYERS)).withColumn("validator", of_layer[F.col("problem_name")])
    if expected:
        other = known.where(L.epsg_of(F.col("crs")).isNotNull() & (L.epsg_of(F.col("crs")) != L.epsg_code(expected))).select("layer_id", F.lit("invalid_spatial_reference").alias("problem_name"), F.lit("invalid_crs").alias("validator"))
        named = named.union(other)
    whole = named.join(wanted.select("layer_id", F.col("check").alias("validator")), ["layer_id", "validator"], "left_semi").select(
        "problem_name", "validator", "layer_id", F.lit(None).cast("long").alias("feature_pos"), F.lit(None).cast("string").alias("feature_id"), F.lit(None).cast("string").alias("geometry"), F.lit("The layer as a whole.").alias("description"))
    finished = I.finished(found_in_features(features, wanted).unionByName(whole), validator=F.col("validator")).drop("validator")
    judged = finished.join(known.select("layer_id", "layer_name", "recommended_profile"), "layer_id").withColumn("p_name", F.lower("problem_name"))
    judged = judged.join(F.broadcast(_policies(spark)), ["recommended_profile", "p_name"], "left").where("not coalesce(p_suppress, false)").withColumns({  # a fixed table
        "severity": F.coalesce("p_severity", "severity"), "confidence": F.coalesce("p_confidence", "confidence"), "actionable": F.coalesce("p_actionable", "actionable"), "priority_score": F.coalesce("p_priority", "priority_score"),
    }).drop("p_name", "p_severity", "p_confidence", "p_actionable", "p_priority", "p_suppress")
    rows_ = checkpointed(report.explained(judged))
    counts = rows_.groupBy("layer_id").agg(F.count(F.lit(1)).alias("issue_count"))
    listed = known.join(counts, "layer_id", "left").withColumns({"issue_count": F.coalesce("issue_count", F.lit(0).cast("long")), "validated": F.lit("yes"), "status": F.lit("complete")})
    place = F.struct("layer_id", F.col("feature_pos").isNull().alias("whole"), "feature_pos", "issue_id")
    first = lambda c: F.min_by(c, place).alias(c)
    problems = rows_.groupBy(F.col("problem_name").alias("issue_type")).agg(
        first("severity"), first("confidence"), first("priority_score"), F.count(F.lit(1)).alias("affected_features_count"), F.countDistinct("layer_id").alias("layers"), first("issue_class"), first("iso_category"),
        F.min_by("category", place).alias("root_cause"), F.min_by("what", place).alias("plain_english_explanation"), F.min_by("action", place).alias("recommended_action"),
    )
    fixes = rows_.select("issue_id", "layer_name", "feature_id", "problem_name", F.col("action").alias("suggested_fix"), F.lit("no").alias("safe_to_auto_fix"), F.lit("yes").alias("requires_client_review"), F.lit("").alias("approved_by"), F.lit("no").alias("applied"))
    code = L.epsg_of(F.col("crs"))
    status = F.when(F.col("crs").isNull(), "missing").when(F.lit(L.epsg_code(expected)).isNotNull() & ~code.eqNullSafe(F.lit(L.epsg_code(expected))), "expected_crs_mismatch").otherwise("valid")
    action = F.when(status == "missing", "Confirm CRS before analysis.").when(status == "valid", "No CRS action required unless an expected CRS is configured.").otherwise("Confirm the authoritative CRS before redefining or reprojecting.")
    review = known.select("layer_id", "layer_name", F.col("crs").alias("source_crs"), F.lit(expected).cast("string").alias("expected_crs"), F.lit("EPSG:4326").alias("display_crs"), status.alias("crs_status"), F.col("crs").isNotNull().alias("transformation_available"), action.alias("action_required"))
    return {
        "executive_summary": _executive(listed, rows_), "layer_inventory": listed, "issue_summary": problems, "row_level_issues": rows_, "validator_coverage": coverage.drop("option"), "crs_review": review, "fix_plan": fixes,
        "metadata": known.select(F.lit(I.RULE_VERSION).alias("validation_rule_version"), F.col("recommended_profile").alias("profile"), F.lit(expected or "").alias("expected_crs")).groupBy("validation_rule_version", "expected_crs").agg(F.array_join(F.array_sort(F.collect_set("profile")), ", ").alias("profiles_used")),
    }


def _executive(listed: DataFrame, rows_: DataFrame) -> DataFrame:
    """(item, n): layers, features, issues, and issues by severity; what has none counts 0, what the catalog does not know is informational."""
    level = F.lower(F.coalesce("severity", F.lit("informational")))
    by = rows_.select(F.when(level.isin("critical", "high", "medium"), F.concat(level, F.lit("_issues"))).otherwise("low_or_informational_issues").alias("item"), F.lit(1).cast("long").alias("n"))
    names = [(n, 0) for n in ("critical_issues", "high_issues", "medium_issues", "low_or_informational_issues", "total_issues", "total_layers", "total_features")]
    zero = listed.sparkSession.createDataFrame(names, "item string, n long")
    total = rows_.select(F.lit("total_issues").alias("item"), F.lit(1).cast("long").alias("n"))
    of_layers = listed.select(F.explode(F.array(F.struct(F.lit("total_layers").alias("item"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("total_features").alias("item"), F.col("feature_count").alias("n")))).alias("s")).select("s.*")
    return zero.union(by).union(total).union(of_layers).groupBy("item").agg(F.sum("n").alias("n"))


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """A folder for each table, written by the tasks. In CSV, arrays and structs are JSON."""
    for name, table in tables.items():
        flat: list[Column] = [F.to_json(c).alias(c) if form == "csv" and t.startswith(("array", "struct", "map")) else F.col(c) for c, t in table.dtypes]
        table.select(*flat).write.format(form).option("header", True).save(f"{path}/{name}")
