"""Issues: one row for each finding, with what the catalog and a profile's policies say about its problem."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_VERSION = "2026.03"
RAW = ["problem_name", "feature_pos", "feature_id", "geometry", "description"]

#: Problem, category, severity, confidence, actionable. Severities of problems without a published one are this catalog's own.
CATALOG = [
    ("null_geometry", "geometry", "critical", "high", True),
    ("self_intersection", "geometry", "high", "high", True),
    ("duplicate_vertex", "geometry", "medium", "high", True),
    ("below_minimum_feature_length", "geometry", "medium", "high", True),
    ("sharp_angle_cutback", "geometry", "medium", "medium", True),
    ("null_attribute_in_required_field", "attributes", "high", "medium", True),
    ("non_unique_attribute", "attributes", "high", "medium", True),
    ("domain_violation", "attributes", "medium", "medium", True),
    ("missing_spatial_reference", "crs", "critical", "high", True),
    ("invalid_spatial_reference", "crs", "critical", "high", True),
    ("missing_metadata_title", "metadata", "medium", "medium", True),
    ("missing_metadata_abstract", "metadata", "medium", "medium", True),
    ("missing_metadata_extent", "metadata", "medium", "medium", True),
    ("missing_metadata_lineage", "metadata", "medium", "medium", True),
    ("coordinate_precision_not_fit_for_use", "accuracy", "low", "low", False),
    ("inappropriate_xy_tolerance", "accuracy", "low", "low", False),
    ("positional_accuracy_exceeds_reference_tolerance", "accuracy", "high", "medium", True),
    ("missing_or_stale_spatial_index", "integrity", "medium", "medium", True),
    ("outdated_attribute_or_spatial_indexes", "integrity", "medium", "medium", True),
    ("non_rfc7946_geojson_output", "integrity", "medium", "medium", True),
    ("polygon_overlap_same_layer", "topology", "high", "high", True),
    ("feature_within_feature", "topology", "high", "high", True),
    ("line_intersection_same_layer", "topology", "high", "high", True),
    ("feature_not_split_at_intersection", "topology", "high", "medium", True),
    ("duplicate_geometry_same_layer", "topology", "medium", "high", True),
    ("polygon_gap_same_layer", "topology", "high", "medium", True),
    ("line_dangle", "topology", "high", "medium", True),
    ("isolated_network_segment", "topology", "high", "high", True),
    ("suspicious_near_miss_endpoints", "topology", "high", "medium", True),
    ("unsnapped_endpoints_within_tolerance", "topology", "high", "high", True),
    ("boundary_mismatch_against_reference", "topology", "medium", "medium", True),
    ("dma_same_name_equal_geometry", "topology", "high", "high", True),
    ("dma_same_name_nested_polygon", "topology", "high", "high", True),
    ("dma_cross_name_equal_geometry", "topology", "high", "high", True),
    ("dma_cross_name_nested_polygon", "topology", "high", "high", True),
    ("dma_cross_name_overlap", "topology", "high", "high", True),
    ("dma_multipart_polygon", "topology", "medium", "medium", True),
    ("validation_runtime_error", "runtime", "medium", "high", True),
]
#: Fixed values.
ISO_BY_PROBLEM = {"null_geometry": "Completeness", "coordinate_precision_not_fit_for_use": "Positional Accuracy"}
ISO_BY_CATEGORY = {
    "geometry": "Logical Consistency", "topology": "Logical Consistency", "accuracy": "Positional Accuracy", "crs": "Positional Accuracy",
    "attributes": "Thematic Accuracy", "metadata": "Completeness", "integrity": "Logical Consistency",
}
SEVERITY_POINTS = {"critical": 100, "high": 75, "medium": 50, "low": 25}
CONFIDENCE_SHARE = {"high": 1.0, "medium": 0.8, "low": 0.6}
CLASS_SHARE = {"runtime_issue": 0.9, "warning": 0.75}
SEVERITY_PENALTY = {"low": 0.15, "medium": 0.35, "high": 0.6, "critical": 0.85}


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(*entry, ISO_BY_PROBLEM.get(entry[0], ISO_BY_CATEGORY.get(entry[1]))) for entry in CATALOG]
    return spark.createDataFrame(rows, "problem_name string, category string, severity string, confidence string, actionable boolean, iso_category string")


def lookup(values: dict, key: Column, default: float) -> Column:
    found = F.lit(default)
    for name, value in values.items():
        found = F.when(F.lower(key) == name, F.lit(value)).otherwise(found)
    return found


def priority_score(severity: Column, confidence: Column, actionable: Column, issue_class: Column) -> Column:
    """Whole points, halves to even."""
    points = lookup(SEVERITY_POINTS, severity, 40) * lookup(CONFIDENCE_SHARE, confidence, 0.75)
    return F.bround(points * F.when(actionable, 1.0).otherwise(0.45) * lookup(CLASS_SHARE, issue_class, 1.0), 0).cast("int")


def _json_char(c: Column) -> Column:
    """A character as JSON in ASCII has it."""
    code = F.ascii(c)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    pair = F.concat(unit(F.shiftright(code - 0x10000, 10) + 0xD800), unit((code - 0x10000) % 0x400 + 0xDC00))
    short = F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f").when(c == '"', '\\"').when(c == "\\", "\\\\")
    return F.coalesce(short, F.when((code >= 32) & (code < 128), c).when(code > 0xFFFF, pair).otherwise(unit(code)))


def _json_text(c: Column) -> Column:
    plain = F.concat(F.lit('"'), c, F.lit('"'))
    escaped = F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), _json_char), ""), F.lit('"'))
    return F.when(c.isNull(), F.lit("null")).when(c.rlike(r'^[ !#-\[\]-~]*$'), plain).otherwise(escaped)


def issue_id(description: Column, feature_id: Column, geometry: Column, problem_name: Column, numeric_id: bool) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of a JSON object with these four, keys in order."""
    id_text = F.coalesce(feature_id.cast("string"), F.lit("null")) if numeric_id else _json_text(feature_id)
    return F.substring(F.sha1(F.concat(
        F.lit('{"description": '), _json_text(description), F.lit(', "feature_id": '), id_text,
        F.lit(', "geometry": '), _json_text(geometry), F.lit(', "problem_name": '), _json_text(problem_name), F.lit("}"),
    ).cast("binary")), 1, 16)


def finished(raw: DataFrame, validator: str | Column | None = None, issue_class: str = "data_issue") -> DataFrame:
    """RAW columns -> issue rows. A problem that the catalog lacks is of medium severity."""
    numeric = raw.schema["feature_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    joined = raw.join(F.broadcast(catalog(raw.sparkSession)), "problem_name", "left")  # a fixed table
    filled = joined.withColumns({
        "severity": F.coalesce("severity", F.lit("medium")), "confidence": F.coalesce("confidence", F.lit("medium")),
        "actionable": F.coalesce("actionable", F.lit(True)), "issue_class": F.lit(issue_class), "validation_rule_version": F.lit(RULE_VERSION),
        "validator_name": F.col("problem_name") if validator is None else F.lit(validator) if isinstance(validator, str) else validator, "validator_version": F.lit("1"),
    })
    return filled.withColumns({
        "priority_score": priority_score(F.col("severity"), F.col("confidence"), F.col("actionable"), F.col("issue_class")),
        "issue_id": issue_id(F.col("description"), F.col("feature_id"), F.col("geometry"), F.col("problem_name"), numeric),
    })


@dataclass(frozen=True)
class Policy:
    """What a profile says about a problem; None leaves the issue's own value."""

    problem_name: str
    severity: str | None = None
    confidence: str | None = None
    actionable: bool | None = None
    issue_class: str | None = None
    iso_category: str | None = None
    priority_score: int | None = None
    suppress: bool = False
    reason: str = "Suppressed by profile configuration."


@dataclass(frozen=True)
class Policies:
    severity_overrides: dict = field(default_factory=dict)
    downgrades: dict = field(default_factory=dict)
    problems: tuple = ()


def apply_policies(issues: DataFrame, policies: Policies, profile: str) -> DataFrame:
    """Adds suppressed and suppression_reason. An explicit severity does not change the priority."""
    names = {name.lower() for name in [*policies.severity_overrides, *policies.downgrades, *[p.problem_name for p in policies.problems]]}
    by_name = {p.problem_name.lower(): p for p in policies.problems}
    rows = []
    for name in sorted(names):
        p = by_name.get(name, Policy(name))
        lowered = {k.lower(): v for k, v in policies.severity_overrides.items()} | {k.lower(): v for k, v in policies.downgrades.items()}
        rows.append((name, p.severity or lowered.get(name), p.confidence, p.actionable, p.issue_class, p.iso_category, p.priority_score, p.suppress, p.reason))
    schema = "p_name string, p_severity string, p_confidence string, p_actionable boolean, p_class string, p_iso string, p_priority int, p_suppress boolean, p_reason string"
    table = F.broadcast(issues.sparkSession.createDataFrame(rows, schema))  # a row for each problem of the profile
    joined = issues.join(table, F.lower("problem_name") == F.col("p_name"), "left")
    return joined.withColumns({
        "severity": F.coalesce("p_severity", "severity"), "confidence": F.coalesce("p_confidence", "confidence"), "actionable": F.coalesce("p_actionable", "actionable"),
        "issue_class": F.coalesce("p_class", "issue_class"), "iso_category": F.coalesce("p_iso", "iso_category"), "priority_score": F.coalesce("p_priority", "priority_score"),
        "suppressed": F.coalesce("p_suppress", F.lit(False)), "suppression_reason": F.when(F.coalesce("p_suppress", F.lit(False)), F.col("p_reason")), "profile": F.lit(profile),
    }).drop(*[c.split()[0] for c in schema.split(", ")])


def priority_band(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")


SUMMARY_DIMENSIONS = ["problem_name", "severity", "issue_class", "validator_name", "iso_category", "root_cause", "priority_band"]


def summary(issues: DataFrame) -> DataFrame:
    """(dimension, value, n, percent): counts over each dimension in one pass of grouping sets; absent values are left out."""
    rows = issues.withColumns({"root_cause": F.col("category"), "priority_band": priority_band(F.coalesce("priority_score", F.lit(0)))})
    sets = rows.groupingSets([[F.col(c)] for c in SUMMARY_DIMENSIONS], *[F.col(c) for c in SUMMARY_DIMENSIONS]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set_id"))
    width = len(SUMMARY_DIMENSIONS)
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(SUMMARY_DIMENSIONS):
        own = F.col("set_id") == ((1 << width) - 1) ^ (1 << (width - 1 - i))
        dimension, value = F.when(own, F.lit(name)).otherwise(dimension), F.when(own, F.col(name)).otherwise(value)
    counted = sets.select(dimension.alias("dimension"), value.alias("value"), "n")
    total = counted.where("dimension = 'severity'").agg(F.sum("n").alias("total"))
    return counted.where("value is not null").crossJoin(F.broadcast(total)).select("dimension", "value", "n", F.bround(100 * F.col("n") / F.col("total"), 2).alias("percent"))


def score(severity_penalty: Column, n: Column) -> Column:
    """Quality score of a layer or feature: 1 less the worst severity's penalty and 0.05 for each issue, at most 0.5."""
    return F.greatest(F.lit(0.0), F.bround(1 - severity_penalty - F.least(0.05 * n, F.lit(0.5)), 4))


def layer_scores(issues: DataFrame) -> DataFrame:
    """One row: conservative counts all issues, ml_ready the actionable ones; the worst severity is of all in both."""
    worst = F.coalesce(F.max(lookup(SEVERITY_PENALTY, F.col("severity"), 0.35)), F.lit(0.0))
    counts = issues.agg(worst.alias("worst"), F.count(F.lit(1)).alias("n"), F.count_if("actionable").alias("n_actionable"))
    return counts.select(score(F.col("worst"), F.col("n")).alias("conservative"), score(F.col("worst"), F.col("n_actionable")).alias("ml_ready"), "n", "n_actionable")
