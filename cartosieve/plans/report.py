"""Reports of issues: tables on disk, a text summary, explanations, GeoJSON for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.plans import issues as I

COLUMNS = [
    "issue_id", "problem_name", "severity", "description", "feature_id", "geometry", "validation_rule_version", "validator_name", "validator_version",
    "issue_class", "iso_category", "confidence", "actionable", "priority_score",
]
#: This engine's own words for the problems that reviewers meet most.
EXPLANATIONS = {
    "duplicate_geometry_same_layer": ("Several records have one and the same shape.", "They may stand for one asset that was loaded twice.", "Compare the records; merge or retire the spare ones."),
    "line_intersection_same_layer": ("A line crosses another where none should.", "Tracing may take a crossing for a connection or miss one.", "Split the lines or record that the crossing is meant."),
    "feature_not_split_at_intersection": ("A line passes a crossing without a node.", "Connectivity is lost there.", "Split the line at the crossing."),
    "missing_spatial_reference": ("The layer names no reference system.", "It cannot be placed, measured or overlaid.", "Ask the owner and declare it."),
    "invalid_spatial_reference": ("The reference system is unreadable or not the expected one.", "Features may land in the wrong place.", "Confirm the right one before reprojecting."),
    "null_geometry": ("A record has no shape.", "It is invisible to every spatial check.", "Restore the shape or drop the record."),
}


def explained(issues: DataFrame) -> DataFrame:
    """issues with what, why and action; problems without an explanation say what the issue says."""
    table = issues.sparkSession.createDataFrame([(k, *v) for k, v in EXPLANATIONS.items()], "problem_name string, what string, why string, action string")
    joined = issues.join(F.broadcast(table), "problem_name", "left")  # a fixed table
    return joined.withColumns({"what": F.coalesce("what", "description"), "why": F.coalesce("why", F.lit("It may affect later use of the layer.")), "action": F.coalesce("action", F.lit("Review the feature."))})


def write_report(issues: DataFrame, path: str, form: str = "json") -> None:
    """A folder of JSON lines or CSV, written by the tasks."""
    known = [c for c in COLUMNS if c in issues.columns]
    rows = issues.select(*known, *sorted(c for c in issues.columns if c not in COLUMNS))
    if form == "json":
        rows.write.json(path)
    elif form == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.csv(path, header=True)
    else:
        raise ValueError(f"no report form {form}")


def write_payload(issues: DataFrame, path: str) -> None:
    """issues as JSON lines and their summary beside them, with the version of the rules and the number of issues in each line of it."""
    write_report(issues, f"{path}/issues", "json")
    total = issues.agg(F.count(F.lit(1)).alias("issue_count"))
    I.summary(issues).withColumn("validation_rule_version", F.lit(I.RULE_VERSION)).crossJoin(F.broadcast(total)).write.json(f"{path}/summary")  # one row


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """CSV; JSON lines; or one JSON document, a list of issues or an object that has them as `issues`."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, escape='"')
    start = "".join(r["value"] for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect()).strip()
    whole = start in ("{", "[") or start.startswith("[") or not start.endswith("}") or '"issues"' in start
    rows = spark.read.json(path, multiLine=whole)
    if "issues" in rows.columns and rows.schema["issues"].dataType.typeName() == "array":
        return rows.select(F.explode("issues").alias("i")).select("i.*")
    return rows


def log_fixes(actions: DataFrame, path: str) -> None:
    """Appends JSON lines to a log of repairs."""
    actions.write.mode("append").json(path)


def run_report(issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """Issues and repairs as rows of one table, told apart by row_type."""
    return issues.withColumn("row_type", F.lit("issue")).unionByName(fixes.withColumn("row_type", F.lit("fix_action")), allowMissingColumns=True)


def text_summary(issues: DataFrame) -> str:
    """A few lines for people; reads the summary's rows, whose number the catalog bounds."""
    rows = I.summary(issues).collect()
    by = lambda d: sorted(((r["n"], r["value"]) for r in rows if r["dimension"] == d), key=lambda x: (-x[0], x[1]))
    lines = [f"Issues: {sum(n for n, _ in by('severity'))}"]
    for title, dimension in (("Severity", "severity"), ("Problem", "problem_name"), ("Priority", "priority_band")):
        lines += [f"{title}:"] + [f"  {value}: {n}" for n, value in by(dimension)[:5]]
    return "\n".join(lines)


def grouped_examples(issues: DataFrame, counterpart: Column | None = None) -> DataFrame:
    """(problem_name, feature_id, n, counterparts): repeated findings of one feature as one row."""
    others = F.array_sort(F.collect_set(counterpart)) if counterpart is not None else F.array().cast("array<string>")
    return issues.groupBy("problem_name", "feature_id").agg(F.count(F.lit(1)).alias("n"), others.alias("counterparts"))


def geojson_lines(issues: DataFrame, geometry_json: Column) -> DataFrame:
    """(value): a GeoJSON feature for each issue."""
    properties = F.to_json(F.struct("issue_id", "problem_name", "severity", "description", F.col("feature_id").cast("string").alias("feature_id")))
    return issues.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry_json, F.lit("null")), F.lit(',"properties":'), properties, F.lit("}")).alias("value"))
