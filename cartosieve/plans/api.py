"""The short way: validate a file or layer, look at what was found, repair, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cartosieve.operators import features, repairs
from cartosieve.operators.layers import LayerMeta
from cartosieve.plans import issues as I
from cartosieve.plans import report
from cartosieve.plans.profiles import Profile, run_profile
from cartosieve.sources import readers


@dataclass
class Report:
    layer: DataFrame
    meta: LayerMeta
    all_issues: DataFrame
    coverage: DataFrame

    def issues(self) -> DataFrame:
        return self.all_issues.where("not suppressed")

    def suppressed_issues(self) -> DataFrame:
        return self.all_issues.where("suppressed")

    def summary(self) -> DataFrame:
        return I.summary(self.issues())

    def score(self, mode: str = "conservative") -> float:
        if mode not in ("conservative", "ml_ready"):
            raise ValueError(f"no score {mode}")
        return I.layer_scores(self.issues()).first()[mode]

    def to_ml(self) -> DataFrame:
        return features.annotated(self.layer.withColumn("feature_id", self.layer["feature_id"].cast("string")), self.issues())

    def export(self, path: str, form: str = "json") -> None:
        report.write_report(self.issues(), path, form)

    def fix(self, *enabled: str) -> DataFrame:
        return repairs.apply_repairs(self.layer, enabled or ("drop_null_geometries", "remove_duplicate_vertices"))


def validate(spark: SparkSession, source: str | DataFrame, profile: Profile | str = "generic_quick", meta: LayerMeta | None = None, options: dict | None = None, **reader_options: str) -> Report:
    layer, read = readers.load_layer(spark, source, **reader_options) if isinstance(source, str) else (source, LayerMeta())
    meta = meta or read
    found, coverage = run_profile(layer, meta, profile, options)
    return Report(layer, meta, found, coverage)


class Expectations:
    """expect(layer).no_null_geometry().valid_crs().check(): whether none of the checks finds anything."""

    def __init__(self, layer: DataFrame, meta: LayerMeta | None = None):
        self.layer, self.meta, self.checks, self.options = layer, meta or LayerMeta(), [], {}

    def _with(self, *names: str, **options: object) -> Expectations:
        self.checks += names
        if options:
            self.options[names[0]] = options
        return self

    def no_null_geometry(self) -> Expectations:
        return self._with("null_geometry")

    def no_self_intersections(self) -> Expectations:
        return self._with("self_intersection")

    def valid_crs(self, expected: str | None = None) -> Expectations:
        return self._with("missing_crs")._with("invalid_crs", expected=expected)

    def unique(self, field: str) -> Expectations:
        return self._with("uniqueness", unique_field=field)

    def required(self, *fields: str) -> Expectations:
        return self._with("required_nulls", fields=fields)

    def no_overlaps(self) -> Expectations:
        return self._with("polygon_overlap_same_layer")

    def connected(self) -> Expectations:
        return self._with("line_dangle", "isolated_network_segment")

    def issues(self) -> DataFrame:
        return run_profile(self.layer, self.meta, Profile("expectations", tuple(self.checks), self.options))[0]

    def check(self) -> bool:
        return self.issues().isEmpty()


def expect(layer: DataFrame, meta: LayerMeta | None = None) -> Expectations:
    return Expectations(layer, meta)
