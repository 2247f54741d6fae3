"""Profiles name the checks of a layer; a run plans them, leaves out those that cannot apply, and unions what they find.

Checks run in the order of their families' cost. The checks of single features share one scan of the layer, which also tells its kinds of geometry: each row gets the
list of what is found in it. Those that need the crossing pairs of lines, or how shapes lie to each other, share these. A check that cannot be
planned, or fails as it runs, is an issue and failed coverage; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cartosieve.functions import geometry as G
from cartosieve.functions.storage import checkpointed
from cartosieve.operators import layers, nearest, network, rows, topology
from cartosieve.plans import issues


@dataclass(frozen=True)
class Check:
    family: str
    cost: int
    kinds: tuple[str, ...]  # geometry types it applies to; empty: all
    run: Callable[..., DataFrame | None]  # of layer, meta and the options; None: its options are not given
    row: Callable[..., tuple[Column, str, str]] | None = None  # of a check of single features: the test, the problem and the text; the column onward_ may be used
    doubt: Callable[[], Column] | None = None  # where the test is a dear one: only rows for which this is true get it
    shares: str | None = None  # the name of an option that checks share


#: The columns of water network layers by meaning, the first that exists counts, and the values that are right in them.
WATER_FIELDS = {
    "asset_id": ("asset_id", "pipe_id", "assetid", "assetid_1", "globalid"),
    "diameter": ("pipe_diameter", "diameter", "diam_mm", "diameter_mm", "nominal_diameter"),
    "material": ("material", "pipe_material", "matl", "pipe_mat"),
    "status": ("status", "asset_status", "lifecycle_status", "operational_status"),
    "role": ("asset_type", "asset_class", "network_role", "service_type", "pipe_role"),
}
TERMINAL_ROLES = ("service", "service_endpoint", "service_lateral", "service_connection", "customer_connection", "hydrant", "meter", "valve_stub")
MATERIALS = ("di", "ci", "pvc", "hdpe", "steel", "copper", "ac", "ductile_iron", "unknown")
STATUSES = ("active", "inactive", "abandoned", "planned", "retired", "unknown")
LAND_USE_FIELDS, LAND_USE_CODES = ("land_use", "landuse", "zoning"), (1, 2, 3)


@dataclass(frozen=True)
class WaterSchema:
    """The columns of a layer that say what a water network needs; strength by how many of the five there are."""

    fields: dict[str, str]

    @property
    def missing(self) -> list[str]:
        return [meaning for meaning in WATER_FIELDS if meaning not in self.fields]

    @property
    def strength(self) -> str:
        return "strong" if len(self.fields) >= 4 else "moderate" if len(self.fields) >= 2 else "weak"


def water_schema(columns: list[str]) -> WaterSchema:
    first = {meaning: next((c for c in names if c in columns), None) for meaning, names in WATER_FIELDS.items()}
    return WaterSchema({meaning: c for meaning, c in first.items() if c})


def water_options(layer: DataFrame, meta: layers.LayerMeta) -> dict[str, dict]:
    own = water_schema(layer.columns).fields
    roles = {"role_field": own.get("role"), "allowed": TERMINAL_ROLES}
    near = {"geographic": layers.epsg_code(meta.crs) in layers.GEOGRAPHIC}
    return {
        "line_dangle": roles, "isolated_network_segment": roles, "suspicious_near_miss_endpoints": roles | near, "unsnapped_endpoints_within_tolerance": roles | near,
        "required_nulls": {"fields": tuple(own[m] for m in ("asset_id", "status") if m in own)}, "uniqueness": {"unique_field": own.get("asset_id")},
        "diameter_domain": {"domain_field": own.get("diameter"), "allowed": rows.positive_number}, "material_domain": {"domain_field": own.get("material"), "allowed": MATERIALS},
        "status_domain": {"domain_field": own.get("status"), "allowed": STATUSES},
    }


def land_use_options(layer: DataFrame, meta: layers.LayerMeta) -> dict[str, dict]:
    return {"domain": {"domain_field": next((c for c in LAND_USE_FIELDS if c in layer.columns), None), "allowed": list(LAND_USE_CODES)}}


def _crs(check: Callable) -> Callable:
    return lambda layer, meta, **o: check(layer.sparkSession, meta, **o)


def _domain(layer, meta, domain_field=None, allowed=None):
    return rows.domain(layer, domain_field, allowed) if domain_field else None


#: What several checks of a run may share, made once and only where more than one of them runs.
SHARED: dict[str, Callable[[DataFrame], DataFrame]] = {"pairs": topology.crossing_pairs, "shapes": topology.shape_pairs}
#: In the scan of single features, whether a line goes on in one direction.
ONWARD = "onward_"
FAILURES = (PySparkException, Py4JJavaError, ValueError, TypeError, KeyError, AttributeError)
CHECKS: dict[str, Check] = {
    "null_geometry": Check("geometry", 1, (), lambda layer, meta: rows.null_geometry(layer), lambda: (F.col("geometry").isNull(), "null_geometry", rows.NULL_TEXT)),
    "duplicate_vertex": Check("geometry", 2, (), lambda layer, meta: rows.duplicate_vertex(layer), lambda: (~F.col(ONWARD) & G.has_repeated_vertex(F.col("geometry")), "duplicate_vertex", rows.VERTEX_TEXT)),
    "below_minimum_feature_length": Check("geometry", 2, G.LINES, lambda layer, meta, min_length=None: rows.below_minimum_length(layer, min_length), lambda min_length=None: (G.is_a(F.col("geometry"), G.LINES) & (G.planar_length(F.col("geometry")) < (min_length or 0.0)), "below_minimum_feature_length", rows.length_text(min_length or 0.0))),
    "sharp_angle_cutback": Check("geometry", 3, G.LINES, lambda layer, meta, min_degrees=None: rows.sharp_angle(layer, min_degrees)),
    "self_intersection": Check("geometry", 4, G.LINES + G.POLYGONS, lambda layer, meta: topology.self_intersection(layer), lambda: (topology.meets_itself("geometry"), "self_intersection", topology.SELF_TEXT), lambda: topology.may_meet_itself(F.col("geometry"), F.col(ONWARD))),
    "required_nulls": Check("attributes", 1, (), lambda layer, meta, fields=(): rows.required_nulls(layer, fields) if fields else None),
    "uniqueness": Check("attributes", 2, (), lambda layer, meta, unique_field=None: rows.uniqueness(layer, unique_field) if unique_field else None),
    "domain": Check("attributes", 2, (), _domain),
    "diameter_domain": Check("attributes", 2, (), _domain),
    "material_domain": Check("attributes", 2, (), _domain),
    "status_domain": Check("attributes", 2, (), _domain),
    "missing_crs": Check("crs", 1, (), _crs(layers.missing_crs)),
    "invalid_crs": Check("crs", 1, (), _crs(layers.invalid_crs)),
    "coordinate_precision": Check("accuracy", 3, (), lambda layer, meta, max_decimals=9: rows.coordinate_precision(layer, max_decimals, None)),
    "xy_tolerance": Check("accuracy", 1, (), lambda layer, meta, most=0.05: layers.xy_tolerance(layer.sparkSession, meta, most)),
    "positional_accuracy": Check("accuracy", 8, (), lambda layer, meta, reference=None, tolerance=10.0: nearest.positional_accuracy(layer, reference, tolerance) if reference is not None else None),
    "missing_spatial_index": Check("integrity", 1, (), _crs(layers.spatial_index)),
    "outdated_index": Check("integrity", 1, (), _crs(layers.outdated_index)),
    "polygon_overlap_same_layer": Check("topology", 8, G.POLYGONS, lambda layer, meta, shapes=None: topology.overlaps(layer, shapes), shares="shapes"),
    "feature_within_feature": Check("topology", 7, G.POLYGONS, lambda layer, meta, shapes=None: topology.within(layer, shapes), shares="shapes"),
    "line_intersection_same_layer": Check("topology", 7, G.LINES, lambda layer, meta, pairs=None: topology.line_intersections(layer, pairs), shares="pairs"),
    "feature_not_split_at_intersection": Check("topology", 7, G.LINES, lambda layer, meta, pairs=None: topology.not_split(layer, pairs), shares="pairs"),
    "polygon_gap_same_layer": Check("topology", 9, G.POLYGONS, lambda layer, meta, min_area=0.0: topology.gap_issues(layer, min_area)),
    "boundary_mismatch_against_reference": Check("topology", 8, G.POLYGONS, lambda layer, meta, reference=None, max_ratio=0.02: topology.mismatch_issues(layer, reference, max_ratio) if reference is not None else None),
    "duplicate_geometry_same_layer": Check("topology", 4, (), lambda layer, meta: topology.duplicate_geometry(layer)),
    "line_dangle": Check("topology", 3, G.LINES, lambda layer, meta, role_field=None, allowed=(): network.line_dangle(layer, role_field, allowed)),
    "isolated_network_segment": Check("topology", 3, G.LINES, lambda layer, meta, role_field=None, allowed=(): network.isolated_segment(layer, role_field, allowed)),
    "suspicious_near_miss_endpoints": Check("topology", 6, G.LINES, lambda layer, meta, tolerance=None, role_field=None, allowed=(), geographic=False: network.pair_issues(layer, network.near_miss_pairs(layer, tolerance, role_field, allowed, geographic), "suspicious_near_miss_endpoints", "Two ends look connected but do not meet.") if tolerance else None),
    "unsnapped_endpoints_within_tolerance": Check("topology", 6, G.LINES, lambda layer, meta, tolerance=None, role_field=None, allowed=(), geographic=False: network.pair_issues(layer, network.unsnapped_pairs(layer, tolerance, role_field, allowed, geographic), "unsnapped_endpoints_within_tolerance", "A loose end lies within snapping reach of another.") if tolerance else None),
    "metadata": Check("metadata", 1, (), lambda layer, meta, fields=("title", "abstract", "extent", "lineage"): layers.metadata_gaps(layer.sparkSession, meta.attrs, fields)),
}
FAMILY_ORDER = ("geometry", "attributes", "crs", "accuracy", "integrity", "metadata", "topology")
BASIC, CRS, INDEX = ("null_geometry", "duplicate_vertex", "self_intersection"), ("missing_crs", "invalid_crs"), ("missing_spatial_index", "outdated_index")


@dataclass(frozen=True)
class Profile:
    name: str
    checks: tuple[str, ...]
    options: dict = field(default_factory=dict)
    policies: issues.Policies = issues.Policies()
    context: Callable[[DataFrame, layers.LayerMeta], dict[str, dict]] | None = None  # options that follow from the layer


_says = issues.Policy
GENERIC_STRICT = issues.Policies(problems=(
    _says("coordinate_precision_not_fit_for_use", severity="low", confidence="low", actionable=False), _says("inappropriate_xy_tolerance", severity="low", confidence="low", actionable=False),
    _says("missing_or_stale_spatial_index", severity="medium", confidence="medium", actionable=True),
))
GENERIC_AUDIT = issues.Policies(problems=tuple(_says(p, severity="medium", confidence="low", actionable=False, priority_score=3) for p in ("coordinate_precision_not_fit_for_use", "inappropriate_xy_tolerance")))
BOUNDARY_POLICIES = issues.Policies(problems=(
    *(_says(p, severity="critical", confidence="high", actionable=True, priority_score=9) for p in ("self_intersection", "polygon_overlap_same_layer")),
    *(_says(p, severity="high", confidence="medium", actionable=True, priority_score=8) for p in ("polygon_gap_same_layer", "feature_within_feature")),
    _says("boundary_mismatch_against_reference", severity="high", confidence="high", actionable=True, priority_score=8),
    *(_says(p, suppress=True, reason="Not reported for boundaries.") for p in ("coordinate_precision_not_fit_for_use", "inappropriate_xy_tolerance")),
))
LAND_USE_POLICIES = issues.Policies(problems=tuple(_says(p, severity="high", confidence="high", actionable=True, priority_score=8) for p in ("domain_violation", "polygon_overlap_same_layer")))
PRECISION = ("coordinate_precision_not_fit_for_use", "inappropriate_xy_tolerance")


def water_policies(name: str) -> issues.Policies:
    """What the water network profiles say about each problem."""
    own = {p: _says(p, severity=s, confidence=c, actionable=True, priority_score=n) for p, s, c, n in (
        ("self_intersection", "high", "high", 9), ("duplicate_vertex", "medium", "high", 7), ("below_minimum_feature_length", "medium", "medium", 6),
        ("sharp_angle_cutback", "medium", "medium", 6), ("line_intersection_same_layer", "high", "high", 8), ("duplicate_geometry_same_layer", "high", "high", 8),
        ("feature_not_split_at_intersection", "high", "high", 8), ("isolated_network_segment", "high", "medium", 8), ("suspicious_near_miss_endpoints", "medium", "medium", 7),
        ("unsnapped_endpoints_within_tolerance", "high", "high", 8), ("line_dangle", "high", "medium", 7), ("non_unique_attribute", "high", "high", 8),
        ("null_attribute_in_required_field", "high", "high", 8), ("domain_violation", "medium", "medium", 6),
    )}
    own |= {p: _says(p, severity="low", confidence="low", actionable=False, priority_score=2) for p in PRECISION}
    if name.endswith("_quick"):
        own["line_dangle"] = _says("line_dangle", severity="medium", confidence="medium", actionable=True, priority_score=6)
        own |= {p: _says(p, suppress=True, reason="Not reported in the quick profile.") for p in PRECISION}
    elif name.endswith("_audit"):
        own["line_dangle"] = _says("line_dangle", severity="high", confidence="high", actionable=True, priority_score=8)
        own |= {p: _says(p, severity="medium", confidence="medium", actionable=False, priority_score=4) for p in PRECISION}
    return issues.Policies(problems=tuple(own.values()))


LINES_AND_NETWORK = ("below_minimum_feature_length", "sharp_angle_cutback", "line_dangle", "line_intersection_same_layer", "duplicate_geometry_same_layer", "feature_not_split_at_intersection", "isolated_network_segment", "suspicious_near_miss_endpoints", "unsnapped_endpoints_within_tolerance")
WATER_ATTRIBUTES = ("required_nulls", "uniqueness", "diameter_domain", "material_domain", "status_domain")


def _water(name: str, decimals: int, most: float) -> Profile:
    options = {
        "below_minimum_feature_length": {"min_length": 0.1}, "sharp_angle_cutback": {"min_degrees": 12.5}, "suspicious_near_miss_endpoints": {"tolerance": 100.0},
        "unsnapped_endpoints_within_tolerance": {"tolerance": 50.0}, "coordinate_precision": {"max_decimals": decimals}, "xy_tolerance": {"most": most},
    }
    return Profile(name, (*BASIC, *LINES_AND_NETWORK, *WATER_ATTRIBUTES, *CRS, "coordinate_precision", "xy_tolerance"), options, water_policies(name), water_options)


def _boundaries(name: str) -> Profile:
    quick = name.endswith("_quick")
    topology_ = ("polygon_overlap_same_layer", "polygon_gap_same_layer", *(() if quick else ("feature_within_feature",)), "boundary_mismatch_against_reference")
    return Profile(name, (*(BASIC[::2] if quick else BASIC), *topology_, *CRS, *(() if quick else ("missing_spatial_index",))), {}, BOUNDARY_POLICIES)


def _land_use(name: str) -> Profile:
    quick = name.endswith("_quick")
    return Profile(name, (*(BASIC[::2] if quick else BASIC), "domain", "polygon_overlap_same_layer", *(() if quick else ("feature_within_feature",)), *CRS, *(("missing_spatial_index",) if name.endswith("_audit") else ())), {}, LAND_USE_POLICIES, land_use_options)


PROFILES: dict[str, Profile] = {
    p.name: p
    for p in (
        Profile("geometry", BASIC),
        Profile("point_asset_quick", (*BASIC, "duplicate_geometry_same_layer", *CRS, *INDEX)),
        Profile("line_network_quick", (*BASIC, "below_minimum_feature_length", "line_intersection_same_layer", "feature_not_split_at_intersection", "line_dangle", *CRS, *INDEX)),
        Profile("generic_quick", (*BASIC, *CRS, *INDEX)),
        Profile("generic_strict", (*BASIC, *CRS, "coordinate_precision", "xy_tolerance", *INDEX, "polygon_overlap_same_layer", "feature_within_feature", "line_intersection_same_layer"), {"coordinate_precision": {"max_decimals": 12}}, GENERIC_STRICT),
        Profile("generic_audit", (*BASIC, "below_minimum_feature_length", "sharp_angle_cutback", *CRS, "coordinate_precision", "xy_tolerance", "positional_accuracy", *INDEX, "polygon_overlap_same_layer", "polygon_gap_same_layer", "feature_within_feature", "line_intersection_same_layer"), {"coordinate_precision": {"max_decimals": 12}}, GENERIC_AUDIT),
        _water("water_network_quick", 10, 0.1),
        *(_water(f"water_network{variant}", 12, 0.05) for variant in ("", "_strict", "_audit")),
        *(_boundaries(f"boundaries{variant}") for variant in ("_quick", "", "_strict", "_audit")),
        *(_land_use(f"land_use{variant}") for variant in ("_quick", "", "_strict", "_audit")),
    )
}


def register_check(name: str, check: Check) -> None:
    CHECKS[name] = check


def register_profile(profile: Profile) -> None:
    PROFILES[profile.name] = profile


def _with_onward(layer: DataFrame) -> DataFrame:
    return layer.withColumn(ONWARD, _once(G.goes_onward(F.col("geometry"))))


def _once(c: Column) -> Column:
    """Evaluated where it stands, not again in each filter that reads it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _kinds(layer: DataFrame) -> set[str | None]:
    return {r[0] for r in layer.where("geometry is not null and size(geometry.parts) > 0").select("geometry.type").distinct().collect()}


def _scanned(layer: DataFrame, tests: list[tuple[str, Column, str, str, Column | None]]) -> tuple[set[str | None], DataFrame]:
    """(kinds of geometry, what checks of single features (name, test, problem, text, doubt) find), in one scan. Of kinds only those that checks know are told apart; any other is None."""
    said = lambda name, problem, text: F.struct(F.lit(name).alias("validator"), F.lit(problem).alias("problem_name"), F.lit(text).alias("description"))
    found_of = lambda cases: F.filter(F.array(*cases), lambda f: f.isNotNull())
    plain, dear = [t for t in tests if t[4] is None], [t for t in tests if t[4] is not None]
    nothing = F.lit(None).cast("struct<validator:string,problem_name:string,description:string>")
    found = found_of([nothing, *[F.when(test, said(*about)) for name, test, problem, text, _ in plain for about in [(name, problem, text)]]])
    judged = _with_onward(layer).select(
        "feature_pos", F.col("feature_id").cast("string").alias("feature_id"), "geometry", _once(found).alias("found_"), *[_once(F.coalesce(t[4], F.lit(False))).alias(f"doubt_{i}") for i, t in enumerate(dear)],
    )
    known = sorted({k for check in CHECKS.values() for k in check.kinds})
    there = F.col("geometry").isNotNull() & (F.size("geometry.parts") > 0)
    seen = Observation()
    judged = judged.observe(seen, F.count_if(there).alias("n"), *[F.count_if(there & (F.col("geometry.type") == k)).alias(f"kind_{i}") for i, k in enumerate(known)])
    some = F.size("found_") > 0
    for i in range(len(dear)):
        some = some | F.col(f"doubt_{i}")
    judged = judged.where(some)
    for i, (_, test, *_) in enumerate(dear):
        judged = judged.withColumn(f"hit_{i}", test)
    more = [F.when(F.col(f"doubt_{i}") & F.col(f"hit_{i}"), said(name, problem, text)) for i, (name, _, problem, text, _) in enumerate(dear)]
    all_ = F.concat("found_", found_of([nothing, *more]))
    hits = judged.withColumn("found_", all_).where(F.size("found_") > 0).select("feature_pos", "feature_id", G.wkt(F.col("geometry")).alias("geometry"), F.explode("found_").alias("f"))
    hits = checkpointed(hits.select("f.problem_name", "feature_pos", "feature_id", "geometry", "f.description", "f.validator"))
    counts = seen.get
    kinds = {k for i, k in enumerate(known) if counts[f"kind_{i}"]}
    return kinds | ({None} if counts["n"] and not kinds else set()), hits


def _failure(spark: SparkSession, name: str, error: Exception) -> tuple[DataFrame, str]:
    """The issue that a failed check gives, and its reason."""
    reason = next((line for line in str(error).splitlines() if line.strip()), type(error).__name__)[:200]
    row = [("validation_runtime_error", None, None, None, f"{name} failed: {reason}")]
    return issues.finished(spark.createDataFrame(row, "problem_name string, feature_pos long, feature_id string, geometry string, description string"), validator=name), reason


def run_profile(layer: DataFrame, meta: layers.LayerMeta, profile: Profile | str, options: dict | None = None, max_features: int | None = None, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(issues, coverage). Coverage has a row for each check: completed, failed with its error, or skipped as the layer has no geometry it applies to or it lacks its options.

    Checks of single features are one scan, or, if that fails, a job each like the others, which run `at_once` jobs side by side; what they find is kept in the shared folder. A check
    that cannot be planned, or whose job fails, gives an issue, validation_runtime_error, and the others go on. Pairs of features that several checks need are found once.
    """
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    spark = layer.sparkSession
    if max_features is not None and layer.count() > max_features:
        raise ValueError(f"the layer has more than {max_features} features")
    context = profile.context(layer, meta) if profile.context else {}
    order = sorted((n for n in CHECKS if n in profile.checks), key=lambda n: (FAMILY_ORDER.index(CHECKS[n].family) if CHECKS[n].family in FAMILY_ORDER else len(FAMILY_ORDER), CHECKS[n].cost))
    given = {name: context.get(name, {}) | profile.options.get(name, {}) | (options or {}).get(name, {}) for name in order}
    tests, unplanned, hits = {}, {}, None
    for name in (n for n in order if CHECKS[n].row):
        check = CHECKS[name]
        try:
            tests[name] = (name, *check.row(**given[name]), check.doubt() if check.doubt else None)
            _with_onward(layer).select(*[c for c in (tests[name][1], tests[name][4]) if c is not None])  # analysed
        except FAILURES as error:
            tests.pop(name, None)
            unplanned[name] = error
    try:
        kinds, hits = _scanned(layer, list(tests.values())) if tests else (_kinds(layer), None)
    except FAILURES:
        kinds, tests = _kinds(layer), {}
    fits = {name: not CHECKS[name].kinds or not kinds or bool(kinds & set(CHECKS[name].kinds)) for name in order}
    shared: dict[str, DataFrame] = {}
    for what, make in SHARED.items():
        users = [n for n in order if fits[n] and CHECKS[n].shares == what and what not in given[n]]
        if len(users) > 1:
            try:
                shared[what] = checkpointed(make(layer))
            except FAILURES:  # each of them then fails, or not, on its own
                continue

    def judged(name: str) -> tuple[str, str | None, DataFrame | None]:
        """(status, reason, issues) of a check; the issues of the scan are not among them."""
        check = CHECKS[name]
        if not fits[name]:
            return "skipped", "incompatible_geometry_type", None
        if name in tests:
            return "completed", None, None
        try:
            if name in unplanned:
                raise unplanned[name]
            own = {check.shares: shared[check.shares]} if check.shares in shared else {}
            raw = check.run(layer, meta, **own | given[name])
            if raw is None:
                return "skipped", "no_options", None
            return "completed", None, issues.finished(checkpointed(raw.withColumn("feature_id", F.col("feature_id").cast("string"))), validator=name)
        except FAILURES as error:
            failed, reason = _failure(spark, name, error)
            return "failed", reason, failed

    with ThreadPoolExecutor(at_once) as pool:
        results = dict(zip(order, pool.map(inheritable_thread_target(spark)(judged), order), strict=True))
    coverage = [(profile.name, CHECKS[n].family, n, status, reason) for n, (status, reason, _) in results.items()]
    found = [r[2] for r in results.values() if r[2] is not None]
    if hits is not None:
        found.insert(0, issues.finished(hits.where(F.col("validator").isin(*[n for n in tests if fits[n]])), validator=F.col("validator")).drop("validator"))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else issues.finished(rows.null_geometry(layer.where("false").withColumn("feature_id", F.col("feature_id").cast("string"))))
    return issues.apply_policies(union, profile.policies, profile.name), spark.createDataFrame(coverage, "profile string, family string, check string, status string, reason string")
