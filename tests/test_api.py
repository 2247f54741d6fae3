"""The short way, expectations, reports and the command line."""

import json

from cartosieve.__main__ import main
from cartosieve.operators.layers import LayerMeta
from cartosieve.plans import api, report


def document(tmp_path):
    features = [
        {"type": "Feature", "id": "a", "properties": {"name": "x"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [0, 0], [1, 0]]}},
        {"type": "Feature", "id": "b", "properties": {"name": "y"}, "geometry": None},
    ]
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(tmp_path / "l.geojson")


def test_validate_fix_and_export(spark, tmp_path):
    result = api.validate(spark, document(tmp_path), "geometry")
    assert sorted(r["problem_name"] for r in result.issues().collect()) == ["duplicate_vertex", "null_geometry"]
    assert result.score() == 0.05 and result.suppressed_issues().isEmpty()
    assert result.fix().count() == 1 and {r["qa_issue_count"] for r in result.to_ml().collect()} == {1}
    result.export(str(tmp_path / "out"), "json")
    assert report.read_report(spark, str(tmp_path / "out")).count() == 2
    assert "null_geometry: 1" in report.text_summary(result.issues())
    assert report.explained(result.issues()).where("what is null or action is null").isEmpty()


def test_expectations(spark, tmp_path):
    layer = api.validate(spark, document(tmp_path), "geometry").layer
    assert not api.expect(layer).no_null_geometry().check()
    assert api.expect(layer, LayerMeta(crs="EPSG:4326")).no_self_intersections().valid_crs("EPSG:4326").check()


def test_command_line(spark, tmp_path, capsys):
    path = document(tmp_path)
    assert main(["profiles"]) == 0
    assert main(["validate", path, "--profile", "geometry", "--output", str(tmp_path / "r.csv"), "--format", "csv", "--fail-on-error"]) == 2
    assert main(["report", str(tmp_path / "r.csv")]) == 0
    assert "null_geometry (critical): 1" in capsys.readouterr().out
    assert main(["convert", path, str(tmp_path / "o"), "--format", "csv"]) == 0
