"""Finding documents keep every field through a round trip."""

import json

from pyspark.sql.types import StructType

from emberfield.sources import files, sinks


def test_every_field_round_trips(spark, tmp_path):
    names = StructType.fromDDL(files.FINDING_DOCUMENT)["findings"].dataType.elementType.fieldNames()
    assert len(names) == 56
    finding = {n: None for n in names} | {
        "center_x": 3, "bbox": [1, 2, 3, 4], "polygon": [[1, 2], [3, 4]], "severity": "critical", "evidence": ["a", "b"],
        "radiometric_provenance": {"adapter": "x", "calibration": {"emissivity": 0.95}}, "audit_trail": [{"by": "u"}], "altitude": 12.5,
    }
    (tmp_path / "in.json").write_text(json.dumps({"findings": [finding, {"finding_id": "A"}]}))
    rows = files.read_findings(spark, str(tmp_path / "in.json")).collect()
    first = next(r for r in rows if r["center_x"] == 3)
    assert first["bbox"] == [1, 2, 3, 4] and first["polygon"] == [[1, 2], [3, 4]] and first["altitude"] == 12.5
    assert json.loads(first["radiometric_provenance"])["calibration"]["emissivity"] == 0.95
    assert json.loads(first["audit_trail"][0]) == {"by": "u"}
    assert {r["lifecycle_status"] for r in rows} == {"new"} and {r["severity"] for r in rows} == {"critical", "minor"}
    df = files.read_findings(spark, str(tmp_path / "in.json"))
    sinks.write_json_lines(df, str(tmp_path / "out"))
    written = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert all(set(w) == set(names) and list(w) == sorted(w) for w in written)


def test_bands_are_described(spark):
    assert all(r["description"] for r in sinks.band_manifest(spark).collect())
