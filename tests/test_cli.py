import json

import pytest

from tracewright.cli import main


def lines(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def read(spark, path):
    return [json.loads(r.value) for r in spark.read.text(str(path)).collect()]


EXAMPLES = [
    {"scenario_id": "a", "scores": {"x": 6.0, "y": 0.0}, "truth": "x"},
    {"scenario_id": "b", "scores": {"x": 6.0, "y": 0.0}, "truth": "x"},
    {"scenario_id": "c", "scores": {"x": 6.0, "y": 0.0}, "truth": "y"},
    {"scenario_id": "d", "scores": {"x": 0.0, "y": 6.0}, "truth": "y"},
]


def test_calibration(spark, tmp_path):
    data, model = lines(tmp_path / "e.jsonl", *EXAMPLES), str(tmp_path / "m.json")
    assert main(["fit", data, model], spark)["temperature"] > 1
    main(["apply", model, data, str(tmp_path / "out")], spark)
    got = read(spark, tmp_path / "out")
    assert len(got) == 4 and all(sum(r["probabilities"].values()) == pytest.approx(1) for r in got)
    report = main(["evaluate", model, data], spark)
    assert report["calibrated"]["log_loss"] < report["raw"]["log_loss"]
    with pytest.raises(ValueError):
        main(["apply", model, lines(tmp_path / "z.jsonl", {"scores": {"x": 1, "z": 2}}), str(tmp_path / "o2")], spark)


def test_model_to_explanation(spark, tmp_path):
    rows = [{"scenario_id": "s", "contact_id": "c", "observation_time": 1, "hypothesis": h, "operator_nation": n, "feature_logit": z} for h, n, z in (("A", "India", 1.0), ("B", "Unknown", 2.0), ("A", "China", 1.5))]
    main(["probability-model", lines(tmp_path / "f.jsonl", *rows), str(tmp_path / "p")], spark)
    record = read(spark, tmp_path / "p")[0]
    assert record["top_operator_nation"] == "China" and record["observation_time"] == "1"
    main(["explain", str(tmp_path / "p"), str(tmp_path / "x")], spark)
    assert "China" in read(spark, tmp_path / "x")[0]["summary"]


def test_graph_to_features(spark, tmp_path):
    fact = {"source_id": "s", "source_type": "web", "locator": "u", "confidence": 0.5}
    facts = lines(tmp_path / "f.jsonl", fact | {"subject": "MiG-29", "predicate": "USES_RADAR", "object": "N010 Zhuk"}, fact | {"subject": "MiG-29", "predicate": "OPERATOR_COUNTRY", "object": "India"})
    g = str(tmp_path / "g")
    assert main(["ingest-graph", "--facts", facts, "--graph", g], spark)["facts"] == 2
    log = lines(tmp_path / "log", "noise", "PY_CONTACT_LOG Time : 1, Sensor_aircraft : T, Emission_sensor_name : Slot Back [N-010 Zhuk-M], Emission_target_type : Fighter")
    assert main(["ingest-observations", "--input", log, "--graph", g, "--observations-jsonl", str(tmp_path / "o")], spark)["observations"] == 1
    types = main(["generate-hypotheses", "--graph", g, "--list-relationship-types"], spark)["relationship_types"]
    assert {"type": "USES_RADAR", "n": 1} in types
    found = main(["generate-hypotheses", "--graph", g, "--emitter", "Slot Back [N-010 Zhuk-M]", "--relationship-type", "USES_RADAR"], spark)["hypotheses"]
    assert [(h["hypothesis"], h["operator_nation"]) for h in found] == [("MiG-29", "India")]
    contact = [r.id for r in spark.read.parquet(f"{g}/nodes").collect() if "Contact" in r.labels][0]
    requests = lines(tmp_path / "r.jsonl", {"scenario_id": "s", "contact_id": contact, "observation_time": "1", "hypothesis": "Fighter"})
    main(["extract-features", "--requests", requests, "--output", str(tmp_path / "feat"), "--graph", g, "--include-logit"], spark)
    f = read(spark, tmp_path / "feat")[0]
    assert f["supporting_path_count"] == 1 and f["feature_logit"] == pytest.approx(0.65 + 0.8 * 0.5 + 0.5 * 0.5 - 0.2)


def test_dataset_from_log(spark, tmp_path):
    rows = [f'[1] {{"source":"cmo_lua","guid":"g{i}","posture":"{"Hostile" if i % 2 else "unknown"}"}} tail' for i in range(6)]
    log = lines(tmp_path / "log", *rows, rows[1])
    assert main(["recover-log", log, str(tmp_path / "rec"), "--unique"], spark)["records"] == 6
    m = main(["build-dataset", "--input", log, "--output", str(tmp_path / "d"), "--from-log", "--drop-unknown"], spark)
    assert m["num_examples"] == 4 and m["num_labels"] == 1 and sum(m["splits"].values()) == 4
