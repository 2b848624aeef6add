import json

from parcelwright.operators.nested import instances, json_parts, paths
from parcelwright.plans import land

REQUESTS = "array<struct<survey_number string, disposition string, reason string, input_type string, instruction string, resolves_via string, known_utm array<double>>>"
PROPOSALS = "array<struct<survey_number string, hypothesis string, action string, rationale string, source string, is_auto boolean, regated boolean, accepted_by_gate boolean, note string>>"


def test_documents_of_any_depth_and_wrapping():
    read = lambda body: [r[5] for r in instances(body, paths(land.REPORTS))]
    deep, inner = 30_000, '{"checks": [{"a": [1.50, -2e3, true, null, "x\\u00e9"], "b": {}, "c": []}]}'
    want = [{"a.0": "1.50", "a.1": "-2e3", "a.2": "true", "a.3": None, "a.4": "xé"}]
    assert read("[" * deep + inner + "]" * deep + " rest") == read(inner) == want
    assert read("[" * deep + inner + "]" * (deep - 1)) == read("[" * deep + '{"checks" [{"a": 1}]}' + "]" * deep) == []
    wrapped = inner
    for _ in range(9):
        wrapped = json.dumps(wrapped)
    assert read(wrapped) == want


def test_flat_tables_hold_every_field(spark, tmp_path):
    request = lambda place: {"surveyNumber": "1", "knownUtm": place}
    report = {"agent": "g", "passed": False, "notes": [f"n{i}" for i in range(12)], "checks": [{"name": "c", "severity": "warn", "detail": "d", "evidence": {"surveys": ["8", "9"], "metrics": {"iou": 0.5}}}]}
    report |= {"requests": [request([7.5, 8]), request({"x": 7.5, "y": 8}), request("7.5,8"), request(None)], "proposals": [{"surveyNumber": "2", "hypothesis": "h", "isAuto": True, "note": "w"}]}
    spark.createDataFrame([(1, json.dumps({"reports": [report]}))] * 2, "payload_id long, body string").write.parquet(f"{tmp_path}/report_payloads.parquet")
    nested = [(2, "a", True, [("k", "ok", "z")], [("3", None, None, None, None, None, [1.25, 1207610.1])], [("4", "h", None, None, None, False, True, None, None)], ["m"]), (3, "b", None, None, None, None, None)]
    spark.createDataFrame(nested, f"report_id long, agent string, passed boolean, checks array<struct<name string, severity string, detail string>>, requests {REQUESTS}, proposals {PROPOSALS}, notes array<string>").write.parquet(f"{tmp_path}/agent_reports.parquet")
    got = {n: [r.asDict() for r in land.QUERIES[n](spark, str(tmp_path)).collect()] for n in ("p5_reports", "p5_checks", "p5_requests", "p5_proposals")}
    assert {(r["record_id"], r["report_pos"], r["agent"], r["passed"], *r["notes"]) for r in got["p5_reports"]} == {(1, 0, "g", False, *report["notes"]), (2, 0, "a", True, "m"), (3, 0, "b", None)} and len(got["p5_reports"]) == 3
    assert {(r["record_id"], r["name"], r["severity"], r["detail"], r["evidence_metrics_iou"], *r["evidence_surveys"]) for r in got["p5_checks"]} == {(1, "c", "warn", "d", "0.5", "8", "9"), (2, "k", "ok", "z", None)}
    assert {(r["record_id"], r["child_pos"], tuple(r["known_utm"] or ())) for r in got["p5_requests"]} == {(1, 0, (7.5, 8.0)), (1, 1, (7.5, 8.0)), (1, 2, (7.5, 8.0)), (1, 3, ()), (2, 0, (1.25, 1207610.1))}
    assert {(r["record_id"], r["survey_number"], r["hypothesis"], r["is_auto"], r["regated"], r["note"]) for r in got["p5_proposals"]} == {(1, "2", "h", True, None, "w"), (2, "4", "h", False, True, None)}
