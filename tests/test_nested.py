import json

from parcelwright.operators import nested
from parcelwright.operators.nested import as_bodies, canonical, document_text, json_parts, paths, pivot_part
from parcelwright.plans.land import REPORTS

BODY = {
    "jobId": "J1",
    "job": {"stages": [{"stage": "m1"}, {"stage": "m2", "reports": [{"agent": "a", "checks": {"name": "only"}, "requests": None}, {"agent": "b", "checks": [{"name": "x", "evidence": {"surveys": ["1", "2"], "m": {"iou": 0.50}}}, None, {"name": "y"}], "proposals": [{"surveyNumber": 545, "isAuto": True, "regate": {"attempts": [{"gate": "g"}]}}]}]}, {"stage": "m3", "reports": {"c": {"passed": False, "requests": [{"survey_number": "12/1A"}]}, "d": {"checks": []}}}]},
}


def instances(document):
    return nested.instances(document if document is None or isinstance(document, str) else json.dumps(document), paths(REPORTS))


def test_instances_keep_places_and_parents():
    rows = list(instances(BODY))
    short = [(e, pos, parent, at, child) for e, pos, parent, at, child, _ in rows]
    assert ("stage", 2, None, None, 2) in short
    assert [r for r in short if r[0] == "report"] == [("report", 0, "stage", 1, 0), ("report", 1, "stage", 1, 1), ("report", 2, "stage", 2, 0), ("report", 3, "stage", 2, 1)]
    assert [(r[3], r[4]) for r in short if r[0] == "check"] == [(0, 0), (1, 0), (1, 2)]
    members = {(r[0], r[1]): r[5] for r in rows}
    assert members["report", 2]["agent"] == "c" and members["report", 2]["passed"] == "false"
    assert members["check", 1]["evidence.surveys.1"] == "2" and members["check", 1]["evidence.m.iou"] == "0.5"
    assert members["proposal", 0]["survey_number"] == "545" and members["proposal", 0]["is_auto"] == "true"
    assert ("attempt", 0, "proposal", 0, 0) in short


def test_single_report_and_keyed_reports():
    single = {"reports": {"agent": "g", "checks": [{"name": "n"}]}}
    assert [(r[0], r[3]) for r in instances(single)] == [("report", None), ("check", 0)]
    assert [r[5].get("agent") for r in instances({"reports": {"g": {}, "h": {"notes": []}}})] == ["g", "h"]
    assert list(instances({"reports": {}})) == list(instances({"reports": None})) == []


def test_bodies_without_a_whole_document():
    whole = json.dumps(BODY)
    damaged = (None, "", "  ", "null", "12", "ERR timeout", whole[:-1], whole[:40], json.dumps(whole)[:-9], '"text"', whole.replace(": true", ": tru"), whole.replace("], ", ",], ", 1), '{"checks": [{"name": "a",}]}', '{"checks": [{"name": 01}]}', '{"checks": [{"name": "a"}}')
    assert [instances(b) for b in damaged] == [[]] * len(damaged)
    assert instances("\n \ufeff" + whole) == instances(json.dumps(json.dumps(whole))) == instances(whole + " trailing") == instances(json.dumps(BODY, indent=2)) != []


def test_every_cut_body_and_every_wrapping():
    whole = json.dumps({"checks": [{"name": "a\\u00e9\\n", "n": [1, [2.5, {"x": None}]], "t": True}, {"name": "b"}], "x": "}"}, ensure_ascii=False)
    assert not any(instances(whole[:n]) for n in range(len(whole)))
    assert instances(whole)[0][5] == {"name": "a\\u00e9\\n", "n.0": "1", "n.1.0": "2.5", "n.1.1.x": None, "t": "true"}
    wrapped = whole
    for _ in range(10):
        wrapped = json.dumps(wrapped)
    assert instances(wrapped) == instances(whole) and document_text(wrapped) == whole


def test_members_given_twice():
    assert [r[5] for r in instances('{"checks": [{"name": "a"}, {"name": "b"}], "checks": [{"name": "c", "name": "d"}]}')] == [{"name": "d"}]
    assert instances('{"checks": [{"name": "a"}], "checks": null}') == []


def test_deep_and_long_records():
    for depth in (500, 20_000, 100_000):
        assert [r[5] for r in instances("[" * depth + '{"checks": [{"name": "n"}]}' + "]" * depth)] == [{"name": "n"}]
    deep = '{"checks": [' + '{"m": ' * 30_000 + "1" + "}" * 30_000 + "]}"
    assert [len(next(iter(r[5]))) for r in instances(deep)] == [2 * 30_000 - 1]
    assert instances("[" * 100_000) == []
    many = {"reports": [{"checks": [{"name": str(i)} for i in range(30_000)]}]}
    assert sum(r[0] == "check" for r in instances(many)) == 30_000


def test_canonical_names():
    assert [canonical(k) for k in ("surveyNumber", "survey_number", "known-utm", "ID")] == ["survey_number", "survey_number", "known_utm", "id"]


def test_json_parts_and_pivot(spark):
    records = spark.createDataFrame([(1, json.dumps(BODY), "clash"), (1, json.dumps(BODY), "again"), (2, None, None), (3, "", None), (None, '{"checks": [{"name": "z"}]}', None)], "record_id long, body string, entity string")
    parts = json_parts(records, REPORTS)
    checks = pivot_part(parts, "check", ["name", "evidence.m.iou"]).distinct().collect()
    assert sorted((r.record_id or 0, r.parent_pos, r.child_pos, r.name, r.evidence_m_iou) for r in checks if r.record_id) == [(1, 0, 0, "only", None), (1, 1, 0, "x", "0.5"), (1, 1, 2, "y", None)]
    assert [r.name for r in checks if r.record_id is None] == ["z"]
    assert json_parts(records.limit(0), REPORTS).collect() == []


def test_nested_columns_go_through_the_same_operator(spark):
    schema = "id long, checks array<struct<name string, severity string>>, requests array<struct<survey_number string, known_utm array<double>>>"
    rows = [(1, [("a", "ok"), None, ("a", "ok")], None), (2, [], [("5", [1.0, 2.0])]), (3, None, None)]
    got = json_parts(as_bodies(spark.createDataFrame(rows, schema), "id", ["checks", "requests"], "reports"), REPORTS).where("entity <> 'report'").collect()
    assert sorted((r.record_id, r.entity, r.parent_pos, r.child_pos, r.members.get("name") or r.members.get("survey_number")) for r in got) == [(1, "check", 0, 0, "a"), (1, "check", 0, 2, "a"), (2, "request", 0, 0, "5")]
