"""Stored results read back: kinds of JSON values, versions, invariants, multisets."""

import copy
import json

import pytest

from quaylight.operators import publish, stored

ENTRY = {"reason_code": "x", "rule_id": "R001_GITHUB_TOKEN", "rule_name": None, "finding_count": 2, "occurrence_deductions": [25, 19], "deduction_before_rule_cap": 44, "rule_cap": 50, "applied_deduction": 44, "description": "in /home/me/x"}
GOOD = {"schema_version": 1, "score": 56, "score_before_caps": 56, "verdict": "warning", "score_breakdown": [ENTRY], "score_caps": [{"reason_code": "c", "cap_value": 74, "applied": True}], "blocking_reasons": [{"rule_id": "R", "file_path": "/etc/x"}], "coverage": {"status": "complete", "reasons": ["a"], "total_findings": 2}}


def read(spark, bodies):
    rows = [(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return stored.checked_assessments(spark.createDataFrame(rows, "task_id int, body string"))


def changed(**fields):
    return copy.deepcopy(GOOD) | fields


def test_each_wrong_kind_is_set_aside_with_its_reason(spark):
    bodies = {
        None: [GOOD, {"verdict": "pass"}, changed(extra={"a": [1]}), changed(score_breakdown=[]), changed(score=0), changed(score=100), changed(score_breakdown=[ENTRY | {"finding_count": -1}])],
        "not_json": [None, "", "{", "nonsense"],
        "not_an_object": ["[]", "1", "null", '"text"'],
        "schema_version": [changed(schema_version=2), changed(schema_version="1")],
        "lists": [changed(score_breakdown={}), changed(score_caps=1), changed(blocking_reasons=None)],
        "coverage": [changed(coverage=[]), changed(coverage={"total_findings": True}), changed(coverage={"reasons": [1]}), changed(coverage={"findings_truncated": 0})],
        "score": [changed(score="56"), changed(score=True), changed(score=5.5), changed(score=101), changed(score=-1), changed(score=None)],
        "score_before_caps": [changed(score_before_caps=1e300), changed(score_before_caps=101)],
        "verdict": [changed(verdict=None), changed(verdict="PASS"), changed(verdict=1)],
        "score_breakdown": [changed(score_breakdown=[1]), changed(score_breakdown=[ENTRY | {"rule_cap": "50"}]), changed(score_breakdown=[ENTRY | {"occurrence_deductions": [1, "2"]}]), changed(score_breakdown=[ENTRY, ENTRY | {"rule_id": 5}])],
        "score_caps": [changed(score_caps=[{"applied": 1}]), changed(score_caps=[[]])],
        "blocking_reasons": [changed(blocking_reasons=["x"]), changed(blocking_reasons=[{"severity": 3}])],
    }
    flat = [(reason, b) for reason, bs in bodies.items() for b in bs]
    got = {r["task_id"]: r["reason"] for r in read(spark, [b for _, b in flat]).collect()}
    assert [(flat[i][1], got[i]) for i in range(len(flat)) if got[i] != flat[i][0]] == []
    checked = read(spark, [b for _, b in flat])
    assert stored.rejected(checked).count() + stored.accepted(checked).count() == len(flat)


def test_versions_are_read_under_todays_names_with_defaults_and_masks(spark):
    new = {k: v for k, v in ENTRY.items() if k not in ("rule_cap", "applied_deduction")} | {"max_deduction": 50, "deduction": 44, "rule_name": "Own"}
    rows = {r["task_id"]: r for r in stored.accepted(read(spark, [GOOD, changed(score_breakdown=[new]), changed(score_breakdown=[new | {"applied_deduction": 1, "rule_id": "Z", "rule_name": ""}]), {"verdict": "pass"}])).collect()}
    old, now, both, least = (rows[i] for i in range(4))
    assert (old["score_breakdown"][0]["max_deduction"], old["score_breakdown"][0]["deduction"], old["score_breakdown"][0]["rule_name"]) == (50, 44, "GitHub Token")
    assert now["score_breakdown"][0]["rule_name"] == "Own" and both["score_breakdown"][0]["rule_name"] == "Z" and both["score_breakdown"][0]["deduction"] == 44
    assert old["score_breakdown"][0]["description"] == "in <redacted-path>" and old["blocking_reasons"][0]["file_path"] == "<redacted-path>"
    assert least["score"] == 0 and least["score_breakdown"] == [] and least["coverage"]["total_findings"] == 0 and least["coverage"]["findings_truncated"] is False


GROUP = {"group_id": "RG001", "action_code": "RERUN_SECURITY_SCAN", "finding_count": 1, "blocking": True, "highest_severity": "high", "highest_confidence": "low", "related_rule_ids": ["A", "B"], "related_files_truncated": False}
REVIEW = GROUP | {"group_id": "RG002", "action_code": "MANUAL_REVIEW_REQUIRED", "blocking": False}
PLAN = {
    "schema_version": 1, "policy_version": stored.REPAIR_POLICY, "repair_scope": stored.REPAIR_SCOPE, "task_id": "t", "plan_status": "partial",
    "summary": {"total_repair_groups": 2, "blocking_repair_groups": 1, "manual_review_required": True, "coverage_warning": True, "groups_truncated": False},
    "repair_groups": [GROUP, REVIEW], "agent_prompt": f"see https://x.org\n{stored.PROMPT_HEAD}\n- [X]", "source_scan_updated_at": "s",
}
COMPLETE = PLAN | {"plan_status": "complete", "repair_groups": [GROUP], "summary": {"total_repair_groups": 1, "blocking_repair_groups": 1, "manual_review_required": False, "coverage_warning": False, "groups_truncated": False}}


def violations(spark, plan, status=None, total=None, blocking=None, source="s"):
    body = plan if isinstance(plan, str) else json.dumps(plan)
    summary = plan["summary"] if isinstance(plan, dict) and isinstance(plan.get("summary"), dict) else {}
    row = ("t", body, status or (plan["plan_status"] if isinstance(plan, dict) else "complete"), total if total is not None else summary.get("total_repair_groups"), blocking if blocking is not None else summary.get("blocking_repair_groups"), source)
    rows = spark.createDataFrame([row], "task_id string, body string, plan_status string, total_repair_groups long, blocking_repair_groups long, source_scan_updated_at string")
    return {r["violation"] for r in stored.violations(stored.plan_facts(rows)).collect()}


def within(plan, **summary):
    return plan | {"summary": plan["summary"] | summary}


def test_every_invariant_is_broken_by_some_plan_and_none_by_good_ones(spark):
    assert violations(spark, PLAN) == violations(spark, COMPLETE) == set()
    cut = [GROUP | {"related_files_truncated": True, "action_code": "UPDATE_GITIGNORE"}]
    cases = {
        "typed": "{", "schema_version": PLAN | {"schema_version": 2}, "policy_version": PLAN | {"policy_version": "x"}, "repair_scope": PLAN | {"repair_scope": "x"}, "task_id": PLAN | {"task_id": "u"},
        "plan_status": PLAN | {"plan_status": "done"}, "coverage_warning": within(PLAN, coverage_warning=False), "trigger_in_complete": within(PLAN | {"plan_status": "complete"}, coverage_warning=False),
        "cut_in_complete": within(COMPLETE, groups_truncated=True), "cut_without_review": COMPLETE | {"repair_groups": cut}, "cut_without_scan": COMPLETE | {"repair_groups": cut},
        "partial_without_reason": within(COMPLETE | {"plan_status": "partial"}, coverage_warning=True), "total": within(PLAN, total_repair_groups=3), "blocking": within(PLAN, blocking_repair_groups=2), "manual": within(PLAN, manual_review_required=False),
        "group_ids": PLAN | {"repair_groups": [REVIEW, GROUP]}, "actions": PLAN | {"repair_groups": [GROUP | {"action_code": "NONE"}, REVIEW]}, "rule_ids": PLAN | {"repair_groups": [GROUP | {"related_rule_ids": ["B", "A"]}, REVIEW]},
        "prompt_characters": PLAN | {"agent_prompt": "a\u200bb"}, "prompt_content": PLAN | {"agent_prompt": f"{stored.PROMPT_HEAD} https://x.org"}, "prompt_length": PLAN | {"agent_prompt": "x" * (publish.MAX_PROMPT_CHARS + 1)},
    }
    for name, plan in cases.items():
        assert name in violations(spark, plan), name
    assert "status_column" in violations(spark, PLAN, status="complete")
    assert "total_column" in violations(spark, PLAN, total=9) and "blocking_column" in violations(spark, PLAN, blocking=9) and "source_column" in violations(spark, PLAN, source="other")
    assert set(cases) | {"status_column", "total_column", "blocking_column", "source_column"} == set(stored.INVARIANTS)


@pytest.mark.parametrize("plan", [PLAN | {"schema_version": "1"}, PLAN | {"summary": []}, within(PLAN, total_repair_groups=True), PLAN | {"repair_groups": [GROUP, 1]}, PLAN | {"repair_groups": [GROUP | {"finding_count": "1"}]}, {k: v for k, v in PLAN.items() if k != "agent_prompt"}, PLAN | {"repair_groups": [GROUP | {"related_rule_ids": [1]}]}])
def test_plans_of_wrong_kinds_are_told_of_once(spark, plan):
    assert violations(spark, plan, total=2, blocking=1) == {"typed"}


def test_differences_count_how_often_a_row_lacks(spark):
    a = spark.createDataFrame([("t", 1), ("t", 1), ("t", 2), ("u", None)], "k string, v int")
    b = spark.createDataFrame([(1, "t"), (3, "t"), (None, "u"), (None, "u")], "v int, k string")
    assert sorted((r["k"], str(r["v"]), r["side"]) for r in stored.differences(a, b).collect()) == [("t", "1", "stored"), ("t", "2", "stored"), ("t", "3", "made"), ("u", "None", "made")]
