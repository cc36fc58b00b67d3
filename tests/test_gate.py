"""The gate's checks one by one, text tables, and made-up forms through detection."""

import pytest

from quillspan.operators import detect, gate
from quillspan.sources import synthetic

RUNS = "run string, scope string, key string, truth long, f1 double, precision double, label_accuracy double"
BASE = [("overall", "", 100, 0.8, 0.9, 0.7), ("holdout", "", 50, 0.8, 0.9, 0.7), ("family", "a", 60, 0.8, 0.9, None), ("family", "b", 0, 0.8, 0.9, None)]
GUARD = {"glyph_coverage": 1.0, "box_over_ink": 0.1, "label_plausibility": 0.3}


def judge(spark, changed=(), gone=(), failures=(), guards=None, offenders=()):
    by = {(s, k): (s, k, *r) for s, k, *r in BASE}
    by.update({(s, k): (s, k, *r) for s, k, *r in changed})
    runs = [("baseline", *r) for r in BASE] + [("candidate", *r) for k, r in by.items() if k not in gone]
    g = [("baseline", k, v) for k, v in GUARD.items()] + [("candidate", k, v) for k, v in (GUARD | (guards or {})).items()]
    found = gate.reasons(spark.createDataFrame(runs, RUNS), spark.createDataFrame(list(failures), "run string, form string, reason string"), spark.createDataFrame(g, "run string, guard string, value double"), spark.createDataFrame(list(offenders), "run string, guard string, form string, id string"))
    r = gate.verdict(found).first()
    return r["passed"], r["fails"], r["warns"]


@pytest.mark.parametrize(
    "case, want",
    [
        ({}, (True, [], [])),
        ({"changed": [("overall", "", 100, 0.7985, 0.9, 0.69)]}, (True, [], [])),
        ({"changed": [("overall", "", 100, 0.797, 0.89, 0.67)]}, (False, ["overall_f1", "label_accuracy", "precision"], [])),
        ({"changed": [("holdout", "", 0, 0.0, 0.0, None)]}, (True, [], ["holdout_f1"])),
        ({"changed": [("holdout", "", 50, 0.7, 0.9, 0.7), ("overall", "", 100, 0.8, 0.9, None)]}, (False, ["holdout_f1"], ["label_accuracy"])),
        ({"gone": [("family", "a"), ("family", "b")]}, (False, ["family_f1:a"], [])),
        ({"failures": [("baseline", "x", "crash"), ("candidate", "x", "timeout"), ("candidate", "y", "memory"), ("candidate", "z", "rejected")]}, (False, ["new_failure:y"], [])),
        ({"guards": {"glyph_coverage": 0.97, "box_over_ink": 0.12}, "offenders": [("baseline", "box_over_ink", "f", "1"), ("candidate", "box_over_ink", "f", "1")]}, (False, ["glyph_coverage"], ["box_over_ink"])),
        ({"guards": {"label_plausibility": 0.4}, "offenders": [("candidate", "label_plausibility", "f", "1")]}, (False, ["label_plausibility"], [])),
    ],
)
def test_gate(spark, case, want):
    assert judge(spark, **case) == want


def test_text_table(spark):
    rows = spark.createDataFrame([(2, "R10", 3.0), (1, "R2", None)], "o int, rule string, f1 double")
    assert [r["line"] for r in gate.text_table(rows, "o", ["rule", "f1"]).orderBy("line_no").collect()] == ["rule  f1", "----  ---", "R2", "R10   3.0"]
    assert [r["line"] for r in gate.text_table(rows.where("false"), "o", ["rule", "f1"]).orderBy("line_no").collect()] == ["rule  f1", "----  --"]


def test_synthetic_forms_are_read(spark):
    """Every field of easy forms is found with its rule, type, label and box, and nothing else."""
    made = {k: v.collect() for k, v in synthetic.forms(spark, 8, seed=3).items()}
    again = synthetic.forms(spark, 8, seed=3)["truth"].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, made["truth"]))
    local = {k: spark.createDataFrame(v, synthetic.forms(spark, 8, seed=3)[k].schema) for k, v in made.items()}
    got = detect.detect(local["chars"], local["words"], local["rects"], local["pages"]).collect()
    row = lambda r: (r["doc_id"], r["type"], r["rule"], r["label"], *[round(r[c], 1) for c in ("x0", "y0", "x1", "y1")])
    assert len(made["truth"]) > 40 and {r["rule"] for r in made["truth"]} >= {"R1", "R2", "R3", "R4", "R5", "R5b"}
    assert {row(r) for r in got} == {row(r) for r in made["truth"]}
