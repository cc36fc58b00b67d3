"""The corpus operators on cases with known answers."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import CHECK_GLYPHS
from quillspan.operators import corpus
from quillspan.sources.documents import PAGE_OBJECTS as P

FACTS = "doc_id string, bytes long, locked boolean, pages int, malformed string, has_acroform boolean, producer string, creator string, chars long, thin_v long, thin_h long"
GOOD = dict(bytes=1000, locked=False, pages=2, malformed=None, has_acroform=False, producer="p", creator=None, chars=100, thin_v=0, thin_h=0)


@pytest.mark.parametrize(
    "change, verdict, reason",
    [
        ({}, "flat-sparse", None),
        ({"thin_v": 21, "thin_h": 21}, "flat-wordlike", None),
        ({"thin_v": 20, "thin_h": 21}, "flat-sparse", None),
        ({"chars": 99}, "scan", "49.5 characters a page"),
        ({"has_acroform": True}, "fillable-other", None),
        ({"has_acroform": True, "creator": "Adobe LiveCycle"}, "fillable-livecycle", None),
        ({"has_acroform": True, "chars": 10}, "scan", "5.0 characters a page"),
        ({"bytes": None}, "unusable", "unreadable"),
        ({"bytes": 0}, "unusable", "empty file"),
        ({"bytes": (20 << 20) + 1}, "unusable", "too large"),
        ({"locked": True, "pages": 0}, "unusable", "encrypted"),
        ({"pages": 0}, "unusable", "zero pages"),
        ({"pages": 31, "malformed": "x"}, "unusable", "over 30 pages (31)"),
        ({"malformed": "x"}, "unusable", "malformed: x"),
    ],
)
def test_classify(spark, change, verdict, reason):
    r = corpus.classify(spark.createDataFrame([{"doc_id": "d"} | GOOD | change], FACTS)).first()
    assert (r["verdict"], r["reason"]) == (verdict, reason)


def test_outcomes(spark):
    rows = [
        ("good", None, None, 0, False, [1.0, 2.0], 3, 3, 7, "ok", False),
        ("nan", None, None, 0, False, [1.0, float("nan")], 3, 3, 7, "crash", False),
        ("schema", None, None, 0, True, [1.0], 3, 3, 7, "crash", False),
        ("pages", None, None, 0, False, [1.0], 2, 3, 7, "ok", True),
        ("many", None, None, 0, False, [], 3, None, 50_001, "ok", True),
        ("clean", "pdfminer.pdfparser.PDFSyntaxError: no", None, 1, None, None, None, 3, None, "rejected", False),
        ("bug", "KeyError: x", None, 1, None, None, None, 3, None, "crash", False),
        ("slow", None, "SIGXCPU", -24, None, None, None, 3, None, "timeout", False),
        ("big", None, "SIGKILL", -9, None, None, None, 3, None, "memory", False),
        ("gone", None, None, 3, None, None, None, 3, None, "crash", False),
    ]
    df = spark.createDataFrame([r[:9] for r in rows], "name string, exception string, signal string, exit_code int, bad_schema boolean, numbers array<double>, pages int, expected_pages int, fields long")
    assert {r["name"]: (r["status"], r["suspicious"]) for r in corpus.outcomes(df).collect()} == {r[0]: r[9:] for r in rows}


def test_widgets_and_truth(spark):
    annots = [
        ("d", 1, 1, "/Widget", 0, 0, "/Tx", None, [50.0, 40.0, 10.0, 20.0]), ("d", 1, 2, "/Widget", 0, 0, None, "/Ch", [0.0, 0.0, 3.9, 10.0]), ("d", 1, 3, "/Widget", 2, 0, "/Tx", None, [0.0, 0.0, 9.0, 9.0]),
        ("d", 1, 4, "/Widget", 0, 1, "/Tx", None, [0.0, 0.0, 9.0, 9.0]), ("d", 1, 5, "/Link", 0, 0, "/Tx", None, [0.0, 0.0, 9.0, 9.0]), ("d", 1, 6, "/Widget", 4, 2, None, "/Btn", [60.0, 60.0, 70.0, 70.0]),
        ("d", 1, 7, "/Widget", None, None, "/Sig", "/Btn", [0.0, 0.0, 9.0, 9.0]),
    ]
    df = spark.createDataFrame(annots, "doc_id string, page int, ix int, subtype string, flags int, field_flags int, ft string, parent_ft string, rect array<double>")
    got = corpus.widgets_of(df)
    assert {r["ix"]: (r["type"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got.collect()} == {1: ("text", 10.0, 20.0, 50.0, 40.0), 6: ("checkbox", 60.0, 60.0, 70.0, 70.0), 7: ("text", 0.0, 0.0, 9.0, 9.0)}
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0)], P["pages"])
    rects = spark.createDataFrame([("d", 1, 0, 0.0, 100.0, 86.0, 87.0, 100.0, 1.0, True, False), ("d", 1, 1, 55.0, 75.0, 25.0, 45.0, 20.0, 20.0, True, False)], P["rects"])
    chars = spark.createDataFrame([("d", 1, 0, CHECK_GLYPHS[0], 52.0, 55.0, 30.0, 40.0), ("d", 1, 1, "x", 2.0, 8.0, 92.0, 99.0)], P["chars"])
    near = lambda c: {r["ix"] for r in corpus.keep_reachable(got, rects, c, pages).collect()}
    assert near(chars) == {1, 6, 7} and near(chars.where("text = 'x'")) == {1, 7} and corpus.truth_widgets(df, rects, chars, pages).count() == 0
    facts = corpus.page_facts(chars, rects).first()
    assert (facts["chars"], facts["glyphs"], facts["underscores"], facts["thin_v"], facts["thin_h"]) == (2, 1, 0, 0, 1)


def test_scans_and_flat_files(spark):
    pages = spark.createDataFrame([("d", p, 100.0, 100.0 if p < 4 else 0.0) for p in (1, 2, 3, 4)], P["pages"])
    chars = spark.createDataFrame([("d", 2, i, "x", 0.0, 1.0, 0.0, 1.0) for i in range(20)] + [("d", 1, i, "\u00a0", 0.0, 1.0, 0.0, 1.0) for i in range(30)], P["chars"])
    images = spark.createDataFrame([("d", p, 0, 100.0, 50.0 if p != 3 else 49.0) for p in (1, 2, 3, 4)], P["images"])
    assert {r["page"]: r["scanned"] for r in corpus.scanned_pages(chars, images, pages).collect()} == {1: True, 2: False, 3: False, 4: False}
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    manifest = spark.createDataFrame([("a", "flat-sparse"), ("b", "scan")], "file string, verdict string")
    assert [r["file"] for r in corpus.flat_documents(manifest, files).collect()] == ["a"]
    assert corpus.flat_documents(manifest.where("file = 'b'"), files).count() == 2
    fonts = spark.createDataFrame([("d", f) for f in "aabbbcdefg"] + [("d", None)], "doc_id string, font string")
    assert corpus.common_fonts(fonts).first()["fonts"] == ["b", "a", "c", "d", "e"]
    shares = corpus.feature_share(spark.createDataFrame([("d", "x"), ("e", "x"), ("e", "x"), ("e", "y")], "doc_id string, tag string"))
    assert {r["tag"]: r["share"] for r in shares.collect()} == {"x": 1.0, "y": 0.5}


def test_widget_plan(spark):
    rows = [(1, "a", "text", None, 0.0, 4.0, 0.0, 30.0), (2, "a", "checkbox", "a", 0.0, 10.0, 0.0, 10.0), (3, " ", "checkbox", "a", 0.0, 10.0, 0.0, 10.0), (4, "a_2", "multiline", "a", 0.0, 10.0, 0.0, 15.0), (5, None, "checkbox", None, 0.0, 10.0, 0.0, 3.0)]
    df = spark.createDataFrame([("d", n, 1, *r) for n, *r in rows], "doc_id string, ord long, page int, id string, type string, group string, x0 double, x1 double, y0 double, y1 double")
    got = {r["ord"]: (r["name"], r["kind"], r["radio"], r["width"], r["height"], r["font_size"], r["multiline"]) for r in corpus.widget_plan(df).collect()}
    assert got == {
        1: ("a", "text", None, 6.0, 30.0, 12.0, False), 2: ("a_2", "radio", "a_3", 10.0, 10.0, None, False), 3: ("field", "radio", "a_3", 10.0, 10.0, None, False),
        4: ("a_2_2", "text", None, 10.0, 15.0, pytest.approx(9.3), True), 5: ("field_2", "check", None, 10.0, 6.0, None, False),
    }


def test_probes(spark):
    results = spark.createDataFrame([("bad", "E", None, 1, None, None, None), ("miss", None, 0, 2, 0.0, 0.0, 0.0), ("prose", None, 0, 1, 0.0, 0.0, 0.0), ("fine", None, 4, 2, 0.5, 0.2, 0.1), ("new", None, 0, 1, None, None, None)], "doc_id string, error string, fields int, pages int, label_plausibility double, box_over_ink double, stacked_fraction double")
    facts = spark.createDataFrame([("miss", 1, 0, 0, 0), ("prose", 0, 2, 9, 9), ("fine", 0, 0, 0, 0), ("bad", 0, 0, 0, 0)], "doc_id string, glyphs long, underscores long, thin_h long, thin_v long")
    p = corpus.probes(results, facts)
    assert {r["doc_id"]: r["suspicion"] for r in p.collect()} == pytest.approx({"bad": 1e9, "miss": 1e8, "prose": -1.0, "fine": 50 + 10 + 2 + 0.5, "new": 1e8})
    assert tuple(corpus.blind_summary(p).first()) == (5, 1, 2, 1) and [r["doc_id"] for r in corpus.most_suspect(p, 2).collect()] == ["bad", "miss"]
    assert p.where(F.col("doc_id") == "fine").first()["fields_per_page"] == 2.0
