"""What grows with the input: exchanges of a plan, partitions of a table, rows that are carried along."""

import pytest

from quillspan.plans import catalog, corpora, evaluation  # noqa: F401
from quillspan.plans import views as V

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, most", [("match_greedy", 2), ("iou_pairs", 2), ("match_near_miss", 2), ("match_unmatched", 2), ("score_per_family", 3), ("score_per_rule", 3), ("score_per_form", 2), ("score_overall", 3), ("score_rollup", 3), ("worst_forms", 2), ("gate_families", 4), ("report_deltas", 4), ("comb_runs", 1), ("char_runs", 1), ("label_duplication", 1)])
def test_orders_are_dealt_once(spark, name, most):
    """Detections, truth and strokes are each dealt out once by document, and folded, matched, told and summed where they are."""
    assert plan(catalog.QUERIES[name](spark, SMALL)).count("Exchange hashpartitioning") <= most


def test_unknown_types_do_not_match(spark):
    from quillspan.operators import matching

    boxes = "doc_id string, page int, {} int, type string, x0 int, y0 int, x1 int, y1 int"
    row = lambda t: [("d", 1, 0, t, 0, 0, 9, 9)]
    det, truth = spark.createDataFrame(row(None), boxes.format("di")), spark.createDataFrame(row(None), boxes.format("ti"))
    assert matching.match_greedy(det, truth).count() == 0
    assert sorted(r["side"] for r in matching.unmatched(det, truth).collect()) == ["det", "truth"]


def test_order_lines_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "TASK_ROWS", 500)
    assert V.lines_of(spark, SMALL).rdd.getNumPartitions() == 12


def test_halves_are_rounded_as_in_sql(spark):
    """42.25 is a half and goes to even; 0.15 lies below its half, 0.05 above."""
    from pyspark.sql import functions as F

    from quillspan.functions import text as X

    some = [42.25, 45.25, 42.75, 0.05, 0.15, 0.25, 0.95, 9.95, 49.95, 0.0, 3.14159, 0.00005, 0.00015, 0.00025, 1.00005, 0.99995] + [a / b for a in range(1, 400, 7) for b in range(1, 31)]
    got = spark.createDataFrame([(x,) for x in some], "x double").select("x", X.fixed(F.col("x"), 1).alias("one"), X.fixed(F.col("x"), 4).alias("four"), X.delta(-F.col("x")).alias("less")).collect()
    assert [(r["one"], r["four"]) for r in got] == [("%.1f" % r["x"], "%.4f" % r["x"]) for r in got]
    assert [r["less"] for r in got if r["x"]] == ["%+.4f" % -r["x"] for r in got if r["x"]]


def test_detection_gathers_no_scratch_table(spark, monkeypatch):
    """A scratch table's bytes tell little of its rows, so no plan of the rules broadcasts one by them; the session is left as it was."""
    from quillspan.operators import cells, detect
    from quillspan.sources import synthetic

    write, seen = detect.written, []

    def watched(df, name):
        seen.append(name)
        parts = plan(df).split("BroadcastExchange")[1:]
        assert all("LocalTableScan" in p.split("\n", 2)[1] or "ExistingRDD" in "".join(p.split("\n", 4)[1:4]) for p in parts), name
        return write(df, name)

    monkeypatch.setattr(detect, "written", watched)
    monkeypatch.setattr(cells, "written", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    made = synthetic.forms(spark, 2)
    detect.detect(made["chars"], made["words"], made["rects"], made["pages"])
    assert {"thresholds", "cells", "heads", "fields", "squares", "detected"} <= set(seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_lines_are_clustered_where_their_order_is(spark):
    """Strokes and the lines they fall into meet in each order's task: nothing is broadcast, and no top or line travels to be counted."""
    p = plan(catalog.QUERIES["line_cluster"](spark, SMALL))
    assert "Broadcast" not in p and p.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name, most", [("match_greedy", 1), ("match_unmatched", 1), ("score_per_form", 1), ("score_per_rule", 2), ("score_overall", 2), ("score_rollup", 2), ("gate_families", 3), ("report_deltas", 3)])
def test_both_sides_come_from_one_pass(spark, name, most):
    """Order lines are read, dealt out and sorted once for detections and truth alike, and no table of lines is hashed."""
    p = plan(catalog.QUERIES[name](spark, SMALL))
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") <= most
    assert p.count("Sort [o#") == 1 and "HashAggregate(keys=[o#" not in p


def test_sides_are_truth_and_detections(spark, tmp_path):
    """Repeated order lines count once, and ids run without a gap on both sides."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    lines.unionByName(lines.where("l_orderkey % 3 = 0")).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    shown = ["page", "type", "x0", "y0", "x1", "y1", "label", "rule", "family", "split"]
    both = V.sides(spark, str(tmp_path))
    for found, key, one in ((True, "di", V.det), (False, "ti", V.truth)):
        want = rows(one(spark, SMALL).select("doc_id", key, *shown))
        assert rows(both.where(f"found = {found}").select("doc_id", key, *shown)) == want == rows(one(spark, str(tmp_path)).select("doc_id", key, *shown))
        last = {r[0]: 0 for r in want}
        for r in sorted(want):
            assert r[1] == last[r[0]] + 1
            last[r[0]] += 1


def test_overlapping_boxes_are_taken_in_order(spark):
    """A page where every detection meets every truth, another where none has a rival, and one without a known page: the fold, and the way around it."""
    from quillspan.operators import matching

    boxes = "doc_id string, page int, {} int, type string, x0 int, y0 int, x1 int, y1 int"
    det = [("a", 1, i, "text", 20 - i, 10, i, 0) for i in (2, 1)] + [("b", 1, 1, "text", 0, 0, 9, 9), ("b", 1, 2, "checkbox", 0, 0, 9, 9), ("b", 1, 3, "text", 50, 0, 59, 9), ("c", None, 1, "text", 0, 0, 9, 9)]
    truth = [("a", 1, 1, "choice", 0, 0, 20, 10), ("a", 1, 2, "text", 2, 0, 18, 10), ("b", 1, 1, "text", 0, 0, 9, 9), ("b", 1, 2, "text", 50, 0, 59, 9), ("c", None, 1, "text", 0, 0, 9, 9)]
    d, t = spark.createDataFrame(det, boxes.format("di")), spark.createDataFrame(truth, boxes.format("ti"))
    assert {tuple(r)[:3] for r in matching.match_greedy(d, t).collect()} == {("a", 2, 2), ("a", 1, 1), ("b", 1, 1), ("b", 3, 2)}
    assert {tuple(r) for r in matching.unmatched(d, t).collect()} == {("det", "b", 2), ("det", "c", 1), ("truth", "c", 1)}


def test_widgets_are_planned_where_their_document_is(spark):
    """Fields are dealt out once by document; names and groups are found within its row."""
    p = plan(catalog.QUERIES["widget_plan"](spark, SMALL))
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 1 and "Join" not in p


def test_groups_of_check_boxes_have_one_name(spark):
    """The group's name is given when its first box is met, after that box's own, and skips names that fields have; other documents don't matter."""
    from quillspan.operators import corpus

    rows = [("a", 2, "g", "checkbox", "g"), ("a", 1, "g", "text", None), ("a", 3, "x", "checkbox", "g"), ("a", 4, "x", "text", "g"), ("a", 5, " ", "checkbox", ""), ("b", 1, "g", "checkbox", "g")]
    f = spark.createDataFrame([(d, o, 1, i, t, g, 0, 0, 9, 9) for d, o, i, t, g in rows], "doc_id string, ord long, page int, id string, type string, `group` string, x0 int, y0 int, x1 int, y1 int")
    got = {(r["doc_id"], r["ord"]): (r["name"], r["kind"], r["radio"]) for r in corpus.widget_plan(f).collect()}
    assert got == {("a", 1): ("g", "text", None), ("a", 2): ("g_2", "radio", "g_3"), ("a", 3): ("x", "radio", "g_3"), ("a", 4): ("x_2", "text", None), ("a", 5): ("field", "check", None), ("b", 1): ("g", "radio", "g_2")}


def test_gate_reads_no_documents_without_glyphs(spark):
    """A share over all glyphs needs none of the documents that have none: no pass over all strokes to find them, beside one over strokes, detections and the ink written."""
    from quillspan.plans import evaluation

    assert plan(evaluation.gate_inputs(spark, SMALL)[2]).count("FileScan") == 3


def test_words_in_cells_do_not_travel(spark):
    """What travels is a row for each page and cell, and no words are gathered or sorted to meet their cells."""
    p = plan(catalog.QUERIES["text_in_cell"](spark, SMALL))
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 1 and "Join" not in p


def test_words_at_the_edge_of_the_cells(spark, tmp_path):
    """Words that end at, before and after the last cell's right edge, empty ones on an edge between two cells, lines of one word, no text, no id."""
    import duckdb

    lines = [f"{'a' * n} {'b' * m} c" for n in (18, 19, 20, 39, 58, 59, 60, 61) for m in (0, 1, 2, 20, 40)] + ["", " ", "a" * 20 + "  b", "x" * 200, "ä ß " * 40]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, None), (None, "one two"), (4, "")] + [(10 + i, x) for i, x in enumerate(lines)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE["text_in_cell"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["text_in_cell"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 20


#: Null and negative keys, repeats, pages of one document; a line number that is missing.
ODD_LINES = [(1, 1, 26, 3), (1, 1, 26, 3), (1, 2, 39, 4), (1, 3, 39, 4), (2, 1, -39, -7), (2, 2, None, 3), (2, 3, 13, None), (None, 1, 5, 5), (None, None, 7, 5), (-3, 1, 11, 2), (-4, 1, -26, 12), (5, None, 52, 9)]


def _odd_lines(spark, folder):
    """Far more than ROWS of the test, so that documents meet the ends of batches."""
    many = [(o, 1 + i % 7, 7 * i % 101, 11 * i % 53) for i, o in enumerate(x for x in range(10, 90) for _ in range(x % 9 + 1))]
    spark.createDataFrame(ODD_LINES + many, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_sides_made_in_columns_are_those_of_the_views(spark, tmp_path):
    """score_per_form, score_rollup, score_overall: both sides are made of the order lines where they are matched; no window, no list, one exchange before it."""
    d = _odd_lines(spark, tmp_path)
    made = V.order_sides(spark, d)
    names = ["found", *[n for n in made.types if n not in ("found", "family_type")]]
    both = lambda df: sorted(map(repr, (tuple(r[n] if r["found"] or n != "di" else None for n in names if n != "ti" or not r["found"]) for r in df.collect())))
    from pyspark.sql.types import StructField, StructType

    order = list(made.types)
    got = made.run(lambda b: iter([b.select(order)]), StructType([StructField(n, t) for n, t in made.types.items()]))
    assert both(got) == both(V.sides(spark, d))
    assert {r["family_type"] for r in got.collect()} == {"text", "checkbox"}


@pytest.mark.parametrize("rows, pairs", [(100_000, 1 << 21), (3, 2)])
def test_scores_by_batches_are_those_by_rows(spark, tmp_path, monkeypatch, rows, pairs):
    """Sums of any keys are the same whether documents come a few at a time or all at once, from views or made in columns; no page is an array in a row."""
    from quillspan.operators import matching, metrics

    d = _odd_lines(spark, tmp_path)
    sums = lambda m: {tuple(r) for r in metrics.by(m, "split", "doc_id").select("split", "doc_id", *metrics.MEASURES).collect()}
    want = sums(metrics.measures(V.det(spark, d), V.truth(spark, d)))
    # the workers read these from the module that they import
    made = V.order_sides(spark, d)
    whole, met = matching._whole_documents, matching._met
    monkeypatch.setattr(matching, "ROWS", rows)
    monkeypatch.setattr(matching, "PAIRS", pairs)
    import pyarrow as pa

    lines = sorted(made.rows.collect(), key=lambda r: tuple((x is not None, x or 0) for x in r))
    batches = [pa.RecordBatch.from_pylist([r.asDict() for r in lines[i : i + 4]], pa.schema([(c, pa.int64()) for c in "olps"])) for i in range(0, len(lines), 4)]
    parts = [made.make(b) for b in whole(iter(batches))]
    assert len(parts) > 1 or rows > len(lines)
    pairs_met = [sorted(zip(b.column("doc_id").take(pa.array(i)).to_pylist(), b.column("di").take(pa.array(i)).to_pylist(), b.column("ti").take(pa.array(j)).to_pylist(), iou.tolist())) for b in parts for i, j, iou in [met(b)]]
    assert sorted(p for some in pairs_met for p in some) == sorted(tuple(r) for r in matching.candidate_pairs(made, least=matching.NEAR).select("doc_id", "di", "ti", "iou").collect())
    assert sums(metrics.measures(made, None, ["split", "doc_id"])) == want == {tuple(r)[:9] for r in metrics.scores(made, None, "split", "doc_id").collect()}
    assert sum(r["truth"] for r in metrics.rollup(metrics.measures(made, None, *metrics.ROLLUP)).where("scope = 'form'").collect()) == sum(r[2] for r in want)
    for name in ("score_per_form", "score_rollup", "score_overall"):
        shown = plan(catalog.QUERIES[name](spark, d))
        assert "collect_list" not in shown and "Window" not in shown and "Expand" not in shown
