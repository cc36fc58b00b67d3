"""Matching, metrics, folds and rules against exact values and plain re-specifications."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions import text as X
from quillspan.functions.geometry import iou, rect
from quillspan.operators import crawl, detect, guards, matching, ordered
from quillspan.plans import catalog
from quillspan.sources import documents, sinks
from quillspan.streaming import incremental

BOX = "doc_id long, page long, {0} long, type string, x0 long, y0 long, x1 long, y1 long"


def one(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(f(F.col("s"))).collect()]


def test_iou(spark):
    cases = [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((10, 10, 0, 0), (15, 10, 5, 0), 1 / 3), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in cases], "ax0 int, ay0 int, ax1 int, ay1 int, bx0 int, by0 int, bx1 int, by1 int")
    side = lambda p: tuple(F.col(f"{p}{k}") for k in ("x0", "y0", "x1", "y1"))
    from quillspan.functions.geometry import normalise

    assert [r[0] for r in df.select(iou(normalise(*side("a")), normalise(*side("b")))).collect()] == pytest.approx([c[2] for c in cases])


def test_greedy_against_plain(spark):
    rng = random.Random(5)
    boxes = lambda n, at: [(d, 1, i, rng.choice(["text", "choice", "checkbox"]), x, y, x + 10, y + 10) for d in range(12) for i in range(n) for x, y in [(rng.randrange(0, 24, 2), rng.randrange(0, 8, 2))]]
    dets, truth = boxes(9, 0), boxes(8, 1)
    fam = lambda t: "checkbox" if t == "checkbox" else "text"

    def score(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        i = max(0, w) * max(0, h)
        return i / (200 - i)

    want = set()
    pairs = sorted((-score(a, b), a[2], b[2], a[0]) for a in dets for b in truth if a[0] == b[0] and fam(a[3]) == fam(b[3]) and score(a, b) >= 0.5)
    used_d, used_t = set(), set()
    for _, i, j, d in pairs:
        if (d, i) not in used_d and (d, j) not in used_t:
            used_d.add((d, i))
            used_t.add((d, j))
            want.add((d, i, j))
    got = matching.match_greedy(spark.createDataFrame(dets, BOX.format("di")), spark.createDataFrame(truth, BOX.format("ti")))
    assert {(r["doc_id"], r["di"], r["ti"]) for r in got.collect()} == want


def test_text_functions(spark):
    leaders = {"..": "", "\u2026\u2026x": "\u2026x", ". .\t.": "", "Sum ... ": "Sum", "\u00b7\u00b7, Rate": "Rate", "e.g. this": "e.g. this", ".5 litres": ".5 litres", "Weight kg.": "Weight kg.", ", . . x": ", . . x", "a .. b": "a .. b", "": ""}
    assert one(spark, list(leaders), X.strip_leaders) == list(leaders.values())
    assert one(spark, ["Name:", "Date (dd/mm/yyyy) :", " A  B ", "Straße"], X.normalize_label) == ["name", "date", "a b", "strasse"]
    assert one(spark, ["Name of Child!", "---", "x" * 50], X.slug) == ["name_of_child", "field", "x" * 40]
    assert one(spark, ["Do you smoke? (Never)", "Pick 1 (Never)", "Send to: (Office)", "Smoker? (a) (b)"], X.option_of) == ["Never", None, "Office", None]
    kinds = {
        "Start (dd/mm/yyyy)": "date", "Left on mm/dd/ccyy, roughly": "date", "DD/MM/YYYY of entry": "date", "yyyy-mm-dd": "date", "Renewal dates": "date", "dob": "date",
        "Paid up to (Month/Year)": "month", "Card expires mm/yy": "month", "Month": "month",
        "Number of dogs": "integer", "How many rooms": "integer", "Her age": "integer", "Total quantity": "integer",
        "Fax number of the firm": None, "Policy no. of holder": None, "Passport number": None, "Unit # count": None, "Surname": None, "Mandate": None, "Page": None,
    }
    assert dict(zip(kinds, one(spark, list(kinds), X.field_kind))) == kinds
    assert one(spark, [" a\u00a0b  c\u3000d ", ""], X.tokenize) == [["a", "b", "c", "d"], []]


def test_folds_against_plain(spark):
    rng = random.Random(2)
    rows = [(d, 1, i, float(x), float(x + rng.choice([40, 42, 80])), float(t), float(t + 1), 40.0, 1.0) for d in range(10) for i in range(25) for x, t in [(rng.choice([0, 1, 3, 60]), rng.randrange(0, 40))]]
    df = spark.createDataFrame(rows, "doc_id long, page long, rect_ix long, x0 double, x1 double, top double, bottom double, width double, height double")
    by = lambda d: [r for r in rows if r[0] == d]
    merged, columns = {}, {}
    for d in range(10):
        out = []
        for r in sorted(by(d), key=lambda r: (r[5], r[3], r[4], r[6])):
            for e in out:
                if r[5] - e[3] <= 3 and abs(r[3] - e[0]) <= 2 and abs(r[4] - e[1]) <= 2:
                    e[:] = [min(e[0], r[3]), max(e[1], r[4]), min(e[2], r[5]), max(e[3], r[6]), e[4] + 1]
                    break
            else:
                out.append([r[3], r[4], r[5], r[6], 1])
        merged[d] = sorted(map(tuple, out))
        cols = []
        for x in sorted(r[3] for r in by(d)):
            for c in cols:
                if abs(x - c[0] / c[1]) <= 16:
                    c[:] = [c[0] + x, c[1] + 1]
                    break
            else:
                cols.append([x, 1])
        columns[d] = [(s / n, n) for s, n in cols]
        lines, last = 0, None
        for t in sorted({r[5] for r in by(d)}):
            if last is None or t - last > 2.5:
                lines, last = lines + 1, t
        merged[d, "lines"] = lines
    got = ordered.merge_rules(df).collect()
    for d in range(10):
        assert sorted((r["x0"], r["x1"], r["top"], r["bottom"], r["n"]) for r in got if r["doc_id"] == d) == merged[d]
    got = ordered.cluster_columns(df).collect()
    assert all([(r["x0"], r["n"]) for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["column"])] == columns[d] for d in range(10))
    got = ordered.cluster_lines(df).groupBy("doc_id").agg(F.countDistinct("line").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {d: merged[d, "lines"] for d in range(10)}


def test_comb_and_names(spark):
    ticks = [(1, 1, float(10 * i), float(10 * i + 1), 5.0, 25.0, 1.0, 20.0) for i in range(8)] + [(1, 1, 200.0 + 30 * i, 201.0 + 30 * i, 5.0, 25.0, 1.0, 20.0) for i in range(8)]
    df = spark.createDataFrame(ticks, "doc_id long, page long, x0 double, x1 double, top double, bottom double, width double, height double")
    assert [(r["x0"], r["x1"], r["ticks"]) for r in ordered.comb_runs(df).collect()] == [(0.0, 70.0, 8)]
    names = spark.createDataFrame([(1, i, n) for i, n in enumerate(["name", "name", "name_2", "name", "b"])], "doc_id long, ord long, base string")
    assert [r["name"] for r in ordered.unique_names(names).orderBy("ord").collect()] == ["name", "name_2", "name_2_2", "name_3", "b"]


def test_synthetic_page(spark):
    """One underscore line and one filled square, with the exact rectangles known for them."""
    pages = spark.createDataFrame([("d", 1, 200.0, 100.0)], documents.PAGE_OBJECTS["pages"])
    words = spark.createDataFrame([("d", 1, 0, "Name", 10.0, 40.0, 10.0, 20.0), ("d", 1, 1, "__________", 42.0, 72.0, 10.0, 20.0), ("d", 1, 2, "Agree", 35.0, 65.0, 55.0, 65.0)], documents.PAGE_OBJECTS["words"])
    chars = spark.createDataFrame([("d", 1, i, "_", 42.0 + 3 * i, 45.0 + 3 * i, 10.0, 20.0) for i in range(10)], documents.PAGE_OBJECTS["chars"])
    rects = spark.createDataFrame([("d", 1, 0, 10.0, 30.0, 50.0, 70.0, 20.0, 20.0, True, False)], documents.PAGE_OBJECTS["rects"])
    got = {(r["rule"], r["type"], r["label"], r["x0"], r["y0"], r["x1"], r["y1"], r["id"]) for r in detect.detect(chars, words, rects, pages).collect()}
    assert got == {("R5", "text", "Name", 43.0, 81.0, 71.0, 101.0, "p1_name"), ("R18", "checkbox", "Agree", 10.0, 30.0, 30.0, 50.0, "p1_chk")}


@pytest.mark.parametrize(
    "words, more, curves, earlier, want",
    [
        ([("Accept", 45, 55)], [], [], [], ["Accept"]),
        ([("Accept", 45, 55), ("terms", 78, 55), ("far", 130, 55)], [], [], [], ["Accept terms"]),
        ([("Accept", 45, 48)], [], [], [], []),
        ([("Yes", 45, 55), ("No", 120, 55)], [(80, 100)], [], [], ["Yes", "No"]),
        ([("Accept", 45, 55)], [(10, 30)], [], [], ["Accept", "Accept"]),
        ([("Accept", 45, 55)], [(12, 28)], [], [], ["Accept"]),
        ([("Accept.", 45, 55)], [], [], [], []),
        ([("Official", 45, 55), ("use", 88, 55)], [], [], [], []),
        ([("Accept", 45, 55), ("in", 12, 59, 2)], [], [], [], []),
        ([("Accept", 45, 55), ("(-)", 12, 59, 2)], [], [], [], ["Accept"]),
        ([("Accept", 45, 55), ("in", 12, 42)], [], [], [], ["Accept"]),
        ([("Accept", 45, 55)], [], [], [(5.0, 40.0, 35.0, 60.0)], []),
        ([("Accept", 45, 55), ("Left", 160, 55)], [], [(140, 155)], [], ["Accept"]),
        ([("Accept", 45, 55), ("Left", 160, 55)], [], [(140, 155), (240, 255)], [], ["Accept", "Left"]),
    ],
)
def test_filled_squares(spark, words, more, curves, earlier, want):
    """A square of 20 at x 10, captions at any distance, neighbours, twins, nested ones, print inside, earlier fields and curves."""
    P = documents.PAGE_OBJECTS
    sides = [(10, 30), *more]
    rects = spark.createDataFrame([("d", 1, i, float(a), float(b), 50.0 + (20 - b + a) / 2, 70.0 - (20 - b + a) / 2, float(b - a), float(b - a), True, False) for i, (a, b) in enumerate(sides)], P["rects"])
    shapes = spark.createDataFrame([("d", 1, i, float(a), float(b), 52.5, 67.5, 15.0, 15.0, True, False) for i, (a, b) in enumerate(curves)], P["rects"])
    taken = spark.createDataFrame([("d", 1, *e) for e in earlier], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    ws = spark.createDataFrame([("d", 1, i, t, float(x), x + 5.0 * len(t), float(y), float(y + (high[0] if high else 10))) for i, (t, x, y, *high) in enumerate(words)], P["words"])
    pages = spark.createDataFrame([("d", 1, 400.0, 100.0)], P["pages"])
    got = detect.square_fields(rects, ws, pages, shapes if curves else None, taken if earlier else None).orderBy("x0").collect()
    assert [r["label"] for r in got] == want


@pytest.mark.parametrize(
    "width, words, want",
    [
        (60, [("Name", 10), ("of", 33), ("pet", 46)], "Name of pet"),
        (60, [("Left", 5), ("Phone", 40)], "Left Phone"),
        (60, [], "line"),
        (60, [(".Sum...", 20), ("__", 60)], "Sum"),
        (18, [("due", 84)], "due"),
        (18, [("due", 70)], None),
        (18, [("the", 84)], None),
        (18, [("7", 94)], None),
        (60, [("w" * 30, -60), ("x" * 30, 95 - 150)], "w" * 30 + " " + "x" * 29),
    ],
)
def test_underscore_labels(spark, width, words, want):
    """A run of underscores from x 100, with words before it on its line."""
    P = documents.PAGE_OBJECTS
    chars = spark.createDataFrame([("d", 1, i, "_", 100.0 + 3 * i, 103.0 + 3 * i, 50.0, 60.0) for i in range(width // 3)], P["chars"])
    ws = spark.createDataFrame([("d", 1, i, t, float(x), x + 5.0 * len(t), 48.0, 57.0) for i, (t, x) in enumerate(words)], P["words"])
    pages = spark.createDataFrame([("d", 1, 400.0, 100.0)], P["pages"])
    limit = spark.createDataFrame([("d", 1, 30.0)], "doc_id string, page int, threshold double")
    got = [r["label"] for r in detect.underscore_fields(chars, ws, pages, limit).collect()]
    assert got == ([] if want is None else [want])


def test_ids_groups_and_notices(spark):
    f = lambda page, kind, label, rule, y1, x0=0.0: ("d", page, kind, x0, y1 - 10, 50.0, y1, label, rule, 0.5)
    rows = [f(1, "text", "Name", "R10", 300.0), f(1, "text", "Name", "R2", 100.0), f(1, "text", "...", "R5", 50.0), f(1, "multiline", "Why", "R12", 40.0)]
    rows += [f(1, "checkbox", "Pet? (Yes)", "R1", 600.0), f(1, "checkbox", "Pet? (No)", "R1", 600.0, 60.0), f(2, "checkbox", "Car? (Yes)", "R1", 600.0), f(2, "text", "Name", "R2", 100.0)]
    fields = spark.createDataFrame(rows, "doc_id string, page int, type string, x0 double, y0 double, x1 double, y1 double, label string, rule string, confidence double")
    got = detect.group_yes_no(detect.number_fields(fields)).collect()
    assert {(r["rule"], r["page"], r["label"], r["y1"], r["x0"]): (r["id"], r["group"]) for r in got} == {
        ("R2", 1, "Name", 100.0, 0.0): ("p1_name", None), ("R10", 1, "Name", 300.0, 0.0): ("p1_name_2", None), ("R5", 1, "value", 50.0, 0.0): ("p1_value", None),
        ("R1", 1, "Pet? (Yes)", 600.0, 0.0): ("p1_chk", "grp_1"), ("R1", 1, "Pet? (No)", 600.0, 60.0): ("p1_chk_2", "grp_1"), ("R12", 1, "Why", 40.0, 0.0): ("p1_chk_3", None),
        ("R1", 2, "Car? (Yes)", 600.0, 0.0): ("p2_chk", None), ("R2", 2, "Name", 100.0, 0.0): ("p2_name", None),
    }
    pages = spark.createDataFrame([(d, p) for d in "abcde" for p in (1, 2)], "doc_id string, page int")
    pair = lambda rows: spark.createDataFrame(rows, "doc_id string, page int")
    told = detect.notices(pages, pair([("a", 1), ("e", 1)]), pair([("b", 1), ("c", 1), ("d", 2)]), pair([("c", 1)])).collect()
    assert {r["doc_id"]: r["code"] for r in told} == {"a": None, "b": "scanned", "c": "ocr_assisted", "d": "scanned", "e": None}


def test_columns_keep_their_cells(spark):
    """A cell stays in the column that took it, though another mean ends up nearer."""
    xs = [0.0, 15.0, 20.0, 30.0, 31.0, 60.0]
    cells = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(xs)], "doc_id string, page int, cell long, x0 double")
    want, cols = {}, []
    for i, x in enumerate(xs):
        at = next((k for k, c in enumerate(cols) if abs(x - sum(c) / len(c)) <= 16), None)
        at is None and cols.append([])
        at = len(cols) - 1 if at is None else at
        cols[at].append(x)
        want[i] = at
    assert {r["cell"]: r["column"] for r in ordered.column_members(cells).collect()} == want


def test_truth_reader_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "family": "f", "origin": "hand", "pages": [], "widgets": [{"page": 1, "type": "text", "rect": [10, 20, 0, 5]}]}))
    (tmp_path / "bad.json").write_text("{nope")
    rows = documents.read_truth(spark, str(tmp_path)).collect()
    assert [(r["doc"], r["x0"], r["y0"], r["x1"], r["y1"], r["rule"]) for r in rows] == [("a", 0.0, 5.0, 10.0, 20.0, "unknown")]
    out = sinks.scores_json(spark.createDataFrame([("k", None, 0.5)], "key string, label_accuracy double, f1 double")).collect()
    assert json.loads(out[0]["json"]) == {"f1": 0.5, "label_accuracy": "UNAVAILABLE"}
    lines = [r["line"] for r in sinks.text_table(spark.createDataFrame([(1, "ab"), (2, "c")], "n int, name string"), ["name", "n"], "n").collect()]
    assert lines == ["ab    1", "c     2"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "pages")
    spark.createDataFrame([(1, 1, 100.0, "H"), (1, 2, 100.0, None), (2, 1, 90.0, None)], "doc_id long, page long, width double, header string").coalesce(1).write.parquet(src)
    spark.createDataFrame([(1, 3, 100.5, None), (1, 4, 200.0, None)], "doc_id long, page long, width double, header string").coalesce(1).write.mode("append").parquet(src)
    stream = incremental.carry_headers(spark.readStream.schema("doc_id long, page long, width double, header string").parquet(src))
    q = stream.writeStream.format("memory").queryName("carry").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r[0], r[1]): r[2] for r in spark.sql("select * from carry").collect()} == {(1, 1): "H", (1, 2): "H", (1, 3): "H", (1, 4): None, (2, 1): None}
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        incremental.score_new(spark, src, "doc_id long, page long, width double, header string", lambda df: df.groupBy("doc_id").count(), out, check).awaitTermination(120)
    assert spark.read.parquet(out).agg(F.sum("count")).first()[0] == 5


def test_entry_and_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) > 60
    import inspect

    assert "entry" in dir(entry) and inspect.isfunction(entry.entry)


def _crawl(rows, robots, held, limit):
    """The crawl, address by address."""
    urls, shas, blocked, kept, out = {u for u, _ in held if u}, {h for _, h in held if h}, set(), 0, {}
    for n, host, url, path, status, sha in sorted(rows):
        if kept >= limit:
            out[n] = "limit"
        elif url in urls:
            out[n] = "known"
        elif host in blocked:
            out[n] = "blocked"
        elif any(h == host and path.startswith(p) for h, p in robots):
            out[n] = "robots"
        elif status in (403, 429):
            blocked.add(host)
            out[n] = "refused"
        elif status != 200:
            out[n] = "failed"
        elif sha in shas:
            out[n] = "duplicate"
        else:
            urls.add(url), shas.add(sha)
            kept += 1
            out[n] = "fetch"
    return out


def test_crawl_against_plain(spark):
    rng = random.Random(8)
    rows = []
    for n in range(600):
        host, page = f"h{rng.randrange(12)}", rng.randrange(15)
        rows.append((n, host, f"{host}/{page}", f"/{page}", rng.choice([200] * 30 + [404, 403, 429]), f"s{page if page > 11 else host + str(page)}"))
    robots, held = [("h1", "/1"), ("h2", "/")], [("h3/4", "sh34"), ("h4/5", None), (None, "s13")]
    df = spark.createDataFrame(rows, "ord int, host string, url string, path string, status int, sha string")
    rules, old = spark.createDataFrame(robots, "host string, prefix string"), spark.createDataFrame(held, "url string, sha string")
    for limit in (20, 10**6):
        got = {r["ord"]: r["decision"] for r in crawl.decisions(df, rules, old, limit).collect()}
        want = _crawl(rows, robots, held, limit)
        assert got == want and len(set(want.values())) > 6 - (limit > 100)
    got = crawl.manifest_summary(spark.createDataFrame([("scan",), ("scan",), ("odd",)], "verdict string"), ["flat", "scan"]).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(1, "flat", 0), (2, "scan", 2), (3, "odd", 1)]


def test_label_signals(spark):
    """One page of three lines; labels found whole, cut, torn by a gutter, begun, over two lines of a column, and not at all."""
    P = documents.PAGE_OBJECTS
    lines = [(10, [("Full", 10), ("name", 34), ("of", 58), ("owner", 130)]), (30, [("Due", 10), ("____", 28), ("Age", 120)]), (50, [("date", 10), ("years", 124)])]
    words = [("d", 1, k, t, float(x), x + 5.0 * len(t), float(y), y + 8.0) for k, (y, ws) in enumerate(lines) for t, x in ws]
    cases = {"Full name of": [], "name of": ["truncated_left"], "Full name": ["truncated_right"], "of owner": ["internal_gap", "truncated_left"], "Full name o": [], "Due date": ["not_found_on_page"], "Age years": [], "Nothing": ["not_found_on_page"], "Due": []}
    boxes = {"Due date": (10.0, 40.0), "Age years": (120.0, 150.0)}
    fields = [("d", 1, i, "text", "R2", label, *(boxes.get(label, (10.0, 20.0))[0], 760.0, boxes.get(label, (10.0, 20.0))[1], 780.0)) for i, label in enumerate(cases)] + [("d", 1, 99, "checkbox", "R1", "Nothing", 0.0, 0.0, 1.0, 1.0), ("d", 1, 98, "text", "R1", " ", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(fields, "doc_id string, page int, di int, type string, rule string, label string, x0 double, y0 double, x1 double, y1 double")
    got = guards.label_signals(df, spark.createDataFrame(words, P["words"]), spark.createDataFrame([("d", 1, 200.0, 800.0)], P["pages"]))
    assert {r["label"]: r["reasons"] for r in got.collect()} == cases
    r = guards.label_plausibility(got).first()
    assert (r["total"], r["flagged"], r["not_found_on_page"], r["truncated_left"]) == (9, 5, 2, 2)


def test_headline_names_are_queries():
    import bench

    assert set(bench.HEADLINE) <= set(entry.queries())


CORE = [n for n in catalog.QUERIES if n in catalog.ORACLE]


def test_every_query_has_an_oracle():
    assert CORE == list(catalog.QUERIES)


@pytest.mark.parametrize("name", CORE)
def test_against_oracle(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "documents pages conversations labels orders lineitem events part customer".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, d)
    cur = con.execute(catalog.ORACLE[name])
    at = [[x[0] for x in cur.description].index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want and want
