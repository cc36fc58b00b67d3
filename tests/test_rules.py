"""Ruled cells and scanned pages against pages with known fields."""

import numpy as np
import pytest

from quillspan.functions import text as X
from quillspan.operators import cells, detect, image
from quillspan.sources.documents import PAGE_OBJECTS as P


class Page:
    def __init__(self):
        self.rects, self.words, self.doc = [], [], ""

    def flat(self, x0, x1, y):
        self.rects.append((self.doc, 1, len(self.rects), float(x0), float(x1), float(y), y + 1.0, float(x1 - x0), 1.0, True, False))

    def upright(self, x, y0, y1):
        self.rects.append((self.doc, 1, len(self.rects), float(x), x + 1.0, float(y0), float(y1), 1.0, float(y1 - y0), True, False))

    def grid(self, xs, ys):
        for y in ys:
            self.flat(xs[0], xs[-1], y)
        for x in xs:
            self.upright(x, ys[0], ys[-1] + 1)

    def word(self, text, x, y):
        self.words.append((self.doc, 1, len(self.words), text, float(x), x + 5.0 * len(text), float(y), y + 8.0))


@pytest.fixture(scope="module")
def found(spark):
    p = Page()
    p.doc = "table"
    p.grid([50, 150, 250], [100, 120, 140, 160])
    p.word("Name", 60, 104), p.word("Age", 160, 104)
    p.doc = "street"
    p.grid([50, 250], [200, 240])
    p.word("Street", 55, 202), p.word("far", 200, 202)
    p.doc = "sign"
    p.grid([50, 250], [200, 240])
    p.word("Signature", 55, 202)
    p.doc = "city"
    p.grid([50, 150, 250], [300, 320])
    p.word("City", 55, 306)
    p.doc = "mask"
    p.grid([300, 400], [400, 420])
    p.word("$", 310, 405)
    p.doc = "below"
    p.grid([300, 400], [450, 470])
    p.word("Date", 310, 475)
    p.doc = "bottom"
    p.grid([300, 400], [450, 480])
    p.word("Print", 305, 470)
    p.doc = "explain"
    p.grid([50, 550], [550, 650])
    p.word("Explain", 60, 552), p.word("why", 60, 566)
    p.doc = "comb"
    p.grid([200 + 12 * i for i in range(9)], [300, 320])
    p.word("Code:", 160, 306)
    p.doc = "leader"
    p.word("Total", 150, 700)
    p.doc = "line"
    p.flat(100, 250, 500), p.word("Full", 50, 492), p.word("name", 75, 492)
    p.doc = "stacked"
    p.flat(100, 250, 500), p.flat(100, 250, 530), p.word("Date", 70, 492), p.word("Date", 70, 522), p.word("note", 110, 503)
    p.doc = "underlined"
    p.flat(100, 250, 500), p.word("x" * 28, 102, 492)
    p.doc = "flood"
    for i in range(2001):
        p.flat(50 + i % 7, 250, 3 * i)
    chars = [("leader", 1, i, ".", 200 + 4.0 * i, 202 + 4.0 * i, 700.0, 708.0) for i in range(10)] + [("few", 1, i, ".", 200 + 4.0 * i, 202 + 4.0 * i, 700.0, 708.0) for i in range(5)]
    docs = sorted({r[0] for r in p.rects} | {w[0] for w in p.words} | {"few"})
    pages = spark.createDataFrame([(d, 1, 600.0, 800.0) for d in docs], P["pages"])
    args = spark.createDataFrame(chars, P["chars"]), spark.createDataFrame(p.words, P["words"]), spark.createDataFrame(p.rects, P["rects"]), pages
    got: dict[str, list] = {}
    for r in cells.ruled_fields(*args).orderBy("doc_id", "y0", "x0").collect():
        got.setdefault(r["doc_id"], []).append((r["rule"], r["type"], r["label"], r["x0"], r["y0"], r["x1"], r["y1"]))
    return got


@pytest.mark.parametrize(
    "doc, want",
    [
        ("table", [("R3", "text", n, x + 2.0, 800.0 - y - 18, x + 98.0, 800.0 - y - 2) for y in (140, 120) for n, x in (("Name", 50), ("Age", 150))]),
        ("street", [("R2", "text", "Street", 52.0, 561.5, 248.0, 587.5)]),
        ("sign", None),
        ("city", [("R10", "text", "City", 152.0, 482.0, 248.0, 498.0)]),
        ("mask", [("R4", "text", "$", 302.0, 382.0, 398.0, 398.0)]),
        ("below", [("R16", "text", "Date", 302.0, 332.0, 398.0, 348.0)]),
        ("bottom", [("R17", "text", "Print", 302.0, 332.5, 398.0, 348.5)]),
        ("explain", [("R12", "multiline", "Explain why", 52.0, 152.0, 548.0, 223.0)]),
        ("comb", [("R14", "text", "Code", 202.0, 481.0, 294.0, 498.0)]),
        ("leader", [("R11", "text", "Total", 201.0, 90.0, 237.0, 109.0)]),
        ("line", [("R5b", "text", "Full name", 101.0, 301.0, 249.0, 315.0)]),
        ("stacked", [("R5b", "text", "Date", 101.0, 271.0, 249.0, 285.0), ("R5b", "text", "Date", 101.0, 301.0, 249.0, 315.0)]),
        ("underlined", None),
        ("few", None),
        ("flood", None),
    ],
)
def test_page(found, doc, want):
    assert found.get(doc) == want


def test_check_glyphs(spark):
    """Two options behind a question, one of them wrapped; an option to the left; a glyph alone; a question cut to length."""
    g = X.CHECK_GLYPHS[0]
    line = lambda doc, y, *at: [(doc, 1, i, t, float(x), x + (8.0 if t == g else 5.0 * len(t)), float(y), y + 8.0) for i, (t, x) in enumerate(at)]
    words = line("two", 10, ("Married?", 10), (g, 70), ("Yes", 82), (g, 150), ("No", 162)) + line("two", 22, ("never", 162))
    words += line("left", 10, ("Agree", 10), (g, 40)) + line("alone", 10, (g, 40)) + line("long", 10, ("q" * 100, 10), (g, 520), ("Yes", 530))
    chars = [(d, p, i, t, *box) for d, p, i, t, *box in words if t == g]
    pages = spark.createDataFrame([(d, 1, 600.0, 800.0) for d in ("two", "left", "alone", "long")], P["pages"])
    rows = detect.glyph_fields(spark.createDataFrame(chars, P["chars"]), spark.createDataFrame(words, P["words"]), pages).collect()
    assert {(r["doc_id"], r["x0"]): r["label"] for r in rows} == {("two", 70.0): "Married? (Yes)", ("two", 150.0): "Married? (No never)", ("left", 40.0): "Agree (Agree)", ("alone", 40.0): "", ("long", 520.0): "q" * 84 + " (Yes)"}
    assert {(r["y0"], r["y1"], r["x1"] - r["x0"]) for r in rows} == {(782.0, 790.0, 8.0)}


def test_inked_fields(spark):
    """Of boxes on print only those go whose line runs on outside; check boxes stay."""
    chars = [("d", 1, i, "x", 10.0 + 5 * i, 15.0 + 5 * i, 10.0, 20.0) for i in range(20)]
    pages = spark.createDataFrame([("d", 1, 200.0, 100.0)], P["pages"])
    box = lambda kind, x0, x1, y0=80.0: ("d", 1, kind, x0, y0, x1, y0 + 10, "a", "R2", 0.5)
    fields = [box("text", 20.0, 60.0), box("checkbox", 20.0, 60.0), box("text", 5.0, 115.0), box("text", 20.0, 60.0, 40.0)]
    df = spark.createDataFrame(fields, "doc_id string, page int, type string, x0 double, y0 double, x1 double, y1 double, label string, rule string, confidence double")
    got = detect.drop_inked(df, spark.createDataFrame(chars, P["chars"]), pages)
    assert sorted(tuple(r) for r in got.collect()) == sorted(fields[1:])


def test_rect_like_curves(spark):
    square = [("m", 3.0, 0.0), ("l", 14.0, 0.0), ("c", 17.0, 3.0), ("l", 17.0, 17.0), ("l", 0.0, 17.0), ("h", 0.0, 0.0)]
    curves = [("d", 1, i, 0.0, 17.0, 0.0, 17.0, True, None, path) for i, path in enumerate([square, square[:-1], square[:2] + [("l", 8.5, 8.5), ("h", 0.0, 0.0)], [("m", 0.0, 0.0), ("v", 0.0, 0.0), ("h", 0.0, 0.0)], [], None])]
    got = detect.rect_like_curves(spark.createDataFrame(curves, P["curves"])).collect()
    assert [(r["rect_ix"], r["width"], r["fill"], r["stroke"]) for r in got] == [(0, 17.0, True, False)]


def test_empty_page_objects(spark):
    empty = [spark.createDataFrame([], P[n]) for n in ("chars", "words", "rects", "pages")]
    assert cells.ruled_fields(*empty).count() == 0
    assert detect.detect(*empty).count() == 0


def drawn(degrees=0.0, dpi=150):
    """A page of 200 x 100 points: four lines, a square of 20, turned by so many degrees."""
    k = dpi / 72
    a = np.full((round(100 * k), round(200 * k)), 255, np.uint8)
    line = lambda x0, x1, y0, y1: a.__setitem__((slice(round(y0 * k), round(y1 * k)), slice(round(x0 * k), round(x1 * k))), 0)
    for y in (15, 35, 85, 95):
        line(10, 190, y - 0.7, y + 0.7)
    for box in ((10, 30, 50, 51.4), (10, 30, 68.6, 70), (10, 11.4, 50, 70), (28.6, 30, 50, 70)):
        line(*box)
    return (255 - image.turned(255 - a, degrees)).astype(np.uint8)


@pytest.mark.parametrize("degrees", [0.0, 3.0])
def test_scanned_page(spark, degrees):
    a = drawn(degrees)
    scans = spark.createDataFrame([("s", 1, 150, *a.shape, bytearray(a.tobytes())), ("none", 1, 150, 0, 0, None)], image.SCANS)
    rows = image.page_strokes(scans).collect()
    assert {r["doc_id"] for r in rows} == {"s"}
    assert rows[0]["skew"] == pytest.approx(-degrees, abs=0.5)
    if not degrees:
        assert sorted(r["top"] for r in rows if r["kind"] == "line") == pytest.approx([14, 34, 84, 94], abs=3)
        assert all(r["x0"] == pytest.approx(10, abs=3) and r["x1"] == pytest.approx(190, abs=3) for r in rows if r["kind"] == "line")
    boxes = [(r["x0"], r["x1"], r["top"], r["bottom"]) for r in rows if r["kind"] == "checkbox"]
    assert len(boxes) == 1 and (degrees or boxes[0] == pytest.approx((10, 30, 50, 70), abs=3))


def test_blank_scan_has_no_skew():
    assert image.skew(np.zeros((80, 120), bool)) == 0.0
    assert image.skew(np.ones((80, 120), bool)) == 0.0


def test_same_picture(spark):
    a = bytes([100] * 100)
    near, far = bytes([103] * 100), bytes([100] * 90 + [200] * 10)
    got = image.same_picture(spark.createDataFrame([(1, a, a), (2, a, near), (3, a, far), (4, a, b"x"), (5, None, a)], "k int, a binary, b binary"))
    assert {r["k"]: r["same"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
