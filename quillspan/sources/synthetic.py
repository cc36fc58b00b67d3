"""Forms made up from seven constructs, with exact truth: page-object tables and the fields that a detector should find. Equal seeds give equal forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import CHECK_GLYPHS

WIDTH, HEIGHT, SLOTS, PITCH, TOP = 600, 800, 5, 140, 60
_CHAR, _HIGH = 5, 10


def _grid(xs: list[int], ys: list[int]) -> list[tuple]:
    return [("rect", "", xs[0], xs[-1], y, y + 1) for y in ys] + [("rect", "", x, x + 1, ys[0], ys[-1] + 1) for x in xs]


def _word(text: str, x: int, y: int) -> tuple:
    return ("word", text, x, x + _CHAR * len(text), y, y + _HIGH)


def _truth(kind: str, label: str, rule: str, x0: float, x1: float, top: float, bottom: float) -> tuple:
    return (f"truth:{kind}:{rule}", label, x0, x1, top, bottom)


def templates() -> dict[str, list[tuple]]:
    """Construct -> (what, text, x0, x1, top, bottom), from the corner of its slot."""
    glyph, x = CHECK_GLYPHS[0], 330
    check = lambda at, label: [("char", glyph, at, at + 10, 10, 20), ("word", glyph, at, at + 10, 10, 20), _word(label, at + 14, 10), _truth("checkbox", label, "R1", at, at + 10, 10, 20)]
    under = [("char", "_", x + 30 + _CHAR * i, x + 35 + _CHAR * i, 10, 20) for i in range(20)]
    return {
        "labelled_grid": [*_grid([0, 150, 300], [0, 40]), *[t for n, a in (("Name", 0), ("Town", 150)) for t in (_word(n, a + 5, 3), _truth("text", n, "R2", a + 2, a + 148, 15.5, 38.5))]],
        "column_header_table": [*_grid([0, 150, 300], [0, 20, 40, 60]), *[t for n, a in (("Item", 0), ("Cost", 150)) for t in (_word(n, a + 5, 5), *[_truth("text", n, "R3", a + 2, a + 148, y + 2, y + 18) for y in (20, 40)])]],
        "checkbox_row": [*check(x, "Agree"), *check(x + 100, "Decline")],
        "underscore_line": [_word("Phone", x, 10), ("word", "_" * 20, x + 30, x + 130, 10, 20), *under, _truth("text", "Phone", "R5", x + 31, x + 129, -1, 19)],
        "rect_line": [_word("Street", x, 11), ("rect", "", x + 40, x + 200, 20, 21), _truth("text", "Street", "R5b", x + 41, x + 199, 5, 19)],
        "mask_cell": [*_grid([0, 100], [0, 20]), _word("$", 5, 5), _truth("text", "$", "R4", 2, 98, 2, 18)],
        "prose": [_word(w, x + 40 * i, 12 * line) for line in range(3) for i, w in enumerate(("plain", "text", "here"))],
    }


PICK = "(id * 5 + slot * (id % 6 + 1) + CAST(floor(id / 7) AS BIGINT)) % 7"


def forms(spark: SparkSession, count: int, seed: int = 0) -> dict[str, DataFrame]:
    """Forms `seed` to `seed + count - 1`."""
    return forms_of(spark.range(seed, seed + count))


def forms_of(ids: DataFrame) -> dict[str, DataFrame]:
    """pages, words, chars, rects and truth of one form per row of ids (id, not negative), each of SLOTS constructs that PICK names."""
    rows = [(i, name, *t) for i, (name, ts) in enumerate(templates().items()) for t in ts]
    parts = ids.sparkSession.createDataFrame([(i, n, w, t, *map(float, box)) for i, n, w, t, *box in rows], "pick int, construct string, what string, text string, x0 double, x1 double, top double, bottom double")
    chosen = ids.select(F.format_string("form-%06d", F.col("id").cast("long")).alias("doc_id"), F.col("id").cast("long").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    chosen = chosen.withColumn("pick", F.expr(PICK).cast("int"))
    dy = F.col("slot") * PITCH + TOP
    # the templates are a fixed table of about a hundred rows
    placed = chosen.join(F.broadcast(parts), "pick").select("doc_id", F.lit(1).alias("page"), "slot", "construct", "what", "text", (F.col("x0") + 50).alias("x0"), (F.col("x1") + 50).alias("x1"), (F.col("top") + dy).alias("top"), (F.col("bottom") + dy).alias("bottom"))
    number = lambda name: F.expr(f"cast(row_number() OVER (PARTITION BY doc_id ORDER BY top, x0, x1, text) - 1 AS int) AS {name}")
    box = ["x0", "x1", "top", "bottom"]
    truth = placed.where("what LIKE 'truth:%'").withColumn("w", F.split("what", ":"))
    return {
        "pages": chosen.select("doc_id", F.lit(1).alias("page"), F.lit(float(WIDTH)).alias("width"), F.lit(float(HEIGHT)).alias("height")).distinct(),
        "words": placed.where("what = 'word'").select("doc_id", "page", number("word_ix"), "text", *box),
        "chars": placed.where("what = 'char'").select("doc_id", "page", number("char_ix"), "text", *box),
        "rects": placed.where("what = 'rect'").select("doc_id", "page", number("rect_ix"), *box, (F.col("x1") - F.col("x0")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"), F.lit(True).alias("fill"), F.lit(False).alias("stroke")),
        "truth": truth.select("doc_id", "page", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY top, x0) AS ti"), F.col("w")[1].alias("type"), "x0", (F.lit(HEIGHT) - F.col("bottom")).alias("y0"), "x1", (F.lit(HEIGHT) - F.col("top")).alias("y1"), F.col("text").alias("label"), F.col("w")[2].alias("rule")),
    }


def truth_sql(ids: str) -> str:
    """The truth of the forms whose ids a query gives, in SQL."""
    rows = [(i, text, what.split(":")[1], what.split(":")[2], *box) for i, ts in enumerate(templates().values()) for what, text, *box in ts if what.startswith("truth:")]
    values = ", ".join(f"({i}, '{text}', '{kind}', '{rule}', {float(x0)}::DOUBLE, {float(x1)}::DOUBLE, {float(top)}::DOUBLE, {float(bottom)}::DOUBLE)" for i, text, kind, rule, x0, x1, top, bottom in rows)
    return f"""WITH s AS (SELECT id, slot, {PICK} AS pick FROM ({ids}) i, (SELECT unnest(range({SLOTS})) AS slot) n), t(pick, label, type, rule, x0, x1, top, bottom) AS (VALUES {values})
      SELECT printf('form-%06d', id) AS doc_id, type, rule, label, x0 + 50 AS x0, {HEIGHT} - bottom - slot * {PITCH} - {TOP} AS y0, x1 + 50 AS x1, {HEIGHT} - top - slot * {PITCH} - {TOP} AS y1 FROM s JOIN t USING (pick)"""
