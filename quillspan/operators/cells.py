"""Ruled cells of a page and the detection rules that read them: labelled, inherited, instruction, comb, captioned, neighbour and mask cells, dot leaders.

Every join is an equi-join on document and page with the box test as residual. A cell goes to the first rule, in order of PRIORITY, that wants it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.ordered import PAGE, column_members, comb_runs, islands, merge_rules
from quillspan.sources.scratch import written

# Geometry of the rules in points, and the wording of parts that the office fills in.
MOST_RULES, CELL_WIDTH, CELL_HEIGHT = 2000, 20, 14
PANEL_HEIGHT, PANEL_LINES, PANEL_X, PANEL_Y = 45, 3, 2, 1.5
SUPPORT_X, SUPPORT_Y, ROW_EPS, SPAN_CELLS = 2, 3, 0.5, 10
ENTRY_HEIGHT, WIDE = 11, 0.6
COLUMN_TOL, PITCH = 16, 1.4
LINES_MOST, LINES_GAP, INSTRUCTION_LABEL, INSTRUCTION_BLANK = 3, 20, 200, 40
CAPTION_BELOW, CAPTION_X = 14, 4
COMB_X, COMB_Y, COMB_ABOVE, COMB_LEFT, COMB_LEVEL = 3, 2, 14, 200, 4.5
LINE_LEAST, LINE_SHARE, LINE_COVER, LINE_LEFT, LINE_UNDER = 40, 0.77, 0.35, 260, 14
LEADERS, LEADER_GAP, LEADER_DOTS, LEADER_WIDTH, LEADER_REACH = (".", "·", "․"), 8, 6, 25, 240
OFFICE_USE = r"(?i)office\s*use|staff\s*use|internal\s*use|official\s*use|do\s*not\s*write|leave\s*blank"
SIGNATURE = r"(?i)signatur|\bsigned\b"

PRIORITY = ["R2", "R3", "R12", "R16", "R17", "R10", "R4"]
CONFIDENCE = {"R2": 0.8, "R3": 0.6, "R12": 0.55, "R14": 0.55, "R16": 0.5, "R17": 0.5, "R10": 0.55, "R4": 0.55, "R11": 0.6, "R5b": 0.6}
BOX = ["x0", "top", "x1", "bottom"]
CELL = [*PAGE, "cell"]


def _on(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page") == F.col(f"{b}.page"))


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in BOX})


def _inside(inner: str, outer: str, pad: float = 1) -> Column:
    i, o = (lambda c: F.col(f"{inner}.{c}")), (lambda c: F.col(f"{outer}.{c}"))
    return (i("x0") >= o("x0") - pad) & (i("x1") <= o("x1") + pad) & (i("top") >= o("top") - pad) & (i("bottom") <= o("bottom") + pad)


def thin_rules(rects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertical and horizontal strokes; pages with more than MOST_RULES of them give none."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    r = _doubles(rects).withColumn("_v", (w < 3) & (h >= 5)).withColumn("_h", (h < 3) & (w >= 5)).where("_v or _h")
    few = r.groupBy(*PAGE).agg(F.count("*").alias("n")).where(f"n <= {MOST_RULES}").select(*PAGE)
    r = r.join(few, PAGE, "left_semi").select(*PAGE, *BOX, "_v", "_h")
    return r.where("_v").drop("_v", "_h"), r.where("_h").drop("_v", "_h")


def prose_panels(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Filled boxes without a stroke, over PANEL_HEIGHT high, that hold at least three lines of words."""
    p = _doubles(rects).where("fill and not stroke").where(F.col("bottom") - F.col("top") > PANEL_HEIGHT).alias("p")
    k = _doubles(words).alias("k")
    held = p.join(k, _on("p", "k") & _inside("k", "p")).groupBy(*[F.col(f"p.{c}").alias(c) for c in (*PAGE, *BOX)]).agg(F.countDistinct(F.bround("k.top")).alias("lines"))
    return held.where(f"lines >= {PANEL_LINES}").drop("lines")


def _off_panels(h: DataFrame, v: DataFrame, panels: DataFrame) -> DataFrame:
    """Horizontal strokes without the edges of prose panels; an edge that stands on a vertical stroke is a table's and stays."""
    a, p, s = h.alias("a"), panels.alias("p"), v.alias("s")
    edge = _on("a", "p") & (F.abs(F.col("a.x0") - F.col("p.x0")) <= PANEL_X) & (F.abs(F.col("a.x1") - F.col("p.x1")) <= PANEL_X) & ((F.abs(F.col("p.top") - F.col("a.bottom")) <= PANEL_Y) | (F.abs(F.col("p.bottom") - F.col("a.top")) <= PANEL_Y))
    ends = _on("a", "s") & ((F.abs(F.col("s.x0") - F.col("a.x0")) < 3) | (F.abs(F.col("s.x0") - F.col("a.x1")) < 3)) & (F.col("s.top") <= F.col("a.top") + 3) & (F.col("s.bottom") >= F.col("a.top") - 3)
    edges = a.join(p, edge, "left_semi").alias("a").join(s, ends, "left_anti").select(*PAGE, *BOX).distinct()
    return h.join(edges, [*PAGE, *BOX], "left_anti")


def grid_cells(rects: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, page, cell, x0, top, x1, bottom.

    Below each horizontal stroke the nearest other one that it overlaps closes a band, which vertical strokes across it divide. Where a row of
    several strokes has one stroke under them all, the band is one cell: its upper edge is borrowed from the row above.
    """
    v, h = thin_rules(rects)
    if words is not None:
        h = _off_panels(h, v, prose_panels(rects, words))
    h = merge_rules(h).select(*PAGE, *BOX)
    rows = h.groupBy(*PAGE, "top").agg(F.count("*").alias("n"), F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    a, b = rows.alias("a"), rows.alias("b")
    under = a.where("n > 1").join(b, _on("a", "b") & (F.col("b.top") > F.col("a.top") + 4)).groupBy(*[F.col(f"a.{c}").alias(c) for c in (*PAGE, "top", "lo", "hi")]).agg(F.min_by(F.struct("b.top", "b.n", "b.lo", "b.hi"), "b.top").alias("b"))
    whole = under.where((F.col("b.n") == 1) & (F.col("b.lo") <= F.col("lo") + 3) & (F.col("b.hi") >= F.col("hi") - 3))
    wide = whole.select(*PAGE, F.bround("lo", 1).alias("x0"), "top", F.bround("hi", 1).alias("x1"), F.col("b.top").alias("bottom"))
    a, b = h.join(whole.select(*PAGE, "top"), [*PAGE, "top"], "left_anti").alias("a"), h.alias("b")
    close = _on("a", "b") & (F.col("b.top") > F.col("a.top") + 4) & (F.col("b.x0") < F.col("a.x1") - 4) & (F.col("b.x1") > F.col("a.x0") + 4)
    bands = a.join(b, close).groupBy(*[F.col(f"a.{c}").alias(c) for c in (*PAGE, "x0", "x1", "top")]).agg(F.min("b.top").alias("bottom"))
    a, s = bands.alias("a"), v.alias("s")
    across = _on("a", "s") & (F.col("s.top") <= F.col("a.top") + 3) & (F.col("s.bottom") >= F.col("a.bottom") - 3) & F.col("s.x0").between(F.col("a.x0") - 2, F.col("a.x1") + 2)
    cut = a.join(s, across, "left").groupBy(*[F.col(f"a.{c}").alias(c) for c in (*PAGE, *BOX)]).agg(F.collect_set(F.bround("s.x0", 1)).alias("xs"))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.bround("x0", 1), F.bround("x1", 1)), F.col("xs"))))
    e = cut.withColumn("e", edges).select(*PAGE, "top", "bottom", F.explode(F.arrays_zip(F.expr("slice(e, 1, size(e) - 1)").alias("l"), F.expr("slice(e, 2, size(e) - 1)").alias("r"))).alias("z"))
    narrow = e.select(*PAGE, F.col("z.l").alias("x0"), "top", F.col("z.r").alias("x1"), "bottom")
    cells = narrow.unionByName(wide).where((F.col("x1") - F.col("x0") > CELL_WIDTH) & (F.col("bottom") - F.col("top") > CELL_HEIGHT)).distinct()
    return cells.withColumn("cell", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*BOX)).cast("long")).select(*CELL, *BOX)


def fill_cells(cells: DataFrame, words: DataFrame, rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells with ws (their words by x0), W and H of the page, supported (a vertical stroke along both sides), run, pos and ext (see below).

    A run is a cell and the blank cells that abut it to its right in its row, no stroke between; pos numbers it, ext is where it ends for that cell.
    """
    c, k = cells.alias("c"), _doubles(words).alias("k")
    word = F.struct("k.x0", "k.top", "k.x1", "k.bottom", "k.text")
    ws = c.join(k, _on("c", "k") & _inside("k", "c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in CELL]).agg(F.sort_array(F.collect_list(word)).alias("ws"))
    v, _ = thin_rules(rects)
    s, at = v.alias("s"), lambda x: F.abs(F.col("s.x0") - F.col(f"c.{x}")) <= SUPPORT_X
    spans = (F.col("s.top") <= F.col("c.top") + SUPPORT_Y) & (F.col("s.bottom") >= F.col("c.bottom") - SUPPORT_Y)
    sides = c.join(s, _on("c", "s") & spans & (at("x0") | at("x1"))).groupBy(*[F.col(f"c.{n}").alias(n) for n in CELL]).agg(F.max(at("x0")).alias("l"), F.max(at("x1")).alias("r"))
    empty = F.array().cast("array<struct<x0:double,top:double,x1:double,bottom:double,text:string>>")
    full = cells.join(ws, CELL, "left").join(sides, CELL, "left").join(pages.select(*PAGE, F.col("width").alias("W"), F.col("height").alias("H")), PAGE)
    full = full.withColumns({"ws": F.coalesce("ws", empty), "l": F.coalesce("l", F.lit(False)), "supported": F.coalesce(F.col("l") & F.col("r"), F.lit(False))})
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    square = w.between(20, 34) & h.between(14, 34) & (F.abs(w - h) < 14)
    full = full.withColumns({"blank": F.size("ws") == 0, "row_t": F.bround("top"), "row_b": F.bround("bottom")})
    row = [*PAGE, "row_t", "row_b"]
    o = Window.partitionBy(*row).orderBy("x0", "cell")
    joined = F.col("blank") & ~square & ~F.col("l") & (F.abs(F.col("x0") - F.lag("x1").over(o)) <= ROW_EPS)
    runs = islands(full, row, ["x0", "cell"], ~joined)
    r = Window.partitionBy(*row, "run").orderBy("x0", "cell")
    runs = runs.withColumns({"pos": F.row_number().over(r) - 1, "ext": F.max("x1").over(r.rowsBetween(0, SPAN_CELLS)), "mates": F.count("*").over(Window.partitionBy(*row))})
    return runs.drop("l", "r")


def text_of(ws: str) -> str:
    return f"array_join(transform({ws}, w -> w.text), ' ')"


def cut(ws: str, keep: str = "first", limit: str = "threshold") -> str:
    """The words (in order of x0) up to the first gap over the limit that follows a letter, from the left ('first') or from the right ('last')."""
    gap, seq = ("w.x0 - a.at", ws) if keep == "first" else ("a.at - w.x1", f"reverse({ws})")
    edge = "w.x1" if keep == "first" else "w.x0"
    start = "named_struct('t', cast(array() as array<string>), 'open', true, 'letter', false, 'at', cast(null as double))"
    step = f"(a, w) -> CASE WHEN NOT a.open OR (a.letter AND {gap} > {limit}) THEN named_struct('t', a.t, 'open', false, 'letter', a.letter, 'at', a.at) ELSE named_struct('t', array_append(a.t, w.text), 'open', true, 'letter', a.letter OR w.text rlike '[A-Za-z]', 'at', {edge}) END"
    got = f"aggregate({seq}, {start}, {step}).t"
    return f"array_join({got if keep == 'first' else f'reverse({got})'}, ' ')"


def _field(df: DataFrame, rule: str, label: str, x0: str, y0: str, x1: str, y1: str, kind: str = "text") -> DataFrame:
    """Boxes are given from the top of the page and come out from its bottom."""
    return df.selectExpr(*PAGE, "cell", f"'{kind}' AS type", f"{x0} AS x0", f"H - ({y0}) AS y0", f"{x1} AS x1", f"H - ({y1}) AS y1", f"{label} AS label", f"'{rule}' AS rule", f"{CONFIDENCE[rule]}D AS confidence", "run", "pos", "row_t", "row_b")


def labelled(f: DataFrame) -> DataFrame:
    """R2: one line of words at the top of a cell labels the blank part below; wide cells whose label ends with a colon are titles."""
    g = f.where("not blank").withColumns({"lo": F.expr("array_min(transform(ws, w -> w.top))"), "full": F.expr(text_of("ws")), "entry": F.expr("array_max(transform(ws, w -> w.bottom)) + 1"), "label": F.expr(cut("ws"))})
    g = g.where("forall(ws, w -> w.top < lo + 6)").where(f"bottom - entry >= {ENTRY_HEIGHT} AND length(full) BETWEEN 2 AND 60 AND label rlike '[A-Za-z]'").where(~F.col("full").rlike(SIGNATURE)).where("NOT (endswith(full, ':') AND x1 - x0 > W * 0.8)")
    return _field(g, "R2", "label", "x0 + 2", "bottom - 1.5", "ext - 2", "entry + 1.5")


def inherited(f: DataFrame, claimed: DataFrame) -> DataFrame:
    """A blank cell takes the name of the last header above it in its column, until the row pitch breaks where no strokes hold the cell.

    Columns are folded from top to bottom. Two rows that agree within PITCH set the pitch. Of a run of blank cells the first stands for all.
    """
    nearest = column_members(f, COLUMN_TOL)
    g = f.join(nearest, CELL).join(claimed.select(*CELL).distinct().withColumn("taken", F.lit(True)), CELL, "left").withColumns({"label": F.expr(text_of("ws")), "h": F.col("bottom") - F.col("top")})
    tops = "array_sort(array_distinct(transform(ws, w -> w.top)))"
    spread = f"aggregate({tops}, named_struct('last', cast(null as double), 'gap', 0D), (a, t) -> CASE WHEN a.last IS NULL THEN named_struct('last', t, 'gap', a.gap) WHEN t - a.last > 3 THEN named_struct('last', t, 'gap', greatest(a.gap, t - a.last)) ELSE a END).gap"
    high = "aggregate(ws, 0D, (a, w) -> a + w.bottom - w.top) / greatest(size(ws), 1)"
    g = g.withColumns({"header": F.expr(f"NOT blank AND length(label) BETWEEN 2 AND 60 AND NOT {spread} > 1.6 * {high}"), "office": F.col("label").rlike(OFFICE_USE), "open": F.expr(f"blank AND taken IS NULL AND h BETWEEN {ENTRY_HEIGHT} AND 70 AND x1 - x0 >= 30")})
    column = g.groupBy(*PAGE, "column").agg(F.sort_array(F.collect_list(F.struct("top", "x0", "cell", "blank", "header", "office", "open", "label", "h", "supported"))).alias("xs"))
    state = lambda name, pending, fixed, out: f"named_struct('name', {name}, 'pending', {pending}, 'fixed', {fixed}, 'out', {out})"
    agree = f"a.pending IS NOT NULL AND x.h BETWEEN a.pending / {PITCH}D AND a.pending * {PITCH}D"
    breaks = f"a.fixed IS NOT NULL AND NOT x.h BETWEEN a.fixed / {PITCH}D AND a.fixed * {PITCH}D"
    none, d = "cast(null as string)", "cast(null as double)"
    given = "array_append(a.out, named_struct('cell', x.cell, 'name', a.name))"
    step = f"""(a, x) -> CASE
      WHEN x.header THEN {state("CASE WHEN x.office THEN NULL ELSE x.label END", d, d, "a.out")}
      WHEN NOT x.open OR a.name IS NULL THEN a
      WHEN ({breaks}) AND NOT x.supported THEN {state(none, "a.pending", "a.fixed", "a.out")}
      WHEN {breaks} THEN {state("a.name", "a.pending", "a.fixed", given)}
      WHEN a.fixed IS NULL AND {agree} THEN {state("a.name", "a.pending", "(a.pending + x.h) / 2", given)}
      ELSE {state("a.name", "CASE WHEN a.fixed IS NULL THEN x.h ELSE a.pending END", "a.fixed", given)} END"""
    named = column.select(*PAGE, F.explode(F.expr(f"aggregate(xs, {state(none, d, d, 'cast(array() as array<struct<cell:bigint,name:string>>)')}, {step}).out")).alias("o")).select(*PAGE, "o.cell", "o.name")
    got = f.join(named, CELL)
    r = Window.partitionBy(*PAGE, "row_t", "row_b", "run")
    got = got.withColumn("part", F.expr(f"(pos - min(pos) OVER (PARTITION BY doc_id, page, row_t, row_b, run)) div {SPAN_CELLS + 1}"))
    got = got.withColumn("first", F.min("pos").over(r.partitionBy(*PAGE, "row_t", "row_b", "run", "part"))).where("pos = first")
    return _field(got, "R3", "name", "x0 + 2", "bottom - 2", "ext - 2", "top + 2")


def instructions(f: DataFrame) -> DataFrame:
    """A large cell that holds no other cell, with at most three lines of instruction at its top and at least INSTRUCTION_BLANK blank below."""
    a, b = f.alias("a"), f.select(*CELL, *BOX).alias("b")
    smaller = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.bottom") - F.col("b.top")) < (F.col("a.x1") - F.col("a.x0")) * (F.col("a.bottom") - F.col("a.top"))
    g = a.where(f"NOT blank AND bottom - top BETWEEN 70 AND 350 AND x1 - x0 >= 0.55 * W").alias("a").join(b, _on("a", "b") & _inside("b", "a") & smaller, "left_anti")
    tops = "array_sort(array_distinct(transform(ws, w -> bround(w.top, 1))))"
    g = g.withColumn("tops", F.expr(tops)).where(f"size(tops) <= {LINES_MOST} AND forall(sequence(1, size(tops)), i -> i = 1 OR tops[i - 1] - tops[i - 2] <= {LINES_GAP})")
    g = g.withColumns({"label": F.expr(f"array_join(transform(tops, t -> {text_of('filter(ws, w -> bround(w.top, 1) = t)')}), ' ')"), "entry": F.expr("array_max(transform(ws, w -> w.bottom)) + 1")})
    g = g.where(f"length(label) BETWEEN 2 AND {INSTRUCTION_LABEL} AND bottom - entry >= {INSTRUCTION_BLANK}").where(~F.col("label").rlike(OFFICE_USE))
    return _field(g, "R12", "label", "x0 + 2", "bottom - 2", "ext - 2", "entry + 2", "multiline")


def captioned_below(f: DataFrame, words: DataFrame) -> DataFrame:
    """A blank cell between vertical strokes whose caption stands just below it, outside all cells and nearer to it than to the next cell."""
    k = _doubles(words)
    free = k.alias("k").join(f.select(*CELL, *BOX).alias("c"), _on("k", "c") & _inside("k", "c"), "left_anti").alias("k")
    g = f.where(f"blank AND supported AND bottom - top <= 40 AND x1 - x0 <= {WIDE} * W").alias("g")
    near = _on("g", "k") & (F.col("k.top") > F.col("g.bottom")) & (F.col("k.top") - F.col("g.bottom") <= CAPTION_BELOW) & (F.col("k.x0") >= F.col("g.x0") - CAPTION_X) & (F.col("k.x1") <= F.col("g.x1") + CAPTION_X)
    band = g.join(free, near).groupBy(*[F.col(f"g.{c}").alias(c) for c in CELL]).agg(F.sort_array(F.collect_list(F.struct("k.x0", "k.top", "k.x1", "k.bottom", "k.text"))).alias("band"))
    band = band.withColumn("line", F.expr("filter(band, w -> abs(w.top - array_min(transform(band, z -> z.top))) <= 2)")).withColumns({"label": F.expr(text_of("line")), "line_top": F.expr("array_min(transform(band, w -> w.top))"), "line_bottom": F.expr("array_max(transform(line, w -> w.bottom))")})
    band = band.where("length(label) BETWEEN 2 AND 60 AND label rlike '[A-Za-z]' AND NOT label rlike '[.?]$'").where(~F.col("label").rlike(OFFICE_USE))
    n, o = f.where("blank").alias("n"), f.select(*CELL, *BOX).alias("o")
    next_ = n.join(o, _on("n", "o") & (F.col("o.cell") != F.col("n.cell")) & (F.col("o.top") >= F.col("n.bottom")) & (F.abs(F.col("o.x0") - F.col("n.x0")) <= CAPTION_X) & (F.abs(F.col("o.x1") - F.col("n.x1")) <= CAPTION_X)).groupBy(*[F.col(f"n.{c}").alias(c) for c in CELL]).agg(F.min("o.top").alias("next_top"))
    got = f.join(band, CELL).join(next_, CELL, "left").where("next_top IS NULL OR next_top - line_bottom > line_top - bottom")
    return _field(got, "R16", "label", "x0 + 2", "bottom - 2", "x1 - 2", "top + 2")


def captioned_inside(f: DataFrame) -> DataFrame:
    """A cell alone in its row with one line of words at its lower edge and blank room above."""
    g = f.where(f"NOT blank AND supported AND mates = 1 AND x1 - x0 <= {WIDE} * W").withColumns({"last": F.expr("array_max(transform(ws, w -> w.bottom))"), "entry": F.expr("array_min(transform(ws, w -> w.top)) - 1"), "label": F.expr(text_of("ws"))})
    g = g.where(f"bottom - last <= 4 AND forall(ws, w -> w.bottom > last - 6) AND entry - top >= {ENTRY_HEIGHT} AND length(label) BETWEEN 2 AND 60 AND label rlike '[A-Za-z]'").where(~F.col("label").rlike(OFFICE_USE))
    return _field(g, "R17", "label", "x0 + 2", "entry - 1.5", "x1 - 2", "top + 1.5")


def neighbours(f: DataFrame, claimed: DataFrame) -> DataFrame:
    """A blank cell is named by the cell to its left in its row, or by the one beyond a blank gutter under 25 wide; cells that earlier rules took give and get no name."""
    free = f.join(claimed.select(*CELL).distinct(), CELL, "left_anti")
    left = lambda a, b: _on(a, b) & (F.col(f"{b}.cell") != F.col(f"{a}.cell")) & (F.col(f"{b}.x1") <= F.col(f"{a}.x0") + ROW_EPS) & (F.abs(F.col(f"{b}.top") - F.col(f"{a}.top")) <= ROW_EPS) & (F.abs(F.col(f"{b}.bottom") - F.col(f"{a}.bottom")) <= ROW_EPS)
    one = f.select(*CELL, *BOX, "blank").alias("a").join(f.select(*CELL, *BOX, "blank").alias("b"), left("a", "b")).groupBy(*[F.col(f"a.{c}").alias(c) for c in CELL]).agg(F.max_by(F.struct("b.cell", "b.blank", (F.col("b.x1") - F.col("b.x0")).alias("w")), F.struct("b.x1", "b.cell")).alias("b"))
    first = one.select(*CELL, F.col("b.cell").alias("by"), F.col("b.blank").alias("gap"), F.col("b.w").alias("w"))
    beyond = first.select(*PAGE, F.col("cell").alias("by"), F.col("by").alias("next"), F.col("gap").alias("next_gap"))
    via = first.join(beyond, [*PAGE, "by"], "left").select(*CELL, F.when(~F.col("gap"), F.col("by")).when((F.col("w") < 25) & ~F.col("next_gap"), F.col("next")).alias("by")).where("by IS NOT NULL")
    names = free.where("not blank").select(*PAGE, F.col("cell").alias("by"), F.col("ws").alias("lws"))
    g = free.where("blank AND bottom - top <= 65 AND x1 - x0 >= 25").join(via, CELL).join(names, [*PAGE, "by"])
    lines = "transform(array_sort(array_distinct(transform(lws, w -> bround(w.top / 3)))), k -> {})"
    of_line = "filter(lws, w -> bround(w.top / 3) = k)"
    g = g.withColumns({"full": F.expr(f"array_join({lines.format(text_of(of_line))}, ' ')"), "label": F.expr(f"array_join({lines.format(cut(of_line, 'last'))}, ' ')")})
    g = g.where("length(full) BETWEEN 1 AND 60 AND NOT label rlike '^[a-z]' AND lower(trim(label)) NOT IN ('yes', 'no')").where(~F.col("full").rlike(SIGNATURE))
    return _field(g, "R10", "label", "x0 + 2", "bottom - 2", "x1 - 2", "top + 2")


def masks(f: DataFrame) -> DataFrame:
    """A cell that holds nothing but a mask such as (   ) - or $."""
    g = f.where("not blank").withColumn("label", F.expr("array_join(transform(ws, w -> w.text), '')")).where(F.col("label").rlike(r"^[()\- $.]+$"))
    return _field(g, "R4", "coalesce(nullif(trim(label), ''), 'value')", "x0 + 2", "bottom - 2", "x1 - 2", "top + 2")


def combs(words: DataFrame, rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Evenly spaced ticks between two horizontal strokes, named from the left on their level or else by the line just above."""
    v, h = thin_rules(rects)
    ticks = v.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("bottom") - F.col("top")})
    level = ticks.withColumn("page", F.struct("page", F.bround("top").alias("t"), F.bround("bottom").alias("b")))
    runs = comb_runs(level).select("doc_id", F.col("page.page").alias("page"), F.col("page.t").alias("t"), F.col("page.b").alias("b"), "x0", "x1")
    exact = ticks.alias("v").join(runs.alias("r"), _on("v", "r") & (F.col("v.x0") == F.col("r.x0")) & (F.bround("v.top") == F.col("r.t")) & (F.bround("v.bottom") == F.col("r.b")))
    r = exact.groupBy(*[F.col(f"r.{c}").alias(c) for c in (*PAGE, "x0", "x1", "t", "b")]).agg(F.min("v.top").alias("top"), F.min("v.bottom").alias("bottom"))
    for y in ("top", "bottom"):
        r = r.alias("r").join(h.alias("h"), _on("r", "h") & (F.abs(F.col("h.top") - F.col(f"r.{y}")) <= COMB_Y) & (F.col("h.x0") <= F.col("r.x0") + COMB_X) & (F.col("h.x1") >= F.col("r.x1") - COMB_X), "left_semi")
    a, k, word = r.alias("r"), _doubles(words).alias("k"), F.struct("k.x0", "k.bottom", "k.text")
    left = (F.col("k.x1") <= F.col("r.x0") + 1) & (F.abs(F.col("k.top") + F.col("k.bottom") - F.col("r.top") - F.col("r.bottom")) / 2 < COMB_LEVEL) & (F.col("r.x0") - F.col("k.x1") < COMB_LEFT)
    above = (F.col("k.bottom") < F.col("r.top")) & (F.col("r.top") - F.col("k.bottom") < COMB_ABOVE) & (F.col("k.x0") < F.col("r.x1")) & (F.col("k.x1") > F.col("r.x0") - 20)
    g = a.join(k, _on("r", "k") & (left | above)).groupBy(*[F.col(f"r.{c}").alias(c) for c in (*PAGE, *BOX)]).agg(F.sort_array(F.collect_list(F.when(left, word))).alias("lefts"), F.sort_array(F.collect_list(F.when(above, word))).alias("aboves"))
    tidy = lambda ws: rf"trim(regexp_replace({text_of(ws)}, ':+$', ''))"
    g = g.withColumns({"one": F.expr(tidy("slice(lefts, greatest(size(lefts) - 5, 1), 6)")), "two": F.expr(tidy("filter(aboves, w -> array_max(transform(aboves, z -> z.bottom)) - w.bottom < 2)"))})
    good = lambda c: F.when(F.length(c).between(2, 60) & ~F.col(c).rlike(OFFICE_USE), F.col(c))
    g = g.withColumn("label", F.coalesce(good("one"), good("two"))).where("label IS NOT NULL").join(pages.select(*PAGE, F.col("height").alias("H")), PAGE)
    none = {c: F.lit(None).cast("long") for c in ("cell", "run", "pos", "row_t", "row_b")}
    return _field(g.withColumns(none), "R14", "label", "x0 + 2", "bottom - 2", "x1 - 2", "top + 2")


def leader_fields(chars: DataFrame, words: DataFrame, rects: DataFrame, pages: DataFrame) -> DataFrame:
    """A run of at least six leader dots, 25 wide, with words to its left on its line and no vertical stroke at its ends."""
    v, _ = thin_rules(rects)
    c = _doubles(chars).where(F.col("text").isin(*LEADERS, " ")).withColumn("row", F.bround("top"))
    w = Window.partitionBy(*PAGE).orderBy("row", "x0")
    runs = islands(c, PAGE, ["row", "x0"], ~((F.abs(F.col("top") - F.lag("top").over(w)) < 1.5) & (F.col("x0") - F.lag("x1").over(w) < LEADER_GAP)))
    r = runs.groupBy(*PAGE, F.col("run").cast("long").alias("run")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min_by("top", "x0").alias("top"), F.min_by("bottom", "x0").alias("bottom"), F.count_if(F.col("text") != " ").alias("dots")).where(f"dots >= {LEADER_DOTS} AND x1 - x0 >= {LEADER_WIDTH}")
    s, k = v.alias("s"), _doubles(words).alias("k")
    ends = _on("r", "s") & ((F.abs(F.col("s.x0") - F.col("r.x0")) < 3) | (F.abs(F.col("s.x0") - F.col("r.x1")) < 3)) & (F.col("s.top") <= F.col("r.top") + 3) & (F.col("s.bottom") >= F.col("r.top") - 3)
    before = _on("r", "k") & (F.abs(F.col("k.bottom") - F.col("r.bottom")) < 6) & (F.col("k.x1") <= F.col("r.x0") + 2) & (F.col("k.x1") > F.col("r.x0") - LEADER_REACH)
    g = r.alias("r").join(s, ends, "left_anti").alias("r").join(k, before).groupBy(*[F.col(f"r.{n}").alias(n) for n in (*PAGE, "run", *BOX)]).agg(F.sort_array(F.collect_list(F.struct("k.x0", "k.text"))).alias("ws"))
    g = g.withColumn("label", F.expr(f"substr({text_of('slice(ws, greatest(size(ws) - 5, 1), 6)')}, 1, 60)")).join(pages.select(*PAGE, F.col("height").alias("H")), PAGE)
    none = {c: F.lit(None).cast("long") for c in ("cell", "pos", "row_t", "row_b")}
    return _field(g.withColumns(none), "R11", "label", "x0 + 1", "bottom + 2", "x1 - 1", "top - 9")


def write_on_lines(words: DataFrame, rects: DataFrame, pages: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Horizontal strokes to write on, as fields 14 high above the stroke, with `top`, the stroke's place.

    A stroke 40 long up to 0.77 of the page, no vertical stroke at its ends, no panel's edge, at most LINE_COVER of it under words, named by the
    words to its left or else below it.
    """
    v, h = thin_rules(rects)
    h = merge_rules(_off_panels(h, v, prose_panels(rects, words))).select(*PAGE, *BOX).join(pages.select(*PAGE, F.col("width").alias("W"), F.col("height").alias("H")), PAGE)
    h = h.where(f"x1 - x0 BETWEEN {LINE_LEAST} AND W * {LINE_SHARE}").alias("r")
    s, k, w = v.alias("s"), _doubles(words).alias("k"), F.struct("k.x0", "k.top", "k.x1", "k.bottom", "k.text")
    ends = _on("r", "s") & ((F.abs(F.col("s.x0") - F.col("r.x0")) < 3) | (F.abs(F.col("s.x0") - F.col("r.x1")) < 3)) & (F.col("s.top") <= F.col("r.top") + 3) & (F.col("s.bottom") >= F.col("r.top") - 3)
    drop = F.col("k.bottom") - F.col("r.top")
    left = (F.abs(drop) < 9) & (F.col("k.x1") <= F.col("r.x0") + 3) & (F.col("k.x1") > F.col("r.x0") - LINE_LEFT)
    under = (F.col("k.top") > F.col("r.top")) & (F.col("k.top") - F.col("r.top") < LINE_UNDER) & (F.col("k.x1") > F.col("r.x0") - 2) & (F.col("k.x0") < F.col("r.x1") + 2)
    over = F.when(F.abs(drop) < 3.5, F.greatest(F.lit(0.0), F.least("k.x1", "r.x1") - F.greatest("k.x0", "r.x0")))
    g = h.join(s, ends, "left_anti").alias("r").join(k, _on("r", "k") & (left | under | (F.abs(drop) < 3.5)))
    g = g.groupBy(*[F.col(f"r.{c}").alias(c) for c in (*PAGE, *BOX, "W", "H")]).agg(F.sort_array(F.collect_list(F.when(left, w))).alias("lefts"), F.sort_array(F.collect_list(F.when(under, w))).alias("unders"), F.coalesce(F.sum(over), F.lit(0.0)).alias("cover"))
    g = g.where(f"cover < {LINE_COVER} * (x1 - x0)").join(thresholds if thresholds is not None else pages.select(*PAGE, F.lit(10.0).alias("threshold")), PAGE, "left").withColumn("threshold", F.coalesce("threshold", F.lit(10.0)))
    tail = f"array_join(slice(split({cut('lefts', 'last')}, ' '), greatest(size(split({cut('lefts', 'last')}, ' ')) - 6, 1), 7), ' ')"
    g = g.withColumns({"full": F.expr(f"CASE WHEN size(lefts) > 0 THEN {text_of('lefts')} ELSE {text_of('unders')} END"), "label": F.expr(f"substr(trim(CASE WHEN size(lefts) > 0 THEN {tail} ELSE {cut('unders')} END), 1, 60)")})
    g = g.where("label <> ''").where(~F.col("full").rlike(OFFICE_USE))
    none = {c: F.lit(None).cast("long") for c in ("cell", "run", "pos", "row_t", "row_b")}
    return _field(g.withColumns(none), "R5b", "label", "x0 + 1", "top - 1", "x1 - 1", "top - 15").withColumn("top", F.col("y0") - 1)


def drop_stacked(cells: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells without those that lie between two lines to write on with one and the same label: these are two fields, no cell."""
    n = lines.join(pages.select(*PAGE, F.col("height").alias("H")), PAGE).select(*PAGE, (F.col("H") - F.col("top")).alias("at"), F.lower(F.trim(F.regexp_replace("label", r"\s+", " "))).alias("name"))
    c, a, b = cells.alias("c"), n.alias("a"), n.alias("b")
    upper = c.join(a, _on("c", "a") & (F.abs(F.col("c.top") - F.col("a.at")) <= 1)).select("c.*", F.col("a.name").alias("name")).alias("c")
    both = upper.join(b, _on("c", "b") & (F.abs(F.col("c.bottom") - F.col("b.at")) <= 1) & (F.col("c.name") == F.col("b.name")))
    return cells.join(both.select(*[F.col(f"c.{x}").alias(x) for x in CELL]).distinct(), CELL, "left_anti")


def cell_fields(words: DataFrame, rects: DataFrame, pages: DataFrame, thresholds: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Fields of rules R2, R3, R12, R16, R17, R10 and R4. thresholds: doc_id, page, threshold for gutter cuts (10 where a page has none); lines: those of R5b."""
    cells = written(grid_cells(rects, words), "cells")
    cells = cells if lines is None else written(drop_stacked(cells, lines, pages), "cells")
    f = fill_cells(cells, words, rects, pages)
    f = f.join(thresholds, PAGE, "left").withColumn("threshold", F.coalesce("threshold", F.lit(10.0))) if thresholds is not None else f.withColumn("threshold", F.lit(10.0))
    f = written(f, "filled-cells")
    spans = lambda heads: f.alias("f").join(heads.alias("h"), _on("f", "h") & (F.col("f.row_t") == F.col("h.row_t")) & (F.col("f.row_b") == F.col("h.row_b")) & (F.col("f.run") == F.col("h.run")) & F.col("f.pos").between(F.col("h.pos"), F.col("h.pos") + SPAN_CELLS)).select(*[F.col(f"f.{c}").alias(c) for c in CELL])
    two = written(labelled(f), "labelled")
    three = written(inherited(f, spans(two)), "inherited")
    rest = [instructions(f), captioned_below(f, words), captioned_inside(f)]
    heads = written(reduce(DataFrame.unionByName, [two, three, *rest]), "heads")
    absorbed = written(spans(heads.where("rule IN ('R2', 'R3', 'R12')")), "absorbed")
    ten = neighbours(f, absorbed.unionByName(heads.select(*CELL)))
    order = F.array_position(F.array(*[F.lit(r) for r in PRIORITY]), F.col("rule"))
    all_ = reduce(DataFrame.unionByName, [heads, ten, masks(f)]).withColumn("_o", order)
    best = all_.withColumn("_k", F.row_number().over(Window.partitionBy(*CELL).orderBy("_o"))).where("_k = 1")
    taken = absorbed.join(heads.where("rule IN ('R2', 'R3', 'R12')").select(*CELL), CELL, "left_anti")
    return best.join(taken, CELL, "left_anti").drop("_o", "_k")


FIELD = [*PAGE, "type", "x0", "y0", "x1", "y1", "label", "rule", "confidence"]


def ruled_fields(chars: DataFrame, words: DataFrame, rects: DataFrame, pages: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    lines = written(write_on_lines(words, rects, pages, thresholds), "lines")
    parts = [cell_fields(words, rects, pages, thresholds, lines), lines, combs(words, rects, pages), leader_fields(chars, words, rects, pages)]
    return reduce(DataFrame.unionByName, [p.select(*FIELD) for p in parts])
