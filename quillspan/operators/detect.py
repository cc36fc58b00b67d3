"""Detection rules that are relational: fields from underscores, mask cells and filled squares, with the page's labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators.cells import FIELD, OFFICE_USE, SIGNATURE, cut, ruled_fields
from quillspan.operators.ordered import PAGE, cluster_lines, gap_threshold, islands
from quillspan.sources.scratch import joined_by_measured_size, written

# Geometry of the rules in points.
RUN_TOP, RUN_GAP, RUN_WIDTH, LABEL_REACH = 1.5, 2, 12, 240
SHORT_RUN, SHORT_GAP, RUN_LEVEL = 25, 4, 6
SQUARE_LEAST, CURVE_LEAST, SQUARE_MOST, SQUARE_SLACK, CAPTION_GAP = 18, 14, 32, 8, 11
SQUARE_TRIM, SQUARE_CLAIMED, SIBLING_SIZE, SIBLING_TOP, SIBLING_SPOT = 8, 0.3, 4, 25, 3
GLYPH_LINE, GLYPH_WRAP, GLYPH_WRAPS, QUESTION_GAP, GLYPH_LABEL = 2, 14, 3, 60, 90
INK_MOST, INK_PAST, CORNER = 0.25, 2, 6
# Words after which a short run of underscores is no field.
STOP_WORDS = (
    "this", "that", "these", "those", "the", "a", "an", "of", "on",
    "in", "at", "and", "or", "is", "are", "was", "were", "to", "for",
    "by", "with", "as", "it", "its", "be",
)
#: Rules in the order in which they emit fields.
EMISSION = ("R1", "R2", "R3", "R12", "R14", "R16", "R17", "R10", "R4", "R5", "R5b", "R11", "R18")


def underscore_fields(chars: DataFrame, words: DataFrame, pages: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """A run of underscores at least 12 wide is a text field, named by the last six words before it on its line, within reach and up to the gutter.

    A run under 25 wide must follow close on a word of two letters or more that is no stop word. thresholds: doc_id, page, threshold (10 where a page has none).
    """
    u = chars.where("text = '_'").withColumn("row", F.bround("top"))
    w = Window.partitionBy(*PAGE).orderBy("row", "x0")
    breaks = ~((F.abs(F.col("top") - F.lag("top").over(w)) < RUN_TOP) & (F.col("x0") - F.lag("x1").over(w) < RUN_GAP))
    runs = islands(u, PAGE, ["row", "x0"], breaks).groupBy(*PAGE, "run").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min_by("top", "x0").alias("top"), F.min_by("bottom", "x0").alias("bottom")
    ).where(F.col("x1") - F.col("x0") >= RUN_WIDTH)
    r, k = runs.alias("r"), words.alias("k")
    level = F.abs(F.col("k.bottom") - F.col("r.bottom")) < RUN_LEVEL
    reach = (F.col("k.x1") <= F.col("r.x0") + 2) & (F.col("k.x1") > F.col("r.x0") - LABEL_REACH)
    on = (F.col("r.doc_id") == F.col("k.doc_id")) & (F.col("r.page") == F.col("k.page")) & level & reach
    word = F.struct(F.col("k.x0").cast("double").alias("x0"), F.col("k.x1").cast("double").alias("x1"), F.col("k.text").alias("text"))
    near = r.join(k, on, "left").groupBy(*[F.col(f"r.{c}").alias(c) for c in (*PAGE, "run", "x0", "x1", "top", "bottom")])
    near = near.agg(F.sort_array(F.collect_list(F.when(F.col("k.text").isNotNull(), word))).alias("ws"))
    limit = thresholds if thresholds is not None else pages.select(*PAGE, F.lit(10.0).alias("threshold"))
    near = near.join(limit, PAGE, "left").withColumn("threshold", F.coalesce("threshold", F.lit(10.0))).withColumn("last", F.try_element_at("ws", F.lit(-1)))
    bare = F.lower(F.regexp_replace("last.text", "^[.,:;?!'\"()]+|[.,:;?!'\"()]+$", ""))
    letters = F.length(F.regexp_replace("last.text", r"\P{L}", "")) >= 2
    follows = F.col("last").isNotNull() & (F.col("x0") - F.col("last.x1") <= SHORT_GAP) & F.col("last.text").rlike("[A-Za-z]") & letters & ~bare.isin(*STOP_WORDS)
    near = near.where((F.col("x1") - F.col("x0") >= SHORT_RUN) | F.coalesce(follows, F.lit(False)))
    kept = F.slice(F.reverse(F.split(F.expr(cut("ws", "last")), " ")), 1, 6)
    filled = F.filter(F.transform(F.reverse(kept), X.strip_fill), lambda t: t != "")
    label = F.coalesce(F.nullif(F.substring(F.array_join(filled, " "), 1, 60), F.lit("")), F.lit("line"))
    return near.join(pages, PAGE).select(
        *PAGE, F.lit("text").alias("type"), (F.col("x0") + 1).alias("x0"), (F.col("height") - F.col("bottom") + 1).alias("y0"), (F.col("x1") - 1).alias("x1"),
        (F.col("height") - F.col("top") + 11).alias("y1"), label.alias("label"), F.lit("R5").alias("rule"), F.lit(0.65).alias("confidence"),
    )


def _same_page(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page") == F.col(f"{b}.page"))


def _squares(shapes: DataFrame, least: float) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    ok = w.between(least, SQUARE_MOST) & h.between(least, SQUARE_MOST) & (F.abs(w - h) <= SQUARE_SLACK)
    return shapes.where("fill and not stroke").where(ok).select(*PAGE, "rect_ix", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")])


def square_fields(rects: DataFrame, words: DataFrame, pages: DataFrame, curves: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """A filled square without a stroke is a check box if words follow it on its line.

    curves (as rect_like_curves gives them) may be smaller, but need another of their size near by. Of nested squares the inner counts, of equal ones both. A square
    goes where earlier fields (doc_id, page, x0, y0, x1, y1) cover three tenths of it, or where words lie in its midst; those near its upper or lower edge don't
    matter. Its caption begins at any distance, goes on while gaps are small, and ends before the next square on the line.
    """
    cand = _squares(rects, SQUARE_LEAST).withColumn("kind", F.lit(0))
    if curves is not None:
        c = _squares(curves, CURVE_LEAST)
        size = lambda p, a, b: F.col(f"{p}.{b}") - F.col(f"{p}.{a}")
        alike = (F.abs(size("a", "x0", "x1") - size("b", "x0", "x1")) <= SIBLING_SIZE) & (F.abs(size("a", "top", "bottom") - size("b", "top", "bottom")) <= SIBLING_SIZE)
        near = F.abs(F.col("a.top") - F.col("b.top")) <= SIBLING_TOP
        apart = (F.abs(F.col("a.x0") - F.col("b.x0")) > SIBLING_SPOT) | (F.abs(F.col("a.top") - F.col("b.top")) > SIBLING_SPOT)
        kin = c.alias("a").join(c.alias("b"), _same_page("a", "b") & (F.col("a.rect_ix") != F.col("b.rect_ix")) & alike & near & apart, "left_semi")
        cand = cand.unionByName(kin.withColumn("kind", F.lit(1)))
    a, b = cand.alias("a"), cand.alias("b")
    area = lambda p: (F.col(f"{p}.x1") - F.col(f"{p}.x0")) * (F.col(f"{p}.bottom") - F.col(f"{p}.top"))
    holds = (F.col("b.x0") >= F.col("a.x0") - 1) & (F.col("b.x1") <= F.col("a.x1") + 1) & (F.col("b.top") >= F.col("a.top") - 1) & (F.col("b.bottom") <= F.col("a.bottom") + 1)
    inner = a.join(b, _same_page("a", "b") & holds & (area("a") > area("b") + 1), "left_anti")
    inner = inner.join(pages.select(*PAGE, F.col("height").alias("H")), PAGE)
    r, k = inner.alias("r"), words.alias("k")
    mid = lambda p: (F.col(f"{p}.top") + F.col(f"{p}.bottom")) / 2
    upper, lower = F.col("k.top") - F.col("r.top"), F.col("r.bottom") - F.col("k.bottom")
    over = (F.col("k.x1") > F.col("r.x0")) & (F.col("k.x0") < F.col("r.x1")) & (F.col("k.bottom") > F.col("r.top")) & (F.col("k.top") < F.col("r.bottom"))
    at_edge = ((upper <= SQUARE_TRIM) & (upper <= lower)) | (lower <= SQUARE_TRIM)
    open_ = r.join(k, _same_page("r", "k") & over & F.col("k.text").rlike("[A-Za-z]") & ~at_edge, "left_anti")
    if earlier is not None:
        e, o = earlier.alias("e"), open_.alias("r")
        w = F.least("e.x1", "r.x1") - F.greatest("e.x0", "r.x0")
        h = F.least(F.col("e.y1"), F.col("r.H") - F.col("r.top")) - F.greatest(F.col("e.y0"), F.col("r.H") - F.col("r.bottom"))
        open_ = o.join(e, _same_page("r", "e") & (w > 0) & (h > 0) & (w * h >= SQUARE_CLAIMED * area("r")), "left_anti")
    o, n = open_.alias("r"), inner.alias("n")
    beside = _same_page("r", "n") & (F.col("n.x0") > F.col("r.x1")) & (F.abs(mid("n") - mid("r")) < GLYPH_LINE)
    key = [*PAGE, "kind", "rect_ix", "x0", "x1", "top", "bottom", "H"]
    bound = o.join(n, beside, "left").groupBy(*[F.col(f"r.{c}").alias(c) for c in key]).agg(F.min("n.x0").alias("next")).alias("r")
    on = _same_page("r", "k") & (F.abs(mid("k") - mid("r")) < GLYPH_LINE) & (F.col("k.x0") >= F.col("r.x1")) & (F.col("r.next").isNull() | (F.col("k.x1") <= F.col("r.next") + 1))
    line = F.sort_array(F.collect_list(F.struct(F.col("k.x0").cast("double").alias("x0"), F.col("k.x1").cast("double").alias("x1"), F.col("k.text").alias("text"))))
    told = bound.join(words.alias("k"), on).groupBy(*[F.col(f"r.{c}").alias(c) for c in key]).agg(line.alias("line"))
    text = F.rtrim(F.regexp_replace(F.expr(f"array_join({_picked('line', 'x1', 1e9, True)}, ' ')"), ":+$", ""))
    told = told.withColumn("label", F.trim(text))
    good = F.length("label").between(2, 60) & F.col("label").rlike("[A-Za-z]") & ~F.col("label").rlike(OFFICE_USE) & ~F.col("label").rlike("[.?]$")
    return told.where(good).select(
        *PAGE, F.lit("checkbox").alias("type"), "x0", (F.col("H") - F.col("bottom")).alias("y0"), "x1", (F.col("H") - F.col("top")).alias("y1"), "label",
        F.lit("R18").alias("rule"), F.lit(0.5).alias("confidence"),
    )


def _picked(seq: str, start: str, first: str | int, rightwards: bool) -> str:
    """The texts of the words of seq as far as each is at most CAPTION_GAP from the one before (the first: `first` from start)."""
    gap, edge = ("w.x0 - a.at", "w.x1") if rightwards else ("a.at - w.x1", "w.x0")
    state = "named_struct('t', {}, 'at', {}, 'most', {}, 'open', {})".format
    zero = state("cast(array() as array<string>)", f"cast({start} as double)", f"{float(first)}D", "true")
    keep, stop = state("array_append(a.t, w.text)", edge, f"{float(CAPTION_GAP)}D", "true"), state("a.t", "a.at", "a.most", "false")
    return f"aggregate({seq}, {zero}, (a, w) -> CASE WHEN NOT a.open OR {gap} > a.most THEN {stop} ELSE {keep} END).t"


def glyph_fields(chars: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Every check glyph is a check box. Its option is read to the right as far as the next glyph, wraps included, or else to the left;
    a question before the line's first glyph goes before it: "question (option)", at most GLYPH_LABEL long. Without an option the label is empty."""
    cs = chars.where(F.col("text").isin(*X.CHECK_GLYPHS)).select(*PAGE, *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")])
    c, k = cs.join(pages.select(*PAGE, F.col("width").alias("W"), F.col("height").alias("H")), PAGE).alias("c"), words.alias("k")
    word = F.struct(*[F.col(f"k.{n}").cast("double").alias(n) for n in ("x0", "top", "x1", "bottom")], F.col("k.text").alias("text"), F.col("k.text").isin(*X.CHECK_GLYPHS).alias("glyph"))
    level = F.abs(F.col("k.top") + F.col("k.bottom") - F.col("c.top") - F.col("c.bottom")) / 2 < GLYPH_LINE
    below = F.col("k.top").between(F.col("c.bottom") - 1, F.col("c.bottom") + GLYPH_WRAPS * 3 * GLYPH_WRAP)
    on = (F.col("c.doc_id") == F.col("k.doc_id")) & (F.col("c.page") == F.col("k.page")) & (level | below)
    g = c.join(k, on, "left").groupBy(*[F.col(f"c.{n}").alias(n) for n in (*PAGE, "x0", "top", "x1", "bottom", "W", "H")]).agg(F.sort_array(F.collect_list(F.when(level, word))).alias("line"), F.sort_array(F.collect_list(F.when(below, word))).alias("near"))
    g = g.withColumns({"hi": F.expr("coalesce(array_min(transform(filter(line, w -> w.glyph AND w.x0 > x1), w -> w.x0)), cast(W as double))"), "lo": F.expr("coalesce(array_max(transform(filter(line, w -> w.glyph AND w.x1 < x0), w -> w.x1)), 0D)"), "head": F.expr("coalesce(array_min(transform(filter(line, w -> w.glyph), w -> w.x0)), x0)"), "plain": F.expr("filter(line, w -> NOT w.glyph)")})
    between = "filter({}, w -> w.x0 >= x1 - 1 AND w.x1 <= hi + 1)"
    next_line = f"transform(array(filter(near, w -> w.top BETWEEN s.bottom - 1 AND s.bottom + {GLYPH_WRAP})), b -> filter(b, w -> abs(w.top - array_min(transform(b, z -> z.top))) < 2))"
    own = between.format("l")
    joins = f"exists(l, w -> w.x1 <= {own}[0].x0 + 1 AND {own}[0].x0 - w.x1 <= {CAPTION_GAP})"
    wrapped = _picked(own, "x1", CAPTION_GAP, True)
    shut = "named_struct('t', s.t, 'bottom', s.bottom, 'open', false)"
    fold = f"CASE WHEN size({own}) = 0 OR exists(l, w -> w.glyph) OR {joins} OR size({wrapped}) = 0 THEN {shut} ELSE named_struct('t', concat(s.t, {wrapped}), 'bottom', array_max(transform(l, w -> w.bottom)), 'open', true) END"
    more = f"aggregate(sequence(1, {GLYPH_WRAPS}), named_struct('t', right, 'bottom', bottom, 'open', true), (s, i) -> CASE WHEN NOT s.open THEN s ELSE transform({next_line}, l -> {fold})[0] END).t"
    g = g.withColumn("right", F.expr(_picked(between.format("plain"), "x1", CAPTION_GAP, True))).withColumn("right", F.expr(more))
    g = g.withColumns({"left": F.expr(f"reverse({_picked('reverse(filter(plain, w -> w.x1 <= x0 + 1 AND w.x1 >= lo - 1))', 'x0', CAPTION_GAP, False)})"), "ask": F.expr(f"reverse({_picked('reverse(filter(plain, w -> w.x1 <= head + 1))', 'head', QUESTION_GAP, False)})")})
    g = g.withColumn("option", F.expr("array_join(CASE WHEN size(right) > 0 THEN right ELSE left END, ' ')")).withColumn("tail", F.expr("concat(' (', option, ')')"))
    room = f"{GLYPH_LABEL} - length(tail)"
    asked = "size(ask) > 0 AND lower(trim(element_at(ask, -1))) NOT IN ('yes', 'no')"
    label = f"CASE WHEN option = '' THEN '' WHEN ({asked}) AND {room} > 0 THEN concat(rtrim(substr(array_join(ask, ' '), 1, {room})), tail) ELSE substr(option, 1, {GLYPH_LABEL}) END"
    return g.selectExpr(*PAGE, "'checkbox' AS type", "x0", "H - bottom AS y0", "x1", "H - top AS y1", f"{label} AS label", "'R1' AS rule", "0.99D AS confidence")


def drop_inked(fields: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """Other than check boxes, fields go of which over INK_MOST is printed on, by a line that goes on outside the box; a box without area counts as all ink."""
    ink = chars.where(~F.col("text").isin(*X.CHECK_GLYPHS, "_", " ", "\xa0", "") & (F.trim("text") != "")).join(pages.select(*PAGE, F.col("height").alias("H")), PAGE)
    ink = ink.select(*PAGE, F.bround("top").alias("row"), "x0", "x1", (F.col("H") - F.col("bottom")).alias("y0"), (F.col("H") - F.col("top")).alias("y1"))
    f, k = fields.where("type <> 'checkbox'").select(*FIELD).distinct().alias("f"), ink.alias("k")
    same = (F.col("f.doc_id") == F.col("k.doc_id")) & (F.col("f.page") == F.col("k.page"))
    meets = (F.col("k.x1") > F.col("f.x0")) & (F.col("k.x0") < F.col("f.x1")) & (F.col("k.y1") > F.col("f.y0")) & (F.col("k.y0") < F.col("f.y1"))
    part = (F.least("f.x1", "k.x1") - F.greatest("f.x0", "k.x0")) * (F.least("f.y1", "k.y1") - F.greatest("f.y0", "k.y0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hit = f.join(k, same & meets).groupBy(*[F.col(f"f.{c}").alias(c) for c in FIELD]).agg(F.sum(part).alias("inked"), F.collect_set("k.row").alias("rows"))
    hit = hit.where((area <= 0) | (F.col("inked") > INK_MOST * area)).alias("f")
    past = same & F.array_contains(F.col("f.rows"), F.col("k.row")) & ((F.col("k.x1") < F.col("f.x0") - INK_PAST) | (F.col("k.x0") > F.col("f.x1") + INK_PAST))
    gone = hit.join(k, past, "left_semi").select(*FIELD)
    on = [fields[c].eqNullSafe(gone[c]) for c in FIELD if c not in PAGE]
    return fields.join(gone, [fields[c] == gone[c] for c in PAGE] + on, "left_anti")


def rect_like_curves(curves: DataFrame) -> DataFrame:
    """Curves that draw a rectangle, as page-object rects: closed, of moves, lines and arcs only, every anchor near a corner of the bounding box."""
    near = "least(abs(p.x - x0), abs(p.x - x1)) <= slack AND least(abs(p.y - top), abs(p.y - bottom)) <= slack"
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    c = curves.withColumns({"width": w, "height": h, "slack": F.least(F.lit(float(CORNER)), F.least(w, h) / 2 + 0.5)}).where("width > 0 AND height > 0 AND size(path) > 0 AND path[0].op = 'm' AND element_at(path, -1).op = 'h'")
    c = c.where(f"forall(path, p -> p.op IN ('m', 'l', 'c', 'h') AND (p.op = 'h' OR ({near})))")
    return c.select(*PAGE, F.col("curve_ix").alias("rect_ix"), "x0", "x1", "top", "bottom", "width", "height", F.coalesce("fill", F.lit(False)).alias("fill"), F.coalesce("stroke", F.lit(False)).alias("stroke"))


def number_fields(fields: DataFrame) -> DataFrame:
    """Adds id: p<page>_<slug> for text fields, p<page>_chk for all others, with _2, _3 for repeats in the order of emission: by page, rule, and from the page's top left.

    Labels lose dot leaders; an empty label of a text field becomes 'value'.
    """
    label = X.strip_leaders(F.coalesce("label", F.lit("")))
    f = fields.withColumn("label", F.when((F.col("type") == "text") & (label == ""), "value").otherwise(label))
    base = F.concat(F.lit("p"), F.col("page"), F.lit("_"), F.when(F.col("type") == "text", X.slug(F.col("label"))).otherwise("chk"))
    order = F.array_position(F.array(*map(F.lit, EMISSION)), F.col("rule"))
    k = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("page", order, F.desc("y1"), "x0", "x1"))
    return f.withColumn("base", base).withColumn("k", k).withColumn("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), "k"))).drop("base", "k")


def group_yes_no(fields: DataFrame) -> DataFrame:
    """Adds group: grp_1, grp_2, ... for the check boxes of one question of a page whose options are yes and no, once each; numbered by their first field's emission."""
    order = F.array_position(F.array(*map(F.lit, EMISSION)), F.col("rule"))
    at = F.struct("page", order.alias("o"), (-F.col("y1")).alias("y"), "x0", "id")
    o = fields.where("type = 'checkbox'").select("doc_id", "page", "id", at.alias("at"), F.trim(X.prompt_of(F.col("label"))).alias("prompt"), F.lower(F.trim(X.option_of(F.col("label")))).alias("option"))
    o = o.where("option IN ('yes', 'no')")
    pairs = o.groupBy("doc_id", "page", "prompt").agg(F.sort_array(F.collect_list("option")).alias("options"), F.min("at").alias("first"), F.collect_list("id").alias("ids"))
    pairs = pairs.where(F.col("options") == F.array(F.lit("no"), F.lit("yes")))
    named = pairs.withColumn("group", F.concat(F.lit("grp_"), F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))))
    return fields.join(named.select("doc_id", F.explode("ids").alias("id"), "group"), ["doc_id", "id"], "left")


def notices(pages: DataFrame, fields: DataFrame, scanned: DataFrame, read: DataFrame) -> DataFrame:
    """doc_id, code: 'scanned' where half of the pages or more are scans that nothing was read from, else 'ocr_assisted' where a page was read, else 'no_fields' where
    there are none, else null. scanned and read: doc_id, page."""
    lost = scanned.select(*PAGE).distinct().join(read.select(*PAGE).distinct(), PAGE, "left_anti").groupBy("doc_id").agg(F.count("*").alias("lost"))
    helped = read.select("doc_id").distinct().withColumn("helped", F.lit(True))
    some = fields.select("doc_id").distinct().withColumn("some", F.lit(True))
    d = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n")).join(lost, "doc_id", "left").join(helped, "doc_id", "left").join(some, "doc_id", "left")
    code = F.when(2 * F.coalesce("lost", F.lit(0)) >= F.col("n"), "scanned").when(F.col("helped"), "ocr_assisted").when(F.col("some").isNull(), "no_fields")
    return d.select("doc_id", code.alias("code"))


def drop_signatures(fields: DataFrame) -> DataFrame:
    """Other than check boxes, fields labelled for a signature go."""
    return fields.where((F.col("type") == "checkbox") | ~F.col("label").rlike(SIGNATURE))


def detect(chars: DataFrame, words: DataFrame, rects: DataFrame, pages: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """All rules, then R8 and R9, then ids and groups of yes and no. What the rules found is written once, since the filters read it more than once; so is the result."""
    with joined_by_measured_size(chars.sparkSession):
        thresholds = written(gap_threshold(cluster_lines(words).drop("line_no").withColumnRenamed("line", "line_no")), "thresholds")
        first = [glyph_fields(chars, words, pages), underscore_fields(chars, words, pages, thresholds), ruled_fields(chars, words, rects, pages, thresholds)]
        found = written(reduce(DataFrame.unionByName, [f.select(*FIELD) for f in first]), "fields")
        shapes = None if curves is None else rect_like_curves(curves)
        squares = written(square_fields(rects, words, pages, shapes, found).select(*FIELD), "squares")
        return written(group_yes_no(number_fields(drop_inked(drop_signatures(found.unionByName(squares)), chars, pages))), "detected")
