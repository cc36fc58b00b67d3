"""Ordered-sequence operators: folds over sorted arrays (in the JVM) and gaps-and-islands windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def cluster_lines(rows: DataFrame, tol: float = 2.5) -> DataFrame:
    """Adds line: rows in order of top join the open line while top - the line's first top <= tol. The anchor, not the neighbour, decides, so this is a fold."""
    tops = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.col("top").cast("double"))).alias("tops"))
    empty = "cast(array() as array<double>)"
    anchors = F.expr(f"aggregate(tops, {empty}, (acc, t) -> CASE WHEN size(acc) > 0 AND t - element_at(acc, -1) <= {tol}D THEN acc ELSE array_append(acc, t) END)")
    # merged in order where both sides are: by the bytes of its file alone a table of small numbers would be taken for a short one and broadcast
    placed = rows.withColumn("top", F.col("top").cast("double")).where("top IS NOT NULL").hint("merge").join(tops.select(*PAGE, anchors.alias("_anchors")), PAGE)
    # anchors ascend and are over tol apart, so a top's line is the last one that begins at or above it
    return placed.withColumn("line", F.size(F.filter("_anchors", lambda a: a <= F.col("top"))).cast("long") - 1).drop("_anchors")


def gap_threshold(words: DataFrame) -> DataFrame:
    """doc_id, page, threshold: three times the median gap (over 0.1) of neighbours on a line, kept between 10 and 30; a page without gaps counts as gap 3."""
    w = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "word_ix")
    gaps = words.where("text <> ''").withColumn("gap", F.col("x0") - F.lag("x1").over(w))
    m = F.coalesce(F.median(F.when(F.col("gap") > 0.1, F.col("gap"))), F.lit(3.0))
    return gaps.groupBy(*PAGE).agg(F.greatest(F.lit(10.0), F.least(F.lit(30.0), 3 * m)).alias("threshold"))


def islands(rows: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Adds run: numbered anew wherever `breaks` holds (it may use lag over the window given by by and order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_b")


def char_runs(chars: DataFrame, tops: float = 1.5, gap: float = 2) -> DataFrame:
    """Runs of neighbouring marks: same line within `tops`, next one less than `gap` away."""
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "rect_ix")
    breaks = ~((F.abs(F.col("top") - F.lag("top").over(w)) < tops) & (F.col("x0") - F.lag("x1").over(w) < gap))
    return islands(chars, PAGE, ["top", "x0", "rect_ix"], breaks)


def gutter_cut(words: DataFrame, threshold: float = 10) -> DataFrame:
    """The words of a line before its first gap over the threshold that follows a word with a letter."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("word_ix")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    letters = F.coalesce(F.max(F.col("text").rlike("[A-Za-z]").cast("int")).over(before), F.lit(0))
    cut = ((F.col("x0") - F.lag("x1").over(w)) > threshold) & (letters == 1)
    marked = words.withColumn("_c", F.coalesce(cut, F.lit(False)).cast("int"))
    return marked.withColumn("_s", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_s = 0").drop("_c", "_s")


def merge_rules(rects: DataFrame, gap: float = 3, span: float = 2) -> DataFrame:
    """doc_id, page, x0, x1, top, bottom, n: horizontal strokes folded, in order of top then x0, into the first envelope within `gap` below it and `span` at both ends."""
    xs = rects.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), F.col("bottom").cast("double").alias("bottom"), F.lit(1).cast("long").alias("n")))).alias("xs"))
    fits = f"x.top - e.bottom <= {gap}D AND abs(x.x0 - e.x0) <= {span}D AND abs(x.x1 - e.x1) <= {span}D"
    first = f"array_position(transform(acc, e -> {fits}), true)"
    grown = "named_struct('top', least(e.top, x.top), 'x0', least(e.x0, x.x0), 'x1', greatest(e.x1, x.x1), 'bottom', greatest(e.bottom, x.bottom), 'n', e.n + 1)"
    fold = f"aggregate(xs, cast(array() as array<struct<top:double,x0:double,x1:double,bottom:double,n:bigint>>), (acc, x) -> CASE WHEN {first} = 0 THEN array_append(acc, x) ELSE transform(acc, (e, i) -> CASE WHEN i + 1 = {first} THEN {grown} ELSE e END) END)"
    return xs.select(*PAGE, F.explode(F.expr(fold)).alias("e")).select(*PAGE, "e.x0", "e.x1", "e.top", "e.bottom", "e.n")


def cluster_columns(cells: DataFrame, tol: float = 16) -> DataFrame:
    """doc_id, page, x0 (mean), n: cells by x0, each to the first column whose running mean lies within tol."""
    xs = cells.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.col("x0").cast("double"))).alias("xs"))
    first = f"array_position(transform(acc, e -> abs(x - e.s / e.n) <= {tol}D), true)"
    fold = f"aggregate(xs, cast(array() as array<struct<s:double,n:bigint>>), (acc, x) -> CASE WHEN {first} = 0 THEN array_append(acc, named_struct('s', x, 'n', 1L)) ELSE transform(acc, (e, i) -> CASE WHEN i + 1 = {first} THEN named_struct('s', e.s + x, 'n', e.n + 1) ELSE e END) END)"
    return xs.select(*PAGE, F.posexplode(F.expr(fold)).alias("column", "e")).select(*PAGE, F.col("column").cast("long").alias("column"), (F.col("e.s") / F.col("e.n")).alias("x0"), F.col("e.n").alias("n"))


def column_members(cells: DataFrame, tol: float = 16) -> DataFrame:
    """doc_id, page, cell, column: the column that took each cell when it came, in order of x0 and cell; the column's later mean doesn't matter."""
    xs = cells.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("x0").cast("double").alias("x"), "cell"))).alias("xs"))
    state = "cast(array() as array<struct<s:double,n:bigint>>)"
    first = f"array_position(transform(acc.cols, e -> abs(x.x - e.s / e.n) <= {tol}D), true)"
    grown = f"transform(acc.cols, (e, i) -> CASE WHEN i + 1 = {first} THEN named_struct('s', e.s + x.x, 'n', e.n + 1) ELSE e END)"
    cols = f"CASE WHEN {first} = 0 THEN array_append(acc.cols, named_struct('s', x.x, 'n', 1L)) ELSE {grown} END"
    at = f"CASE WHEN {first} = 0 THEN cast(size(acc.cols) as bigint) ELSE {first} - 1 END"
    fold = f"aggregate(xs, named_struct('cols', {state}, 'at', cast(array() as array<bigint>)), (acc, x) -> named_struct('cols', {cols}, 'at', array_append(acc.at, {at}))).at"
    return xs.select(*PAGE, F.explode(F.arrays_zip("xs", F.expr(fold).alias("column"))).alias("z")).select(*PAGE, F.col("z.xs.cell").alias("cell"), F.col("z.column").alias("column"))


def comb_runs(rects: DataFrame) -> DataFrame:
    """doc_id, page, x0, x1, ticks: ticks (width < 3, height 10 to 40) by x0 whose steps are 6 to 20 and within 3 of the one before, level within 1.5; at least six steps."""
    ticks = rects.where("width < 3 AND height BETWEEN 10 AND 40")
    xs = ticks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("x0").cast("double").alias("x"), F.col("top").cast("double").alias("t"), F.col("bottom").cast("double").alias("b")))).alias("xs"))
    last = "element_at(acc, -1)"
    step = f"(x.x - {last}.x1)"
    same = f"size(acc) > 0 AND {step} BETWEEN 6 AND 20 AND abs(x.t - {last}.t) <= 1.5 AND abs(x.b - {last}.b) <= 1.5 AND ({last}.n = 1 OR abs({step} - {last}.g) <= 3)"
    new = "named_struct('x0', x.x, 'x1', x.x, 't', x.t, 'b', x.b, 'g', 0D, 'n', 1L)"
    grown = f"named_struct('x0', {last}.x0, 'x1', x.x, 't', {last}.t, 'b', {last}.b, 'g', {step}, 'n', {last}.n + 1)"
    fold = f"aggregate(xs, cast(array() as array<struct<x0:double,x1:double,t:double,b:double,g:double,n:bigint>>), (acc, x) -> CASE WHEN {same} THEN array_append(slice(acc, 1, size(acc) - 1), {grown}) ELSE array_append(acc, {new}) END)"
    return xs.select(*PAGE, F.explode(F.expr(fold)).alias("e")).where("e.n >= 7").select(*PAGE, "e.x0", "e.x1", F.col("e.n").alias("ticks"))


def named_rows(rows: DataFrame, *more: str, base: str = "base") -> DataFrame:
    """One row a document: zs, its rows by ord (ord, base, what else is named, and name: base, base_2, ..., skipping every name already given in the document)."""
    xs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", base, *more))).alias("xs"))
    tries = f"transform(sequence(2, size(acc) + 2), k -> concat(x.{base}, '_', k))"
    name = f"CASE WHEN NOT array_contains(acc, x.{base}) THEN x.{base} ELSE element_at(filter({tries}, n -> NOT array_contains(acc, n)), 1) END"
    names = f"aggregate(xs, cast(array() as array<string>), (acc, x) -> array_append(acc, {name}))"
    kept = "".join(f", '{c}', x.{c}" for c in ("ord", base, *more))
    return xs.select("doc_id", F.expr(f"zip_with(xs, {names}, (x, name) -> named_struct('name', name{kept}))").alias("zs"))


def unique_names(rows: DataFrame, base: str = "base") -> DataFrame:
    """Adds name: base, base_2, ... by ord, skipping every name already given in the document; names of a document are folded in order."""
    return named_rows(rows, base=base).select("doc_id", F.inline_outer("zs")).select("doc_id", "ord", "name")
