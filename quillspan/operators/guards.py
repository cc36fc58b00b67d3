"""Guards that need no truth: labels that the page doesn't bear out, and the guards of all forms pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators.ordered import PAGE
from quillspan.sources.scratch import written

# Margin of the band of words around a field's column; how many offenders are listed.
BAND, MOST_OFFENDERS, MOST_REPEATS = 30, 40, 15
SIGNALS = ("not_found_on_page", "internal_gap", "truncated_left", "truncated_right")

_WORD = "struct<line:bigint,x0:double,ix:bigint,x1:double,top:double,bottom:double,norm:string,blank:boolean>"


def _spans(norms: str) -> str:
    """The places (from 1) in an array of norms where the tokens of a field f stand; if nowhere, where the last token begins a word. The first word is compared before any run is cut out."""
    starts = f"CASE WHEN size({norms}) >= f.n THEN filter(sequence(1, size({norms}) - f.n + 1), i -> {{}}) ELSE cast(array() as array<int>) END"
    exact = starts.format(f"element_at({norms}, i) = f.toks[0] AND slice({norms}, i, f.n) = f.toks")
    last, end = "element_at(f.toks, -1)", f"element_at({norms}, i + f.n - 1)"
    begun = starts.format(f"(f.n = 1 OR element_at({norms}, i) = f.toks[0]) AND ({end} = {last} OR ({last} <> '' AND startswith({end}, {last}))) AND slice({norms}, i, f.n - 1) = slice(f.toks, 1, f.n - 1)")
    return f"transform(array({exact}), e -> CASE WHEN size(e) > 0 THEN e ELSE {begun} END)[0]"


def _nearest(words: str, starts: str) -> str:
    """The span whose mean corner lies nearest to the field's centre, the first of equal ones; null if there is none."""
    mean = lambda a, b: f"aggregate(slice({words}, i, f.n), 0D, (s, w) -> s + w.{a} + w.{b}) / (2 * f.n)"
    far = f"sqrt(pow({mean('x0', 'x1')} - f.cx, 2) + pow({mean('top', 'bottom')} - f.cy, 2))"
    return f"array_min(transform({starts}, i -> named_struct('far', {far}, 'i', i))).i"


def _pages(fields: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page: fs (its labelled fields that are no check boxes), ws (its words in reading order, on clustered lines), norms (of ws) and threshold.

    The three tables are brought together once, and all that follows runs within a row, so no page's words are copied for each of its fields.
    """
    word = F.struct(*[F.col(c).cast("double").alias(c) for c in ("top", "x0")], F.col("word_ix").cast("long").alias("ix"), *[F.col(c).cast("double").alias(c) for c in ("x1", "bottom")], X.normalize_plain(F.col("text")).alias("norm"), X.is_blank_or_glyph(F.col("text")).alias("blank"))
    toks = F.transform(X.tokenize(F.col("label")), X.normalize_plain)
    field = F.struct("di", F.coalesce("rule", F.lit("unknown")).alias("rule"), "label", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], toks.alias("toks"))
    labelled = fields.where((F.col("type") != "checkbox") & F.col("label").rlike(r"(?U)\S")).select(*PAGE, field.alias("f"))
    rows = words.where("text <> ''").select(*PAGE, word.alias("w")).unionByName(labelled, allowMissingColumns=True).unionByName(pages.select(*PAGE, F.struct("height").alias("p")), allowMissingColumns=True)
    g = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list("w")).alias("ws"), F.collect_list("f").alias("fs"), F.max("p").alias("p"))
    g = g.where("size(fs) > 0 AND p IS NOT NULL AND doc_id IS NOT NULL AND page IS NOT NULL")
    g = g.withColumn("fs", F.expr("transform(fs, f -> named_struct('di', f.di, 'rule', f.rule, 'label', f.label, 'x0', f.x0, 'x1', f.x1, 'toks', f.toks, 'n', size(f.toks), 'cx', (f.x0 + f.x1) / 2D, 'cy', p.height - (f.y0 + f.y1) / 2D))"))
    # lines as in cluster_lines: the first top of a line decides how far it goes
    g = g.withColumn("tops", F.expr("array_distinct(transform(ws, w -> w.top))"))
    # (each name is bound outside of the loop that reads it: a column that is named once would be put into the loop and made anew in every turn)
    anchors = "aggregate(tops, cast(array() as array<double>), (acc, t) -> CASE WHEN size(acc) > 0 AND t - element_at(acc, -1) <= 2.5D THEN acc ELSE array_append(acc, t) END)"
    lines = f"transform(array({anchors}), an -> transform(tops, t -> cast(size(filter(an, a -> a <= t)) - 1 as bigint)))[0]"
    put = "named_struct('line', get(ln, cast(array_position(tops, w.top) as int) - 1), 'x0', w.x0, 'ix', w.ix, 'x1', w.x1, 'top', w.top, 'bottom', w.bottom, 'norm', w.norm, 'blank', w.blank)"
    g = g.select(*PAGE, "fs", F.expr(f"transform(array({lines}), ln -> sort_array(transform(ws, w -> {put})))[0]").alias("ws"))
    # as gap_threshold: neighbours of a line follow each other here
    gap = "CASE WHEN get(ws, i).line = get(ws, i - 1).line THEN get(ws, i).x0 - get(ws, i - 1).x1 END"
    g = g.withColumn("gaps", F.expr(f"CASE WHEN size(ws) > 1 THEN sort_array(filter(transform(sequence(1, size(ws) - 1), i -> {gap}), v -> v > 0.1D)) ELSE cast(array() as array<double>) END"))
    median = "CASE WHEN size(gaps) > 0 THEN (get(gaps, (size(gaps) - 1) div 2) + get(gaps, size(gaps) div 2)) / 2 ELSE 3D END"
    return g.select(*PAGE, "fs", "ws", F.expr("transform(ws, w -> w.norm)").alias("norms"), F.expr(f"CASE WHEN size(ws) = 0 THEN 10D ELSE greatest(10D, least(30D, 3 * ({median}))) END").alias("threshold"))


def label_signals(fields: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, di, rule, reasons: one row per labelled field that is no check box, with what speaks against its label.

    A label is looked for among the page's words in reading order, then, if it isn't there, among those around the field's column, read as lines of their own. It isn't
    found at all, or has a wide gap between two of its words, or a word stands as close before or after it on its line as words of a phrase do. Blanks to fill in and
    check glyphs aren't words of a phrase. fields: doc_id, page, di, type, rule, label, x0, y0, x1, y1; pages: doc_id, page, height.
    """
    g = _pages(fields, words, pages)
    more = lambda name, expr: F.expr(f"transform(fs, f -> named_struct({', '.join(kept)}, '{name}', {expr}))")
    kept = [f"'{c}', f.{c}" for c in ("di", "rule", "label", "x0", "x1", "toks", "n", "cx", "cy")]
    g = g.withColumn("fs", more("at", _nearest("ws", _spans("norms"))))
    kept.append("'at', f.at")
    # words around the column, by top, each in the last line that begins close enough above it
    near = f"array_sort(transform(filter(ws, w -> (w.x0 + w.x1) / 2 BETWEEN f.x0 - {BAND} AND f.x1 + {BAND}), w -> named_struct('top', w.top, 'w', w)))"
    put = "named_struct('line', {line}, 'x0', z.w.x0, 'ix', z.w.ix, 'x1', z.w.x1, 'top', z.w.top, 'bottom', z.w.bottom, 'norm', z.w.norm, 'blank', z.w.blank)".format
    join, new = "a.line", "a.line + 1"
    state = "named_struct('line', {}, 'anchor', {}, 'out', {})".format
    opens = "a.anchor IS NULL OR z.top - a.anchor > 2.5D"
    step = f"(a, z) -> CASE WHEN {opens} THEN {state(new, 'z.top', f'array_append(a.out, {put(line=new)})')} ELSE {state(join, 'a.anchor', f'array_append(a.out, {put(line=join)})')} END"
    zero = state("cast(-1 as bigint)", "cast(null as double)", f"cast(array() as array<{_WORD}>)")
    g = g.withColumn("fs", more("band", f"CASE WHEN f.at IS NULL THEN array_sort(aggregate({near}, {zero}, {step}).out) ELSE cast(array() as array<{_WORD}>) END"))
    kept.append("'band', f.band")
    found = f"transform(array(transform(f.band, w -> w.norm)), bn -> {_nearest('f.band', _spans('bn'))})[0]"
    g = g.withColumn("fs", more("band_at", f"CASE WHEN size(f.band) > 0 THEN {found} END"))
    kept[:] = [f"'{c}', f.{c}" for c in ("di", "rule", "label", "n", "at")]
    g = g.withColumn("fs", more("span", "CASE WHEN f.at IS NOT NULL THEN slice(ws, f.at, f.n) WHEN f.band_at IS NOT NULL THEN slice(f.band, f.band_at, f.n) END"))
    first, second = "get(f.span, i - 2)", "get(f.span, i - 1)"
    inner = f"exists(sequence(2, greatest(f.n, 2)), i -> i <= f.n AND NOT {first}.blank AND NOT {second}.blank AND {first}.line = {second}.line AND {second}.x0 - {first}.x1 > threshold)"
    beside = "coalesce({o}.line = {e}.line AND NOT {o}.blank AND {gap} BETWEEN 0 AND threshold, false)".format
    before, after, start, end = "get(ws, f.at - 2)", "get(ws, f.at + f.n - 1)", "get(f.span, 0)", "get(f.span, f.n - 1)"
    left = beside(o=before, e=start, gap=f"{start}.x0 - {before}.x1")
    right = beside(o=after, e=end, gap=f"{after}.x0 - {end}.x1")
    told = ["f.span IS NULL", f"f.span IS NOT NULL AND ({inner})", f"f.at IS NOT NULL AND {left}", f"f.at IS NOT NULL AND {right}"]
    reasons = "filter(array(" + ", ".join(f"CASE WHEN {c} THEN '{s}' END" for s, c in zip(SIGNALS, told)) + "), r -> r IS NOT NULL)"
    out = g.select(*PAGE, F.explode(F.expr(f"transform(fs, f -> named_struct('di', f.di, 'rule', f.rule, 'label', f.label, 'reasons', {reasons}))")).alias("f"))
    # written once, since what reads the reasons would repeat the search for each use
    return written(out.select(*PAGE, "f.di", "f.rule", "f.label", "f.reasons"), "label-signals")


def label_plausibility(signals: DataFrame, *keys: str) -> DataFrame:
    """keys, total, flagged, fraction and the number of each signal; lower is better. Without keys one row."""
    counts = [F.sum(F.array_contains("reasons", s).cast("int")).alias(s) for s in SIGNALS]
    g = signals.groupBy(*keys).agg(F.count("*").alias("total"), F.coalesce(F.sum((F.size("reasons") > 0).cast("int")), F.lit(0)).alias("flagged"), *[F.coalesce(c, F.lit(0)).alias(s) for c, s in zip(counts, SIGNALS)])
    return g.withColumn("fraction", F.when(F.col("total") > 0, F.col("flagged").cast("double") / F.col("total")).otherwise(0.0))


def worst_labels(signals: DataFrame, most: int = MOST_OFFENDERS) -> DataFrame:
    """The flagged labels with most signals, then by document, page and field."""
    n = F.size("reasons")
    return signals.where(n > 0).orderBy(n.desc(), *PAGE, "di").limit(most)


def pooled_guards(ink: DataFrame, glyphs: DataFrame, fit: DataFrame, signals: DataFrame, repeats: DataFrame) -> DataFrame:
    """guard, value over all forms.

    ink (doc_id, coverage: of each field) weighs forms by their fields, over all fields; glyphs (doc_id, coverage, glyph_count) by their glyphs, 1 where there is none;
    stacked fractions (fit) are a plain mean over forms; labels count fields; repeats (total, duplicated) likewise. Without rows a guard is 0.
    """
    row = lambda df, name, value: df.agg(F.coalesce(value, F.lit(1.0 if name == "glyph_coverage" else 0.0)).alias("value")).select(F.lit(name).alias("guard"), "value")
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a).cast("double") / F.sum(b))
    return (
        row(ink, "box_over_ink", F.sum(F.col("offender").cast("int")).cast("double") / F.count("*"))
        .unionByName(row(glyphs, "glyph_coverage", share(F.round(F.col("coverage") * F.col("glyph_count")), "glyph_count")))
        .unionByName(row(fit, "stacked_fraction", F.avg("stacked_fraction")))
        .unionByName(row(signals, "label_plausibility", F.sum((F.size("reasons") > 0).cast("int")).cast("double") / F.count("*")))
        .unionByName(row(repeats, "label_duplication", share("duplicated", "total")))
    )


def most_repeated(labels: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """labels (doc_id, page, norm, c) -> the labels that a page repeats most."""
    return labels.where("c > 1").orderBy(F.desc("c"), *PAGE, "norm").limit(most)


def page_repeats(fields: DataFrame) -> DataFrame:
    """doc_id, page, norm, c: how often a page has a label, in normal form."""
    return fields.groupBy(*PAGE, X.normalize_plain(F.col("label")).alias("norm")).agg(F.count("*").alias("c"))


def detector_fingerprint(sources: DataFrame) -> DataFrame:
    """sources (path, content) -> fingerprint: twelve digits of the hash over the hashes of all files, in order of their paths."""
    each = F.struct("path", F.sha2("content", 256).alias("sha"))
    every = F.concat_ws("", F.transform(F.sort_array(F.collect_list(each)), lambda x: x["sha"]))
    return sources.agg(F.substring(F.sha2(every.cast("binary"), 256), 1, 12).alias("fingerprint"))

