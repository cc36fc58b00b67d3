"""Named queries over folds, labels, pooled guards, the gate and the crawl; their oracles say the same in another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import crawl, gate, guards, metrics, ordered
from quillspan.plans import catalog
from quillspan.plans import views as V
from quillspan.plans.catalog import query
from quillspan.plans.views import duck
from quillspan.sources.scratch import written

# Folds, as list folds of the other engine

_JITTER = ", j AS (SELECT doc_id, page, CAST(top + rect_ix % 4 AS DOUBLE) AS top, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(bottom + rect_ix % 4 AS DOUBLE) AS bottom FROM v_rects WHERE height < 3 AND width >= 5)"
_MERGE = """, xs AS (SELECT doc_id, page, list([{'top': top, 'x0': x0, 'x1': x1, 'bottom': bottom, 'n': 1::BIGINT}] ORDER BY top, x0, x1, bottom) AS xs FROM j GROUP BY ALL),
f AS (SELECT doc_id, page, unnest(list_reduce(xs, lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda e: x[1].top - e.bottom <= 3 AND abs(x[1].x0 - e.x0) <= 2 AND abs(x[1].x1 - e.x1) <= 2)) = 0 THEN list_concat(acc, x)
  ELSE list_transform(acc, lambda e, i: CASE WHEN i = list_position(list_transform(acc, lambda y: x[1].top - y.bottom <= 3 AND abs(x[1].x0 - y.x0) <= 2 AND abs(x[1].x1 - y.x1) <= 2), true)
    THEN {'top': least(e.top, x[1].top), 'x0': least(e.x0, x[1].x0), 'x1': greatest(e.x1, x[1].x1), 'bottom': greatest(e.bottom, x[1].bottom), 'n': e.n + 1} ELSE e END) END)) AS e FROM xs)
SELECT doc_id, page, e.x0 AS x0, e.x1 AS x1, e.top AS top, e.bottom AS bottom, e.n AS n FROM f"""
query("merge_rules", duck(_JITTER + _MERGE, "v_rects"))(lambda s, d: ordered.merge_rules(catalog._JIT(s, d).where("height < 3 AND width >= 5")))

_COLUMNS = """, xs AS (SELECT doc_id, page, list([{'s': CAST(x0 AS DOUBLE), 'n': 1::BIGINT}] ORDER BY x0) AS xs FROM v_rects GROUP BY ALL),
f AS (SELECT doc_id, page, list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: abs(x[1].s - e.s / e.n) <= 16)) = 0 THEN list_concat(acc, x)
  ELSE list_transform(acc, lambda e, i: CASE WHEN i = list_position(list_transform(acc, lambda y: abs(x[1].s - y.s / y.n) <= 16), true) THEN {'s': e.s + x[1].s, 'n': e.n + 1} ELSE e END) END) AS es FROM xs),
u AS (SELECT doc_id, page, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS "column" FROM f)
SELECT doc_id, page, "column", e.s / e.n AS x0, e.n AS n FROM u"""
query("column_cluster", duck(_COLUMNS, "v_rects"))(lambda s, d: ordered.cluster_columns(V.rects(s, d)))

_COMB = """, t AS (SELECT DISTINCT doc_id, page, CAST(x0 AS DOUBLE) AS x, CAST(top AS DOUBLE) AS t, rank() OVER (PARTITION BY doc_id, page ORDER BY x0, top, word_ix, line_no) AS k FROM v_words WHERE text <> ''),
xs AS (SELECT doc_id, page, list([{'x0': x, 'x1': x, 't': t, 'g': 0::DOUBLE, 'n': 1::BIGINT}] ORDER BY x, t) AS xs FROM t GROUP BY ALL),
f AS (SELECT doc_id, page, unnest(list_reduce(xs, lambda acc, x: CASE WHEN x[1].x0 - acc[-1].x1 BETWEEN 6 AND 20 AND abs(x[1].t - acc[-1].t) <= 1.5 AND (acc[-1].n = 1 OR abs(x[1].x0 - acc[-1].x1 - acc[-1].g) <= 3)
  THEN list_concat(acc[:-2], [{'x0': acc[-1].x0, 'x1': x[1].x1, 't': acc[-1].t, 'g': x[1].x0 - acc[-1].x1, 'n': acc[-1].n + 1}]) ELSE list_concat(acc, x) END)) AS e FROM xs)
SELECT doc_id, page, e.x0 AS x0, e.x1 AS x1, e.n AS ticks FROM f WHERE e.n >= 7"""
_TICKS = """, g AS (SELECT l_orderkey AS doc_id, 1::BIGINT AS page, l_suppkey % 2 AS lane, i, CAST(l_linenumber AS BIGINT) * 400 + i * (8 + l_partkey % 3) + CASE WHEN i > 9 AND l_partkey % 5 = 0 THEN 30 ELSE 0 END AS x FROM (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l, (SELECT unnest(range(20)) AS i) r),
xs AS (SELECT doc_id, page, list([{'x0': CAST(x AS DOUBLE), 'x1': CAST(x AS DOUBLE), 't': CAST(lane * 100 AS DOUBLE), 'g': 0::DOUBLE, 'n': 1::BIGINT}] ORDER BY x, lane) AS xs FROM g GROUP BY ALL),"""


@query("comb_runs", "WITH " + (_TICKS + _COMB[_COMB.index("\nf AS") :]).lstrip(", "))
def comb_runs(s, d):
    """Combs of twenty ticks for each line of an order, some with a gap in the midst, dealt to two heights."""
    # all of an order is in one task before its ticks are made, so that no tick travels
    lines = V.lines_of(s, d).select(F.col("o").alias("l_orderkey"), F.col("l").alias("l_linenumber"), F.col("p").alias("l_partkey"), F.col("s").alias("l_suppkey"))
    x = F.expr("l_linenumber * 400L + i * (8 + l_partkey % 3) + CASE WHEN i > 9 AND l_partkey % 5 = 0 THEN 30 ELSE 0 END")
    ticks = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).cast("long").alias("page"), x.alias("x0"), (F.col("l_suppkey") % 2 * 100).alias("top"))
    return ordered.comb_runs(ticks.selectExpr("*", "x0 + 1 AS x1", "top + 20 AS bottom", "1 AS width", "20 AS height"))


_NAMES = """, s AS (SELECT doc_id, di, coalesce(nullif(substr(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40), ''), 'field') AS base FROM v_det),
xs AS (SELECT doc_id, list(di ORDER BY di) AS ds, list([base] ORDER BY di) AS bs FROM s GROUP BY doc_id),
f AS (SELECT doc_id, ds, list_reduce(bs, lambda acc, x: list_concat(acc, [CASE WHEN NOT list_contains(acc, x[1]) THEN x[1]
  ELSE list_filter(list_transform(range(2, len(acc) + 3), lambda k: concat(x[1], '_', k)), lambda c: NOT list_contains(acc, c))[1] END])) AS ns FROM xs)
SELECT doc_id, unnest(ds) AS ord, unnest(ns) AS name FROM f"""
query("unique_names", duck(_NAMES, "v_det"))(lambda s, d: ordered.unique_names(V.det(s, d).select("doc_id", F.col("di").alias("ord"), X.slug(F.col("label")).alias("base"))))

# Labels against the page's words: words of documents, with a gutter after every fourth, and labels made of two words of a line or of two lines

_SPREAD = "SELECT doc_id, page, line_no, word_ix, text, x0 + 40 * CAST(floor(word_ix / 4) AS BIGINT) AS x0, x1 + 40 * CAST(floor(word_ix / 4) AS BIGINT) AS x1, top, bottom FROM {words} WHERE text <> ''"
_LABELS = """SELECT a.doc_id, a.page, a.line_no AS di, 'text' AS type, concat('R', a.line_no % 4) AS rule,
  concat(CASE WHEN a.k = 4 THEN 'zz' ELSE '' END, a.text, ' ', CASE WHEN a.k = 2 THEN substr(b.text, 1, greatest(1, CAST(floor(length(b.text) / 2) AS INT))) ELSE b.text END) AS label,
  a.x0, a.x1, 718 - a.bottom AS y0, 730 - a.bottom AS y1
FROM (SELECT *, (doc_id + line_no) % 5 AS k FROM {spread} WHERE line_no % 3 = 0) a JOIN {spread} b ON a.doc_id = b.doc_id AND a.page = b.page
WHERE a.word_ix = CASE a.k WHEN 1 THEN 3 WHEN 3 THEN 0 ELSE 1 END AND b.word_ix = CASE a.k WHEN 1 THEN 4 WHEN 3 THEN 0 ELSE 2 END AND b.line_no = a.line_no + CASE WHEN a.k = 3 THEN 1 ELSE 0 END"""


# the same labels by anchor line, each word with the line and the side (a or b) for which it may stand, so that no word has to meet all others of its page
_ENDS = """SELECT doc_id, page, line, k, CASE WHEN side = 'a' THEN w END AS a, CASE WHEN side = 'b' THEN w END AS b FROM (
  SELECT *, CASE WHEN k = 3 AND line < line_no THEN 'b' WHEN word_ix = CASE k WHEN 1 THEN 3 WHEN 3 THEN 0 ELSE 1 END THEN 'a' ELSE 'b' END AS side, named_struct('text', text, 'x0', x0, 'x1', x1, 'bottom', bottom) AS w
  FROM (SELECT *, line_no - line_no % 3 AS line, (doc_id + line_no - line_no % 3) % 5 AS k FROM {spread} WHERE line_no % 3 < 2) q
  WHERE CASE WHEN k = 3 THEN word_ix = 0 WHEN line < line_no THEN false WHEN k = 1 THEN word_ix IN (3, 4) ELSE word_ix IN (1, 2) END) r"""
_JOINED = """SELECT doc_id, page, line AS di, 'text' AS type, concat('R', line % 4) AS rule,
  concat(CASE WHEN k = 4 THEN 'zz' ELSE '' END, a.text, ' ', CASE WHEN k = 2 THEN substr(b.text, 1, greatest(1, CAST(floor(length(b.text) / 2) AS INT))) ELSE b.text END) AS label,
  a.x0, a.x1, 718 - a.bottom AS y0, 730 - a.bottom AS y1 FROM {ends}"""


def labelled_words(s, d):
    """fields, words and pages of documents read as pages 720 high."""
    spread = s.sql(_SPREAD, words=V.words(s, d, V.dealt_documents(s, d)))
    ends = s.sql(_ENDS, spread=spread).groupBy("doc_id", "page", "line", "k").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    ends = ends.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
    return s.sql(_JOINED, ends=ends), spread, spread.select("doc_id", "page").distinct().withColumn("height", F.lit(720.0))


_PLAIN = "regexp_replace(lower({}), '[^a-z0-9'']', '', 'g')"
_BLANK = "({0} IN (chr(61539), chr(61551)) OR contains({0}, '___') OR regexp_full_match({0}, '[.·․ ]*'))"


def _search(words: str, fields: str, name: str) -> str:
    """The spans of fields' labels in words numbered by o for each field: the exact ones, or else those whose last word is begun, the nearest first."""
    return f"""hit_{name} AS (SELECT t.*, w.o - t.j + 1 AS s, w.norm = t.t AS same FROM {fields} t JOIN {words} w ON w.doc_id = t.doc_id AND w.page = t.page AND (w.di IS NULL OR w.di = t.di)
  WHERE w.norm = t.t OR (t.j = t.n AND t.t <> '' AND starts_with(w.norm, t.t))),
run_{name} AS (SELECT doc_id, page, di, n, cx, cy, s, bool_and(same) AS exact FROM hit_{name} GROUP BY ALL HAVING count(*) = n),
far_{name} AS (SELECT r.doc_id, r.page, r.di, r.n, r.s, r.exact, sqrt(pow(sum(w.x0 + w.x1) / (2.0 * r.n) - r.cx, 2) + pow(sum(w.top + w.bottom) / (2.0 * r.n) - r.cy, 2)) AS far
  FROM run_{name} r JOIN {words} w ON w.doc_id = r.doc_id AND w.page = r.page AND (w.di IS NULL OR w.di = r.di) AND w.o BETWEEN r.s AND r.s + r.n - 1 GROUP BY r.doc_id, r.page, r.di, r.n, r.s, r.exact, r.cx, r.cy),
at_{name} AS (SELECT * FROM far_{name} QUALIFY row_number() OVER (PARTITION BY doc_id, page, di ORDER BY exact DESC, far, s) = 1),
gap_{name} AS (SELECT DISTINCT a.doc_id, a.page, a.di FROM at_{name} a JOIN {words} p ON p.doc_id = a.doc_id AND p.page = a.page AND (p.di IS NULL OR p.di = a.di) AND p.o BETWEEN a.s AND a.s + a.n - 2
  JOIN {words} q ON q.doc_id = a.doc_id AND q.page = a.page AND (q.di IS NULL OR q.di = a.di) AND q.o = p.o + 1 JOIN lim l ON l.doc_id = a.doc_id AND l.page = a.page
  WHERE NOT p.blank AND NOT q.blank AND p.top = q.top AND q.x0 - p.x1 > l.threshold)"""


_SIGNALS = f""", v_spread AS ({_SPREAD.replace('{words}', 'v_words')}), v_lab AS ({_LABELS.replace('{spread}', 'v_spread')}),
nw AS (SELECT *, NULL::BIGINT AS di, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, word_ix) AS o, {_PLAIN.format('text')} AS norm, {_BLANK.format('text')} AS blank FROM v_spread),
lim AS (SELECT doc_id, page, greatest(10.0, least(30.0, 3 * coalesce(median(CASE WHEN g > 0.1 THEN g END), 3.0))) AS threshold
  FROM (SELECT doc_id, page, x0 - lag(x1) OVER (PARTITION BY doc_id, page, top ORDER BY x0, word_ix) AS g FROM v_spread) q GROUP BY ALL),
tk AS (SELECT *, list_transform(list_filter(string_split(label, ' '), lambda x: x <> ''), lambda x: {_PLAIN.format('x')}) AS ts FROM v_lab),
tok AS (SELECT doc_id, page, di, rule, x0, x1, (x0 + x1) / 2.0 AS cx, 720.0 - (y0 + y1) / 2.0 AS cy, unnest(ts) AS t, generate_subscripts(ts, 1) AS j, len(ts) AS n FROM tk),
{_search('nw', 'tok', 'page')},
lost AS (SELECT * FROM tok t WHERE NOT EXISTS (SELECT 1 FROM at_page a WHERE a.doc_id = t.doc_id AND a.page = t.page AND a.di = t.di)),
bw AS (SELECT w.* EXCLUDE (di, o), f.di, row_number() OVER (PARTITION BY f.doc_id, f.page, f.di ORDER BY w.top, w.x0, w.word_ix) AS o FROM (SELECT DISTINCT doc_id, page, di, x0, x1 FROM lost) f
  JOIN nw w ON w.doc_id = f.doc_id AND w.page = f.page AND (w.x0 + w.x1) / 2.0 BETWEEN f.x0 - 30 AND f.x1 + 30),
{_search('bw', 'lost', 'band')},
cut_left AS (SELECT a.doc_id, a.page, a.di FROM at_page a JOIN nw p ON p.doc_id = a.doc_id AND p.page = a.page AND p.o = a.s - 1 JOIN nw q ON q.doc_id = a.doc_id AND q.page = a.page AND q.o = a.s
  JOIN lim l ON l.doc_id = a.doc_id AND l.page = a.page WHERE p.top = q.top AND NOT p.blank AND q.x0 - p.x1 BETWEEN 0 AND l.threshold),
cut_right AS (SELECT a.doc_id, a.page, a.di FROM at_page a JOIN nw p ON p.doc_id = a.doc_id AND p.page = a.page AND p.o = a.s + a.n - 1 JOIN nw q ON q.doc_id = a.doc_id AND q.page = a.page AND q.o = a.s + a.n
  JOIN lim l ON l.doc_id = a.doc_id AND l.page = a.page WHERE p.top = q.top AND NOT q.blank AND q.x0 - p.x1 BETWEEN 0 AND l.threshold),
marks AS (SELECT f.doc_id, f.page, f.di, f.rule, f.label,
  CASE WHEN NOT EXISTS (SELECT 1 FROM at_page a WHERE (a.doc_id, a.page, a.di) = (f.doc_id, f.page, f.di)) AND NOT EXISTS (SELECT 1 FROM at_band a WHERE (a.doc_id, a.page, a.di) = (f.doc_id, f.page, f.di)) THEN 1 ELSE 0 END AS not_found_on_page,
  CASE WHEN (f.doc_id, f.page, f.di) IN (SELECT (doc_id, page, di) FROM gap_page UNION ALL SELECT (doc_id, page, di) FROM gap_band) THEN 1 ELSE 0 END AS internal_gap,
  CASE WHEN (f.doc_id, f.page, f.di) IN (SELECT (doc_id, page, di) FROM cut_left) THEN 1 ELSE 0 END AS truncated_left,
  CASE WHEN (f.doc_id, f.page, f.di) IN (SELECT (doc_id, page, di) FROM cut_right) THEN 1 ELSE 0 END AS truncated_right FROM v_lab f),
sig AS (SELECT *, not_found_on_page + internal_gap + truncated_left + truncated_right AS k FROM marks)"""
_REASONS = "concat_ws(',', " + ", ".join(f"CASE WHEN {g} = 1 THEN '{g}' END" for g in guards.SIGNALS) + ") AS reasons"


def _signals(s, d):
    return guards.label_signals(*labelled_words(s, d))


query("label_signals", duck(_SIGNALS + f" SELECT doc_id, page, di, rule, label, {_REASONS} FROM sig", "v_words"))(lambda s, d: _signals(s, d).withColumn("reasons", F.array_join("reasons", ",")))
_RATES = "count(*) AS total, count(*) FILTER (k > 0) AS flagged, " + ", ".join(f"CAST(sum({g}) AS BIGINT) AS {g}" for g in guards.SIGNALS) + ", CAST(count(*) FILTER (k > 0) AS DOUBLE) / count(*) AS fraction"
query("label_plausibility", duck(_SIGNALS + f" SELECT rule, {_RATES} FROM sig GROUP BY rule", "v_words"))(lambda s, d: guards.label_plausibility(_signals(s, d), "rule"))
query("worst_labels", duck(_SIGNALS + f" SELECT doc_id, page, di, rule, label, {_REASONS} FROM sig WHERE k > 0 ORDER BY k DESC, doc_id, page, di LIMIT 40", "v_words"))(lambda s, d: guards.worst_labels(_signals(s, d)).withColumn("reasons", F.array_join("reasons", ",")))
_REPEATS = f", n AS (SELECT doc_id, page, {_PLAIN.format('label')} AS norm, count(*) AS c FROM v_det GROUP BY ALL)"
query("label_repeats", duck(_REPEATS + " SELECT * FROM n WHERE c > 1 ORDER BY c DESC, doc_id, page, norm LIMIT 15", "v_det"))(lambda s, d: guards.most_repeated(guards.page_repeats(V.det(s, d))))

_POOLED = f"""SELECT 'box_over_ink' AS guard, CAST(count(*) FILTER (offender) AS DOUBLE) / count(*) AS value FROM ({catalog.ORACLE['box_over_ink']}) q
UNION ALL SELECT 'glyph_coverage', CAST(sum(round(coverage * glyph_count)) AS DOUBLE) / sum(glyph_count) FROM ({catalog.ORACLE['glyph_coverage']}) q
UNION ALL SELECT 'stacked_fraction', round(avg(stacked_fraction), 9) FROM ({catalog.ORACLE['whitespace_fit']}) q
UNION ALL SELECT 'label_plausibility', CAST(sum(flagged) AS DOUBLE) / sum(total) FROM ({catalog.ORACLE['label_plausibility']}) q
UNION ALL SELECT 'label_duplication', CAST(sum(duplicated) AS DOUBLE) / sum(total) FROM ({catalog.ORACLE['label_duplication']}) q"""


@query("guards_pooled", _POOLED)
def guards_pooled(s, d):
    ink, glyphs, fit, repeats = (catalog.QUERIES[n](s, d) for n in ("box_over_ink", "glyph_coverage", "whitespace_fit", "label_duplication"))
    pooled = guards.pooled_guards(ink, glyphs, fit, _signals(s, d), repeats)
    return pooled.withColumn("value", F.when(F.col("guard") == "stacked_fraction", F.round("value", 9)).otherwise(F.col("value")))


# The gate: rows of the tuning split as the candidate, those of the holdout split as the baseline

_SIDES = """SELECT CASE split WHEN 'tuning' THEN 'candidate' ELSE 'baseline' END AS run"""


def gate_inputs(s, d):
    """runs, failures, guards and offenders of two pseudo runs."""
    m = metrics.measures(V.order_sides(s, d), None, ["split", "family"]).withColumn("run", F.when(F.col("split") == "tuning", "candidate").otherwise("baseline"))
    # one pass: a family is a part of the whole, and one of them stands for the holdout
    sums = written(m.groupBy("run", "family").agg(*[F.sum(k).alias(k) for k in metrics.MEASURES]), "gate-families")
    part = lambda df, scope, *keys: metrics.by(df, "run", *keys).select("run", F.lit(scope).alias("scope"), (F.col(keys[0]) if keys else F.lit("")).alias("key"), "truth", "f1", "precision", "label_accuracy")
    runs = part(sums, "overall").unionByName(part(sums.where("family = 'fam0'"), "holdout")).unionByName(part(sums, "family", "family"))
    o = V.table(s, d, "orders")
    failures = o.where("o_orderstatus IN ('F', 'P')").select(F.when(F.col("o_orderkey") % 3 == 0, "baseline").otherwise("candidate").alias("run"), F.concat(F.lit("c"), F.col("o_custkey")).alias("form"), F.when(F.col("o_orderstatus") == "F", "crash").otherwise("rejected").alias("reason"))
    ink = catalog.QUERIES["box_over_ink"](s, d).select(F.when(F.col("doc_id") % 3 == 0, "baseline").otherwise("candidate").alias("run"), "doc_id", "di", "offender")
    # written once: the shares and the offenders of both runs read it
    ink = written(ink, "gate-ink")
    values = ink.groupBy("run").agg((F.sum(F.col("offender").cast("int")).cast("double") / F.count("*")).alias("value"))
    glyphs = catalog.covered_glyphs(s, d).groupBy(F.when(F.col("doc_id") % 3 == 0, "baseline").otherwise("candidate").alias("run")).agg((F.sum(F.round(F.col("coverage") * F.col("glyph_count"))) / F.sum("glyph_count")).alias("value"))
    told = values.select("run", F.lit("box_over_ink").alias("guard"), "value").unionByName(glyphs.select("run", F.lit("glyph_coverage").alias("guard"), "value"))
    offenders = ink.where("offender").select("run", F.lit("box_over_ink").alias("guard"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 3)).alias("form"), F.col("di").cast("string").alias("id"))
    return runs, failures, told, offenders


_GATE = catalog._MEASURES + f""", r AS (SELECT *, CASE split WHEN 'tuning' THEN 'c' ELSE 'b' END AS run FROM ms),
b AS (SELECT run, 'overall' AS scope, '' AS key, {catalog._SUMS} FROM r GROUP BY run UNION ALL SELECT run, 'holdout', '', {catalog._SUMS} FROM r WHERE family = 'fam0' GROUP BY run UNION ALL SELECT run, 'family', family, {catalog._SUMS} FROM r GROUP BY run, family)""" + catalog._FINAL.replace("SELECT *, CASE WHEN precision + recall", ", z AS (SELECT *, CASE WHEN precision + recall").replace("FROM f", "FROM f)").replace("FROM b)\n", "FROM b)") + f""",
p AS (SELECT b.scope, b.key, b.truth AS bt, b.f1 AS bf, b.precision AS bp, b.label_accuracy AS bl, coalesce(c.truth, 0) AS ct, coalesce(c.f1, 0) AS cf, coalesce(c.precision, 0) AS cp, c.label_accuracy AS cl
  FROM (SELECT * FROM z WHERE run = 'b') b LEFT JOIN (SELECT * FROM z WHERE run = 'c') c ON b.scope = c.scope AND b.key = c.key),
ink AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'c' END AS run, concat('f', doc_id // 3) AS form, di, offender FROM ({catalog.ORACLE['box_over_ink']}) q),
boi AS (SELECT CAST(count(*) FILTER (run = 'c' AND offender) AS DOUBLE) / count(*) FILTER (run = 'c') - CAST(count(*) FILTER (run = 'b' AND offender) AS DOUBLE) / count(*) FILTER (run = 'b') AS rise,
  (SELECT count(*) FROM (SELECT form, di FROM ink WHERE run = 'c' AND offender EXCEPT SELECT form, di FROM ink WHERE run = 'b' AND offender) n) AS fresh FROM ink),
gly AS (SELECT sum(round(coverage * glyph_count)) / sum(glyph_count) AS v FROM ({catalog.ORACLE['glyph_coverage']}) q WHERE doc_id % 3 <> 0),
found AS (SELECT 1 AS ord, 'fail' AS level, 'overall_f1' AS "check", '' AS key FROM p WHERE scope = 'overall' AND cf - bf < -0.002
  UNION ALL SELECT 2, CASE WHEN bt = 0 OR ct = 0 THEN 'warn' ELSE 'fail' END, 'holdout_f1', '' FROM p WHERE scope = 'holdout' AND (bt = 0 OR ct = 0 OR cf - bf < -0.002)
  UNION ALL SELECT 3, CASE WHEN bl IS NULL OR cl IS NULL THEN 'warn' ELSE 'fail' END, 'label_accuracy', '' FROM p WHERE scope = 'overall' AND (bl IS NULL OR cl IS NULL OR cl - bl < -0.02)
  UNION ALL SELECT 4, 'fail', 'family_f1', key FROM p WHERE scope = 'family' AND bt > 0 AND cf - bf < -0.02
  UNION ALL SELECT DISTINCT 5, 'fail', 'new_failure', concat('c', o_custkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0)
  UNION ALL SELECT 6, 'fail', 'precision', '' FROM p WHERE scope = 'overall' AND cp - bp < -1e-9
  UNION ALL SELECT 7, 'fail', 'glyph_coverage', '' FROM gly WHERE v < 0.98
  UNION ALL SELECT 8, CASE WHEN fresh > 0 THEN 'fail' ELSE 'warn' END, 'box_over_ink', '' FROM boi WHERE rise > 0.01)"""
query("gate_checks", duck(_GATE + ' SELECT ord, level, "check", key FROM found', "v_truth", "v_det"))(lambda s, d: gate.reasons(*gate_inputs(s, d)))
_VERDICT = " SELECT count(*) FILTER (level = 'fail') = 0 AS passed, coalesce(list(concat(\"check\", CASE WHEN key = '' THEN '' ELSE concat(':', key) END) ORDER BY ord, key) FILTER (level = 'fail'), []) AS fails, coalesce(list(\"check\" ORDER BY ord, key) FILTER (level = 'warn'), []) AS warns FROM found"
query("gate_verdict", duck(_GATE + _VERDICT, "v_truth", "v_det"))(lambda s, d: gate.verdict(gate.reasons(*gate_inputs(s, d))))

# The crawl: events as a list of addresses and the answers to them

_URLS = """SELECT event_id AS ord, concat('h', CAST(user_id % 40 AS {str})) AS host, concat('h', CAST(user_id % 40 AS {str}), '/', CAST(event_id % 53 AS {str})) AS url, concat('/', CAST(event_id % 53 AS {str})) AS path,
  CASE WHEN event_id % 397 = 5 THEN 403 WHEN event_id % 23 = 0 THEN 404 ELSE 200 END AS status, concat('s', CAST((user_id % 20) * 53 + event_id % 53 AS {str})) AS sha FROM {events}"""
_CRAWL = f"""WITH u AS ({_URLS.replace('{str}', 'VARCHAR').replace('{events}', 'events')}), a AS (SELECT *, starts_with(path, '/4') AND host IN ('h1', 'h2') AS forbidden FROM u),
first_ok AS (SELECT url, min(ord) AS at FROM a WHERE status = 200 AND NOT forbidden GROUP BY url),
block AS (SELECT a.host, min(a.ord) AS at FROM a LEFT JOIN first_ok f ON f.url = a.url AND f.at < a.ord WHERE a.status IN (403, 429) AND NOT forbidden AND f.url IS NULL GROUP BY a.host),
got AS (SELECT a.* FROM a LEFT JOIN block b ON b.host = a.host AND b.at < a.ord WHERE b.host IS NULL AND status = 200 AND NOT forbidden),
kept AS (SELECT sha, min(ord) AS ord, arg_min(url, ord) AS url FROM got GROUP BY sha),
last AS (SELECT max(ord) AS at, count(*) AS n FROM (SELECT ord FROM kept ORDER BY ord LIMIT 500) q)
SELECT a.ord, CASE WHEN l.n >= 500 AND a.ord > l.at THEN 'limit' WHEN EXISTS (SELECT 1 FROM kept k WHERE k.url = a.url AND k.ord < a.ord) THEN 'known' WHEN b.host IS NOT NULL THEN 'blocked' WHEN forbidden THEN 'robots'
  WHEN status IN (403, 429) THEN 'refused' WHEN status <> 200 THEN 'failed' WHEN k.ord < a.ord THEN 'duplicate' ELSE 'fetch' END AS decision
FROM a LEFT JOIN block b ON b.host = a.host AND b.at < a.ord LEFT JOIN kept k ON k.sha = a.sha, last l"""


@query("fetch_plan", _CRAWL)
def fetch_plan(s, d):
    rows = s.sql(_URLS.replace("{str}", "STRING"), events=V.table(s, d, "events"))
    robots = s.createDataFrame([("h1", "/4"), ("h2", "/4")], "host string, prefix string")
    return crawl.decisions(rows, robots, limit=500)
