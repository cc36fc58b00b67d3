"""Named queries over the corpus operators, on page objects and facts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import corpus
from quillspan.plans import views as V
from quillspan.plans.catalog import query
from quillspan.plans.views import duck

def both(sql: str, **tables: str) -> str:
    """A view's text with the names of its tables, for the other engine."""
    for k, v in tables.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


# Facts of documents: pages of html stand for files
_FACTS = """SELECT page_id AS doc_id, CASE WHEN page_id % 41 = 7 THEN NULL WHEN page_id % 43 = 8 THEN 0 WHEN page_id % 47 = 9 THEN 30000000 ELSE length(html) END AS bytes, page_id % 31 = 3 AS locked,
  CASE WHEN page_id % 37 = 11 THEN 0 WHEN page_id % 29 = 12 THEN 31 ELSE 1 + page_id % 30 END AS pages, CASE WHEN page_id % 53 = 1 THEN 'bad xref' END AS malformed, page_id % 4 = 0 AS has_acroform,
  CASE page_id % 12 WHEN 0 THEN 'Acme Designer 6' WHEN 4 THEN NULL ELSE 'Writer' END AS producer, CASE WHEN page_id % 24 = 4 THEN 'LiveCycle' END AS creator, length(html) AS chars,
  (length(html) - length(replace(html, '<p', ''))) / 2 * 5 AS thin_v, (length(html) - length(replace(html, '<li', ''))) / 3 * 5 AS thin_h, page_id % 19 AS glyphs, page_id % 7 AS underscores FROM {pages}"""
_JUDGED = f""", q AS (SELECT *, CASE WHEN bytes IS NULL THEN 'unreadable' WHEN bytes = 0 THEN 'empty file' WHEN bytes > 20971520 THEN 'too large' WHEN locked THEN 'encrypted' WHEN pages = 0 THEN 'zero pages'
  WHEN pages > 30 THEN concat('over 30 pages (', pages, ')') WHEN malformed IS NOT NULL THEN concat('malformed: ', malformed) END AS r FROM ({both(_FACTS, pages='pages')}) f),
v AS (SELECT *, CASE WHEN r IS NOT NULL THEN 'unusable' WHEN chars / pages::DOUBLE < 50 THEN 'scan' WHEN has_acroform AND (lower(coalesce(producer, '') || ' ' || coalesce(creator, '')) LIKE '%designer%' OR lower(coalesce(creator, '')) LIKE '%livecycle%') THEN 'fillable-livecycle'
  WHEN has_acroform THEN 'fillable-other' WHEN thin_h > 20 AND thin_v > 20 THEN 'flat-wordlike' ELSE 'flat-sparse' END AS verdict FROM q)"""


def facts(s, d):
    return s.sql(_FACTS, pages=V.table(s, d, "pages"))


def _with(body: str) -> str:
    return "WITH" + body.lstrip()[1:]


query("classify_verdict", _with(_JUDGED) + " SELECT doc_id, verdict, CASE WHEN verdict = 'scan' THEN printf('%.1f characters a page', chars / pages::DOUBLE) ELSE r END AS reason FROM v")(lambda s, d: corpus.classify(facts(s, d)).select("doc_id", "verdict", "reason"))
query("verdict_counts", _with(_JUDGED) + " SELECT verdict, count(*) AS n FROM v GROUP BY verdict")(lambda s, d: corpus.classify(facts(s, d)).groupBy("verdict").agg(F.count("*").alias("n")))

_RESULTS = """SELECT page_id AS doc_id, CASE WHEN page_id % 61 = 2 THEN 'TypeError' END AS error, CASE WHEN page_id % 61 = 2 THEN NULL ELSE page_id % 5 * (page_id % 7) END AS fields, CASE WHEN page_id % 67 = 0 THEN 0 ELSE 1 + page_id % 8 END AS pages,
  (page_id % 11) / 16e0 AS label_plausibility, (page_id % 3) / 8e0 AS box_over_ink, CASE WHEN page_id % 13 = 0 THEN 25e-2 END AS stacked_fraction FROM {pages}"""
_PROBED = f"""WITH f AS ({both(_FACTS, pages='pages')}), p AS (SELECT r.*, f.glyphs >= 1 OR f.underscores >= 3 OR f.thin_h >= 10 OR f.thin_v >= 10 AS structured, error IS NOT NULL AS crashed,
  CASE WHEN r.pages > 0 THEN coalesce(CAST(fields AS DOUBLE) / r.pages, 0) ELSE 0 END AS fields_per_page FROM ({both(_RESULTS, pages='pages')}) r JOIN f ON f.doc_id = r.doc_id),
s AS (SELECT *, CASE WHEN crashed THEN 1e9 WHEN coalesce(fields, 0) = 0 AND structured THEN 1e8 WHEN coalesce(fields, 0) = 0 THEN -1 ELSE label_plausibility * 100 + box_over_ink * 50 + coalesce(stacked_fraction, 0) * 20
  + CASE WHEN fields_per_page > 0 THEN 1 / fields_per_page ELSE 5 END END AS suspicion FROM p)"""


def probed(s, d):
    return corpus.probes(s.sql(_RESULTS, pages=V.table(s, d, "pages")), facts(s, d))


query("blind_rank", _PROBED + " SELECT doc_id, crashed, fields, structured, fields_per_page, suspicion FROM s ORDER BY suspicion DESC, doc_id LIMIT 40")(lambda s, d: corpus.most_suspect(probed(s, d), 40).select("doc_id", "crashed", "fields", "structured", "fields_per_page", "suspicion"))
query("blind_summary", _PROBED + " SELECT count(*) AS probed, count(*) FILTER (crashed) AS crashed, count(*) FILTER (suspicion = 1e8) AS structured_zero, count(*) FILTER (suspicion = -1) AS prose_zero FROM s")(lambda s, d: corpus.blind_summary(probed(s, d)))
query("structured_filter", f"SELECT doc_id, glyphs > 0 OR underscores > 2 OR greatest(thin_h, thin_v) > 9.5 AS structured FROM ({both(_FACTS, pages='pages')}) f")(lambda s, d: facts(s, d).select("doc_id", corpus.structured().alias("structured")))

# Pages of documents: characters are their words' first letters, images a function of the page
_IMAGES = "SELECT DISTINCT doc_id, page, CAST(200 + 100 * (doc_id % 5) AS DOUBLE) AS width, CAST(400 AS DOUBLE) AS height FROM {words} WHERE doc_id % 2 = 0"
_SPOTS = "SELECT doc_id, page, substr(text, 1, 1) AS text FROM {words} WHERE word_ix < 1 + doc_id % 9"


def scanned(s, d):
    words = V.words(s, d)
    pages = words.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(500.0)})
    return corpus.scanned_pages(s.sql(_SPOTS, words=words), s.sql(_IMAGES, words=words), pages)


_SCANNED = f""", n AS (SELECT doc_id, page, count(*) FILTER (trim(text) <> '') AS n FROM ({both(_SPOTS, words='v_words')}) c GROUP BY ALL),
i AS ({both(_IMAGES, words='v_words')}), sc AS (SELECT DISTINCT w.doc_id, w.page, coalesce(n.n, 0) < 20 AND coalesce(i.width * i.height, 0) >= 150000 AS scanned FROM v_words w
  LEFT JOIN n ON n.doc_id = w.doc_id AND n.page = w.page LEFT JOIN i ON i.doc_id = w.doc_id AND i.page = w.page)"""
query("scan_pages", duck(_SCANNED + " SELECT doc_id, page, scanned FROM sc", "v_words"))(scanned)


@query("notice", duck(_SCANNED + """, d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (scanned AND page % 3 <> 1) AS lost, bool_or(scanned AND page % 3 = 1) AS helped FROM sc GROUP BY doc_id)
  SELECT doc_id, CASE WHEN lost / n::DOUBLE >= 0.5 THEN 'scanned' WHEN helped THEN 'ocr_assisted' WHEN doc_id % 4 = 0 THEN 'no_fields' END AS code FROM d""", "v_words"))  # fmt: skip
def notice(s, d):
    from quillspan.operators import detect

    sc = scanned(s, d)
    fields = sc.where("doc_id % 4 <> 0").select("doc_id").distinct()
    return detect.notices(sc.select("doc_id", "page"), fields, sc.where("scanned"), sc.where("scanned AND page % 3 = 1"))


# Annotations: order lines stand for them; strokes and marks are those of the same orders
_ANNOTS = """SELECT o.l_orderkey AS doc_id, 1 AS page, o.l_linenumber AS ix, CASE WHEN l_partkey % 17 = 0 THEN '/Link' ELSE '/Widget' END AS subtype, l_suppkey % 8 AS flags, l_partkey % 4 AS field_flags,
  CASE l_partkey % 5 WHEN 0 THEN '/Tx' WHEN 1 THEN '/Btn' END AS ft, CASE WHEN l_suppkey % 2 = 0 THEN '/Ch' END AS parent_ft,
  CAST(l_partkey % 6 * 40 + l_suppkey % 3 * 20 AS DOUBLE) AS a, CAST(200 - l_suppkey % 6 * 25 AS DOUBLE) AS b, CAST(l_partkey % 6 * 40 AS DOUBLE) AS c, CAST(200 - l_suppkey % 6 * 25 - l_partkey % 30 AS DOUBLE) AS e
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}) o"""
_SIZED = f""", an AS ({both(_ANNOTS, lineitem='lineitem')}), wd AS (SELECT doc_id, page, ix, CASE coalesce(ft, parent_ft) WHEN '/Btn' THEN 'checkbox' WHEN '/Ch' THEN 'choice' ELSE 'text' END AS type, c AS x0, e AS y0, a AS x1, b AS y1 FROM an
  WHERE subtype = '/Widget' AND field_flags IN (0, 2) AND flags IN (0, 1, 4, 5) AND a - c >= 4 AND b - e >= 4),
near AS (SELECT w.* FROM wd w WHERE EXISTS (SELECT 1 FROM v_rects r WHERE r.doc_id = w.doc_id AND r.rect_ix % 3 = 0 AND (r.width < 3 AND r.height >= 5 OR r.height < 3 AND r.width >= 5)
  AND r.x1 + 6 >= w.x0 AND r.x0 - 6 <= w.x1 AND r.bottom + 6 >= 200 - w.y1 AND r.top - 6 <= 200 - w.y0))"""


def annots(s, d):
    return s.sql(_ANNOTS, lineitem=V.table(s, d, "lineitem")).withColumn("rect", F.array("a", "b", "c", "e")).drop("a", "b", "c", "e")


def _marks(s, d):
    rects = V.rects(s, d).where("rect_ix % 3 = 0")
    return rects, rects.where("false").select("doc_id", "page", F.lit("").alias("text"), "x0", "x1", "top", "bottom"), V.rects(s, d).select("doc_id", "page").distinct().withColumn("height", F.lit(200.0))


query("annot_filter", "WITH" + _SIZED.split(", near AS")[0].split("\nnear AS")[0].rstrip(",\n")[1:] + " SELECT * FROM wd")(lambda s, d: corpus.widgets_of(annots(s, d)))
query("keep_reachable", duck(_SIZED + " SELECT * FROM near", "v_rects"))(lambda s, d: corpus.keep_reachable(corpus.widgets_of(annots(s, d)), *_marks(s, d)))


@query("truth_widgets", duck(_SIZED + """ SELECT * FROM near WHERE doc_id IN (SELECT doc_id FROM near GROUP BY doc_id HAVING count(*) >= 2) AND doc_id IN (SELECT doc_id FROM wd GROUP BY doc_id HAVING count(*) >= 2)""", "v_rects"))
def truth_widgets(s, d):
    """Both admissions with two widgets as the least, since an order has few lines."""
    some = corpus.admitted(corpus.widgets_of(annots(s, d)), 2)
    return corpus.admitted(corpus.keep_reachable(some, *_marks(s, d)), 2)


_FORMS = """, w AS (SELECT doc_id, di AS ord, page, label AS id, type, CASE WHEN di % 3 > 0 THEN concat('grp_', di % 2) END AS grp, x0, y0, x1, y1 FROM v_det),
g AS (SELECT *, CASE WHEN type = 'checkbox' THEN grp END AS g, CASE WHEN type = 'checkbox' AND grp IS NOT NULL AND ord = min(CASE WHEN type = 'checkbox' AND grp IS NOT NULL THEN ord END) OVER (PARTITION BY doc_id, grp) THEN grp END AS opens FROM w),
e AS (SELECT doc_id, 2 * ord AS k, coalesce(nullif(trim(id), ''), 'field') AS base FROM g UNION ALL SELECT doc_id, 2 * ord + 1, opens FROM g WHERE opens IS NOT NULL),
xs AS (SELECT doc_id, list(k ORDER BY k) AS ks, list([base] ORDER BY k) AS bs FROM e GROUP BY doc_id),
f AS (SELECT doc_id, ks, list_reduce(bs, lambda acc, x: list_concat(acc, [CASE WHEN NOT list_contains(acc, x[1]) THEN x[1] ELSE list_filter(list_transform(range(2, len(acc) + 3), lambda n: concat(x[1], '_', n)), lambda c: NOT list_contains(acc, c))[1] END])) AS ns FROM xs),
nm AS (SELECT doc_id, unnest(ks) AS k, unnest(ns) AS name FROM f), rd AS (SELECT g.doc_id, g.opens, nm.name FROM g JOIN nm ON nm.doc_id = g.doc_id AND nm.k = 2 * g.ord + 1 WHERE opens IS NOT NULL)
SELECT g.doc_id, g.ord, g.page, nm.name, CASE WHEN g.g IS NOT NULL THEN 'radio' WHEN type = 'checkbox' THEN 'check' ELSE 'text' END AS kind, rd.name AS radio, x0 AS x, y0 AS y,
  CAST(greatest(6, x1 - x0) AS DOUBLE) AS width, CAST(greatest(6, y1 - y0) AS DOUBLE) AS height, CASE WHEN type <> 'checkbox' THEN greatest(8e0, least(12e0, (y1 - y0) * 0.62e0)) END AS font_size, type = 'multiline' AS multiline
FROM g JOIN nm ON nm.doc_id = g.doc_id AND nm.k = 2 * g.ord LEFT JOIN rd ON rd.doc_id = g.doc_id AND rd.opens = g.g"""


@query("widget_plan", duck(_FORMS, "v_det"))
def widget_plan(s, d):
    f = V.det(s, d).select("doc_id", F.col("di").alias("ord"), "page", F.col("label").alias("id"), "type", F.expr("CASE WHEN di % 3 > 0 THEN concat('grp_', di % 2) END").alias("group"), "x0", "y0", "x1", "y1")
    return corpus.widget_plan(f)


query("feature_share", duck(" SELECT rule AS tag, CAST(count(DISTINCT doc_id) AS DOUBLE) / (SELECT count(DISTINCT doc_id) FROM v_truth) AS share FROM v_truth GROUP BY rule", "v_truth"))(lambda s, d: corpus.feature_share(V.truth(s, d).select("doc_id", F.col("rule").alias("tag"))))
