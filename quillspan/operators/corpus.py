"""The corpus of documents: what kind each one is, which of its widgets make truth, how a run over unlabelled documents went, and the plan of a filled form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import CHECK_GLYPHS, fixed
from quillspan.operators.ordered import PAGE, named_rows

# Limits of a document, and what tells its kind.
MOST_BYTES, MOST_PAGES, SCAN_CHARS, RULED = 20 << 20, 30, 50, 20
PAGE_CHARS, IMAGE_SHARE = 20, 0.5
MARKS = (*CHECK_GLYPHS, "_", ".", "·", "․")
LEAST_SIDE, LEAST_WIDGETS, REACH = 4.0, 5, 6
MOST_FIELDS = 50_000
FIELD_TYPES = {"/Tx": "text", "/Btn": "checkbox", "/Ch": "choice"}
CLEAN_REJECTIONS = (
    "PdfminerException", "PDFSyntaxError", "PDFEncryptionError", "PDFPasswordIncorrect", "PDFTextExtractionNotAllowed",
    "PdfReadError", "PdfStreamError", "ValueError", "EOFError",
)


def thin(height: str = "height", width: str = "width") -> tuple[Column, Column]:
    """Whether a rect is a vertical stroke, and whether it is a horizontal one."""
    h, w = F.col(height), F.col(width)
    return (w < 3) & (h >= 5), (h < 3) & (w >= 5)


def page_facts(chars: DataFrame, rects: DataFrame) -> DataFrame:
    """doc_id, chars, glyphs, underscores, thin_v, thin_h: sums over a document's pages, 0 where it has none of a kind."""
    v, h = thin()
    c = chars.groupBy("doc_id").agg(F.count("*").alias("chars"), F.count_if(F.col("text").isin(*CHECK_GLYPHS)).alias("glyphs"), F.count_if(F.col("text") == "_").alias("underscores"))
    r = rects.groupBy("doc_id").agg(F.count_if(v).alias("thin_v"), F.count_if(h).alias("thin_h"))
    return c.join(r, "doc_id", "full").na.fill(0, ["chars", "glyphs", "underscores", "thin_v", "thin_h"])


def common_fonts(chars: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, fonts: the most frequent ones, ties by name."""
    n = chars.where("font IS NOT NULL").groupBy("doc_id", "font").agg(F.count("*").alias("n"))
    ranked = n.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "font"))).where(F.col("k") <= most)
    return ranked.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "font"))), lambda x: x["font"]).alias("fonts"))


def classify(facts: DataFrame) -> DataFrame:
    """Adds verdict and reason. facts: bytes (null: can't be read), locked, pages, malformed (a message or null), has_acroform, producer, creator, chars, thin_v, thin_h.

    The first that holds decides: what makes a document unusable, then few characters a page, then form fields, then ruled lines.
    """
    signature = F.lower(F.concat_ws(" ", F.coalesce("producer", F.lit("")), F.coalesce("creator", F.lit(""))))
    unusable = [
        (F.col("bytes").isNull(), F.lit("unreadable")),
        (F.col("bytes") == 0, F.lit("empty file")),
        (F.col("bytes") > MOST_BYTES, F.lit("too large")),
        (F.coalesce("locked", F.lit(False)), F.lit("encrypted")),
        (F.coalesce("pages", F.lit(0)) == 0, F.lit("zero pages")),
        (F.col("pages") > MOST_PAGES, F.format_string("over %d pages (%d)", F.lit(MOST_PAGES), F.col("pages").cast("int"))),
        (F.col("malformed").isNotNull(), F.concat(F.lit("malformed: "), F.col("malformed"))),
    ]
    per_page = F.try_divide(F.col("chars").cast("double"), F.col("pages"))
    reason = F.when(*unusable[0])
    for test, text in unusable[1:]:
        reason = reason.when(test, text)
    few = F.coalesce(per_page, F.lit(0.0)) < SCAN_CHARS
    out = facts.withColumn("reason", reason)
    verdict = (
        F.when(F.col("reason").isNotNull(), "unusable")
        .when(few, "scan")
        .when(F.col("has_acroform") & signature.rlike("designer|livecycle"), "fillable-livecycle")
        .when(F.col("has_acroform"), "fillable-other")
        .when((F.col("thin_h") > RULED) & (F.col("thin_v") > RULED), "flat-wordlike")
        .otherwise("flat-sparse")
    )
    out = out.withColumn("verdict", verdict)
    return out.withColumn("reason", F.when(F.col("verdict") == "scan", F.concat(fixed(F.coalesce(per_page, F.lit(0.0)), 1), F.lit(" characters a page"))).otherwise(F.col("reason")))


def scanned_pages(chars: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, scanned: under 20 characters that aren't white space, and an image over half of the page; a page without area is none."""
    n = chars.where(F.col("text").rlike(r"(?U)\S")).groupBy(*PAGE).agg(F.count("*").alias("n"))
    i = images.groupBy(*PAGE).agg(F.max(F.col("width") * F.col("height")).alias("image"))
    area = F.col("width") * F.col("height")
    scanned = (F.coalesce("n", F.lit(0)) < PAGE_CHARS) & (area > 0) & (F.coalesce("image", F.lit(0.0)) >= IMAGE_SHARE * area)
    return pages.join(n, PAGE, "left").join(i, PAGE, "left").select(*PAGE, scanned.alias("scanned"))


def widgets_of(annots: DataFrame) -> DataFrame:
    """annots (doc_id, page, ix, subtype, flags, field_flags, ft, parent_ft, rect) -> doc_id, page, ix, type, x0, y0, x1, y1.

    Widgets that aren't read-only (field flag 1) or hidden (flag 2), with sides of four points or more; an unknown kind of field is text.
    """
    r = [F.get("rect", F.lit(i)) for i in range(4)]
    box = annots.where("subtype = '/Widget' AND size(rect) = 4").where((F.coalesce("field_flags", F.lit(0)).bitwiseAND(1) == 0) & (F.coalesce("flags", F.lit(0)).bitwiseAND(2) == 0))
    kinds = F.create_map(*[F.lit(x) for kv in FIELD_TYPES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(kinds, F.coalesce("ft", "parent_ft", F.lit(""))), F.lit("text"))
    out = box.select(*PAGE, "ix", kind.alias("type"), F.least(r[0], r[2]).alias("x0"), F.least(r[1], r[3]).alias("y0"), F.greatest(r[0], r[2]).alias("x1"), F.greatest(r[1], r[3]).alias("y1"))
    return out.where(f"x1 - x0 >= {LEAST_SIDE} AND y1 - y0 >= {LEAST_SIDE}")


def keep_reachable(widgets: DataFrame, rects: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """Widgets with a stroke or a mark (check glyph, underscore, leader dot) of their page within six points: others stand over nothing that a rule could read."""
    v, h = thin()
    box = ["x0", "x1", "top", "bottom"]
    things = rects.where(v | h).select(*PAGE, *box).unionByName(chars.where(F.col("text").isin(*MARKS)).select(*PAGE, *box)).alias("o")
    w = widgets.join(pages.select(*PAGE, F.col("height").alias("_h")), PAGE).alias("w")
    top, bottom = F.col("w._h") - F.col("w.y1"), F.col("w._h") - F.col("w.y0")
    near = (F.col("o.x1") >= F.col("w.x0") - REACH) & (F.col("o.x0") <= F.col("w.x1") + REACH) & (F.col("o.bottom") >= top - REACH) & (F.col("o.top") <= bottom + REACH)
    return w.join(things, (F.col("w.doc_id") == F.col("o.doc_id")) & (F.col("w.page") == F.col("o.page")) & near, "left_semi").drop("_h")


def admitted(rows: DataFrame, least: int = LEAST_WIDGETS) -> DataFrame:
    """Rows of documents that have at least so many."""
    return rows.join(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("doc_id"), "doc_id", "left_semi")


def truth_widgets(annots: DataFrame, rects: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """The truth of documents that fill-in widgets tell: admitted by their widgets, then again by those within reach."""
    return admitted(keep_reachable(admitted(widgets_of(annots)), rects, chars, pages))


def structured(glyphs: str = "glyphs", underscores: str = "underscores", thin_h: str = "thin_h", thin_v: str = "thin_v") -> Column:
    """Whether a document shows signs of a form; one of which nothing is known counts as one."""
    return F.coalesce((F.col(glyphs) >= 1) | (F.col(underscores) >= 3) | (F.col(thin_h) >= 10) | (F.col(thin_v) >= 10), F.lit(True))


def flat_documents(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose verdict is flat-wordlike or flat-sparse; all files where the manifest names none."""
    flat = manifest.where("verdict IN ('flat-wordlike', 'flat-sparse')").select("file").distinct()
    chosen = files.join(flat, "file", "left_semi")
    any_ = flat.agg(F.count("*").alias("n"))
    # one row
    return chosen.unionByName(files.join(F.broadcast(any_)).where("n = 0").drop("n"))


def probes(results: DataFrame, facts: DataFrame) -> DataFrame:
    """results (doc_id, error, fields, pages, label_plausibility, box_over_ink, stacked_fraction) and facts -> with crashed, structured, fields_per_page, suspicion.

    Crashes come first, then structured documents without a field, then by the guards; prose without a field comes last.
    """
    p = results.join(facts.select("doc_id", "glyphs", "underscores", "thin_h", "thin_v"), "doc_id", "left").withColumn("structured", structured()).withColumn("crashed", F.col("error").isNotNull())
    p = p.withColumn("fields_per_page", F.coalesce(F.try_divide(F.col("fields").cast("double"), F.col("pages")), F.lit(0.0)))
    guard = lambda c, weight: F.coalesce(F.col(c), F.lit(0.0)) * weight
    density = F.when(F.col("fields_per_page") > 0, 1 / F.col("fields_per_page")).otherwise(5.0)
    none = F.coalesce("fields", F.lit(0)) == 0
    score = F.when(F.col("crashed"), 1e9).when(none & F.col("structured"), 1e8).when(none, -1.0).otherwise(guard("label_plausibility", 100) + guard("box_over_ink", 50) + guard("stacked_fraction", 20) + density)
    return p.withColumn("suspicion", score).drop("glyphs", "underscores", "thin_h", "thin_v")


def most_suspect(p: DataFrame, most: int) -> DataFrame:
    return p.orderBy(F.desc("suspicion"), "doc_id").limit(most)


def blind_summary(p: DataFrame) -> DataFrame:
    """probed, crashed, structured_zero, prose_zero: one row."""
    zero = ~F.col("crashed") & (F.coalesce("fields", F.lit(0)) == 0)
    return p.agg(F.count("*").alias("probed"), F.count_if("crashed").alias("crashed"), F.count_if(zero & F.col("structured")).alias("structured_zero"), F.count_if(zero & ~F.col("structured")).alias("prose_zero"))


def outcomes(runs: DataFrame) -> DataFrame:
    """runs (name, exception, signal, exit_code, bad_schema, numbers, pages, expected_pages, fields) -> name, status, suspicious.

    numbers holds all numbers of a result. A result that breaks the contract is a crash; a known parser's exception is a clean rejection, any other a crash; a
    signal for processor time is a timeout, one for memory tells of memory. A run without result, exception or signal is a crash.
    """
    kind = F.element_at(F.split(F.element_at(F.split("exception", ":"), 1), r"\."), -1)
    finite = F.forall("numbers", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    result = F.col("numbers").isNotNull()
    status = (
        F.when(F.col("exception").isNotNull(), F.when(kind.isin(*CLEAN_REJECTIONS), "rejected").otherwise("crash"))
        .when(F.col("signal") == "SIGXCPU", "timeout")
        .when(F.col("signal").isin("SIGKILL", "SIGSEGV"), "memory")
        .when(F.coalesce(result & ~F.coalesce("bad_schema", F.lit(False)) & finite, F.lit(False)), "ok")
        .otherwise("crash")
    )
    odd = (F.coalesce("pages", F.lit(0)) != F.coalesce("expected_pages", "pages", F.lit(0))) | (F.coalesce("fields", F.lit(0)) > MOST_FIELDS)
    return runs.withColumn("status", status).select("name", "status", ((F.col("status") == "ok") & odd).alias("suspicious"))


def feature_share(tags: DataFrame) -> DataFrame:
    """tags (doc_id, tag) -> tag, share: the share of all documents that have it."""
    forms = tags.agg(F.countDistinct("doc_id").alias("forms"))
    # one row
    return tags.groupBy("tag").agg(F.countDistinct("doc_id").alias("n")).join(F.broadcast(forms)).select("tag", (F.col("n").cast("double") / F.col("forms")).alias("share"))


def widget_plan(fields: DataFrame) -> DataFrame:
    """fields (doc_id, ord, page, id, type, group, x0, y0, x1, y1) -> what a writer of fillable forms draws: name, kind, radio (its group's name), box, font size.

    Names are made unique in order; check boxes of a group are options of one radio group, which is named when its first box is met. A box is six points wide and
    high at least; text is 0.62 of its height, 8 to 12.
    """
    group = F.when((F.col("type") == "checkbox") & (F.coalesce("group", F.lit("")) != ""), F.col("group"))
    base = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("field"))
    first = F.min("ord").over(Window.partitionBy("doc_id", "group"))
    f = fields.withColumn("group", group).withColumn("first", F.when(F.col("group").isNotNull(), first))
    # fields and the groups they open, in one list a document: all that follows runs within its row, and nothing has to be dealt out by name, order or group again
    own = F.struct((2 * F.col("ord")).alias("ord"), base("id").alias("base"), F.lit(None).cast("string").alias("opens"), F.struct("ord", "page", "type", "group", "x0", "y0", "x1", "y1").alias("field"))
    opened = F.struct((2 * F.col("ord") + 1).alias("ord"), base("group").alias("base"), F.col("group").alias("opens"), F.lit(None).alias("field"))
    rows = f.select("doc_id", F.explode(F.when(F.col("ord") == F.col("first"), F.array(own, opened)).otherwise(F.array(own))).alias("r")).select("doc_id", "r.*")
    radio = "CASE WHEN z.field.group IS NOT NULL THEN get(filter(rs, r -> r.opens = z.field.group), 0).name END"
    told = f"transform(array(filter(zs, z -> z.opens IS NOT NULL)), rs -> transform(filter(zs, z -> z.field.ord IS NOT NULL), z -> named_struct('name', z.name, 'radio', {radio}, 'field', z.field)))[0]"
    named = named_rows(rows, "opens", "field").where("doc_id IS NOT NULL").select("doc_id", F.expr(told).alias("zs")).select("doc_id", F.inline_outer("zs")).select("doc_id", "name", "radio", "field.*").where("ord IS NOT NULL")
    kind = F.when(F.col("radio").isNotNull(), "radio").when(F.col("type") == "checkbox", "check").otherwise("text")
    high = F.col("y1") - F.col("y0")
    font = F.when(F.col("type") != "checkbox", F.greatest(F.lit(8.0), F.least(F.lit(12.0), high * 0.62)))
    return named.select("doc_id", "ord", "page", "name", kind.alias("kind"), "radio", F.col("x0").alias("x"), F.col("y0").alias("y"), F.greatest(F.lit(6.0), F.col("x1") - F.col("x0")).alias("width"), F.greatest(F.lit(6.0), high).alias("height"), font.alias("font_size"), (F.col("type") == "multiline").alias("multiline"))
