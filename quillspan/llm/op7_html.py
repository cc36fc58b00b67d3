"""Main text of pages by wrapper induction.

Each host has an exemplar, a page of its most frequent layout, and so has each layout of the host; blank pages are none. Every page is aligned with the exemplars
of its host and of its layout by simple tree matching; over the distinct pages of either it is counted how often a text node of the exemplar is met, and met with
the same text. Copies of a page count once, so they never make its text look constant. Nodes that stay constant are template and are dropped from the pages. The
varying text is summed by the exemplar's nodes, text without a partner under the nearest element that has one; the wrapper's content is the innermost container
that holds nine tenths of it. A page's node there is read, if most of its own text lies in it. Where there is no wrapper, or the page doesn't follow it, article and
main elements tell where the text is. Elements and their names that mark menus, adverts and the like are left out in either case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import materialise, released
from quillspan.llm.dom import Node, blocks, content_root, match_trees, parse, prepare, varying

#: Distinct pages that must meet a node, the share of the host's or layout's distinct pages that must, and the share of those with the same text.
MIN_PAGES, MIN_SHARE, CONSTANT = 5, 0.5, 0.9
#: Exemplars up to so many bytes in all are sent to each worker once; beyond that they are joined to the pages by host.
SENT_BYTES = 24 << 20
#: Up to so many pages that have copies are sent to each worker with their numbers of copies; beyond that copies are dropped by a shuffle before pages are counted.
SENT_COPIES = 100_000
#: Pages of one host are of one layout if they have start tags of the same of these elements, with the same classes but for digits.
_LAYOUT = r"(?i)<(?:article|aside|center|div|fieldset|footer|form|header|hgroup|main|menu|nav|section|table)\b[^>]*"
_CLASS = r"(?i)\sclass\s*=\s*[\"']?([^\"'>]*)"


class Exemplar:
    """A page with the numbers of its nodes that are template, and the number of the element that holds the content."""

    def __init__(self, page: str, constant: frozenset[int] = frozenset(), content: int | None = None) -> None:
        self.root = parse(page)
        self.nodes = prepare(self.root)
        self.number = {id(n): i for i, n in enumerate(self.nodes)}
        self.constant, self.content = constant, content

    def pairs(self, root: Node) -> Iterator[tuple[int, bool, Node]]:
        """Nodes of the exemplar that a page meets: number, whether the text is the same, the page's node."""
        for x, y in match_trees(self.root, root):
            yield self.number[id(x)], x.tag == "#text" and " ".join(x.text.split()) == " ".join(y.text.split()), y


def main_text(page: str | None, *exemplars: Exemplar) -> str:
    """The text by the wrappers of the page's groups; the last that has a content element tells where it is."""
    root = parse(page or "")
    template: set[int] = set()
    chosen = None
    known = [e for e in exemplars if e.constant or e.content is not None]
    if known:
        prepare(root)
    for e in known:
        for i, same, node in e.pairs(root):
            if same and i in e.constant:
                template.add(id(node))
            if i == e.content:
                chosen = node
    return "\n\n".join(blocks(root, template, chosen))


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def _layout() -> F.Column:
    tag = lambda t: F.concat_ws(" ", F.regexp_extract(t, r"^<(\w+)", 1), F.regexp_replace(F.regexp_extract(t, _CLASS, 1), r"\d+", ""))
    tags = F.transform(F.array_distinct(F.regexp_extract_all("html", F.lit(_LAYOUT), F.lit(0))), lambda t: F.lower(tag(t)))
    return F.xxhash64(F.array_sort(F.array_distinct(tags)))


def extract_text(pages: DataFrame) -> DataFrame:
    """-> page_id, url, text, n_chars; one row per input row.

    A null html is empty, and an empty page has an empty text. Pages without a host are one group. Hosts of fewer than five distinct pages have no template, layouts
    of fewer only their host's. Repeated rows give repeated results; an empty table gives no rows; other columns are ignored. The shares are counted over distinct
    pages, summed in each task before they are shuffled, so a host of any size is never gathered: each of n copies of a page on a host counts 1/n. Pages themselves
    are shuffled only if exemplars exceed 24 MB or over 100,000 pages have copies.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host().alias("host"))
    base = base.withColumn("layout", _layout())
    hashed = base.where(F.col("html").rlike(r"\S")).withColumn("h", F.unhex(F.md5(F.col("html").cast("binary"))))
    distinct = materialise(hashed.groupBy("host", "layout", "h").agg(F.count("*").alias("copies")), "html-pages")
    layouts = distinct.groupBy("host", "layout").agg(F.min("h").alias("h"), F.count("*").alias("pages"))
    every = layouts.groupBy("host").agg(F.max_by("h", F.struct("pages", "layout")).alias("h"), F.sum("pages").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    several = layouts.where(F.col("pages") >= MIN_PAGES).join(every.select("host", F.col("pages").alias("all")), "host").where("pages < all")
    # A null layout stands for all of the host's pages.
    groups = every.select("host", F.lit(None).cast("long").alias("layout"), "h", "pages").unionByName(several.select("host", "layout", "h", "pages"))
    groups = materialise(groups, "exemplar-ids")
    chosen = F.broadcast(groups) if groups.count() <= 100_000 else groups
    exemplars = materialise(hashed.drop("layout").join(chosen, ["host", "h"]).groupBy("host", "layout", "pages").agg(F.min("html").alias("exemplar")), "exemplars")
    found, size = exemplars.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("exemplar")), F.lit(0))).first()
    small = found <= 100_000 and size <= SENT_BYTES
    sent = {(r["host"], r["layout"]): r["exemplar"] for r in exemplars.select("host", "layout", "exemplar").toLocalIterator()} if small else {}
    shared = spark.sparkContext.broadcast(sent)

    def joined(rows: DataFrame, more: DataFrame) -> DataFrame:
        if small:
            return rows
        rest = [c for c in more.columns if c not in ("host", "layout")]
        own = more.where("layout is not null").select("host", "layout", *[F.col(c).alias(f"own_{c}") for c in rest])
        return rows.join(more.where("layout is null").drop("layout"), "host", "left").join(own, ["host", "layout"], "left")

    def texts(b: pa.RecordBatch) -> Iterator[list[tuple[tuple[str, int | None], str | None]]]:
        """For each page the groups that it belongs to, its host's and its layout's, with their exemplars, if they have one."""
        keys = zip(b.column("host").to_pylist(), b.column("layout").to_pylist())
        if small:
            yield from ([((h, x), t) for x in (None, k) if (t := shared.value.get((h, x))) is not None] for h, k in keys)
        else:
            both = zip(keys, b.column("exemplar").to_pylist(), b.column("own_exemplar").to_pylist())
            yield from ([((h, x), t) for x, t in ((None, whole), (k, own)) if t is not None] for (h, k), whole, own in both)

    copied = distinct.where("copies > 1").select("host", "h", "copies")
    if copied.count() <= SENT_COPIES:
        counted = hashed.join(F.broadcast(copied), ["host", "h"], "left").select("host", "layout", "html", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))
    else:
        counted = hashed.groupBy("host", "layout", "h").agg(F.min("html").alias("html")).select("host", "layout", "html", F.lit(1.0).alias("weight"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Exemplar] = {}
        met: Counter = Counter()
        for b in batches:
            for found, page, weight in zip(texts(b), b.column("html").to_pylist(), b.column("weight").to_pylist()):
                if not found:
                    continue
                root = parse(page)
                prepare(root)
                pairs: dict[str, list[tuple[int, bool | None, float]]] = {}
                for group, text in found:
                    if text not in pairs:
                        if group not in known:
                            if len(known) > 2000:
                                known.clear()
                            known[group] = Exemplar(text)
                        e = known[group]
                        met_here = list(e.pairs(root))
                        amounts = varying(root, {id(y): i for i, _, y in met_here}, {id(y) for _, same, y in met_here if same})
                        pairs[text] = [(i, same, 1.0) for i, same, y in met_here if y.tag == "#text"] + [(i, None, float(n)) for i, n in amounts.items()]
                    for node, same, n in pairs[text]:
                        met[*group, node, same] += n * weight
            if len(met) > 200_000:
                yield _counted(met)
                met.clear()
        if met:
            yield _counted(met)

    stats = joined(counted, exemplars.select("host", "layout", "exemplar")).mapInArrow(released(count), "host string, layout long, node int, same boolean, n double")
    # Sums of 1/n over all n copies are whole numbers but for rounding. Rows without `same` tell amounts of varying text.
    whole = lambda n: F.round(F.sum(n)).cast("long")
    sums = stats.groupBy("host", "layout", "node").agg(whole(F.when(F.col("same").isNotNull(), F.col("n")).otherwise(0.0)).alias("met"), whole(F.when(F.col("same"), F.col("n")).otherwise(0.0)).alias("same"), whole(F.when(F.col("same").isNull(), F.col("n")).otherwise(0.0)).alias("amount")).alias("s")
    of = lambda x, y: (F.col(f"{x}.host") == F.col(f"{y}.host")) & F.col(f"{x}.layout").eqNullSafe(F.col(f"{y}.layout"))
    fixed = (F.col("met") >= MIN_PAGES) & (F.col("met") >= MIN_SHARE * F.col("pages")) & (F.col("same") >= CONSTANT * F.col("met"))
    told = sums.join(exemplars.select("host", "layout", "pages").alias("e"), of("s", "e")).groupBy("s.host", "s.layout")
    told = told.agg(F.sort_array(F.collect_list(F.when(fixed, F.col("node")))).alias("constant"), F.collect_list(F.when(F.col("amount") > 0, F.struct("node", "amount"))).alias("amounts"))

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [content_root(prepare(parse(page)), {x["node"]: x["amount"] for x in amounts}) for page, amounts in zip(b.column("exemplar").to_pylist(), b.column("amounts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("layout"), b.column("constant"), pa.array(roots, pa.int32())], ["host", "layout", "constant", "content"])

    held = told.alias("t").join(exemplars.select("host", "layout", "exemplar").alias("e"), of("t", "e")).select("t.host", "t.layout", "constant", "amounts", "exemplar")
    wrappers = materialise(held.mapInArrow(released(induce), "host string, layout long, constant array<int>, content int"), "wrappers")
    constant = {(r["host"], r["layout"]): (frozenset(r["constant"]), r["content"]) for r in wrappers.toLocalIterator()} if small else {}
    fixed_nodes = spark.sparkContext.broadcast(constant)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[Exemplar]] = {}
        for b in batches:
            listed = iter([None] * len(b)) if small else zip(b.column("constant").to_pylist(), b.column("own_constant").to_pylist(), b.column("content").to_pylist(), b.column("own_content").to_pylist())
            out = []
            for key, found, page, told in zip(zip(b.column("host").to_pylist(), b.column("layout").to_pylist()), texts(b), b.column("html").to_pylist(), listed):
                if key not in known:
                    if len(known) > 2000:
                        known.clear()
                    which: dict[str, tuple[frozenset[int], int | None]] = {}
                    for group, text in found:
                        own = group[1] is not None
                        fixed, at = fixed_nodes.value.get(group, (frozenset(), None)) if small else (frozenset(told[own] or ()), told[2 + own])
                        before, root = which.get(text, (frozenset(), None))
                        which[text] = before | fixed, at if at is not None else root
                    known[key] = [Exemplar(t, c, at) for t, (c, at) in which.items()]
                out.append(main_text(page, *known[key]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([*base.select("page_id", "url").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    if small:
        return base.mapInArrow(released(extract), schema)
    known_groups = exemplars.select("host", "layout", "exemplar").alias("e").join(wrappers.alias("w"), of("e", "w"), "left").select("e.host", "e.layout", "exemplar", "constant", "content")
    return joined(base, known_groups).mapInArrow(released(extract), schema)


def _counted(met: Counter) -> pa.RecordBatch:
    host, layout, node, same = zip(*met)
    columns = [pa.array(host, pa.string()), pa.array(layout, pa.int64()), pa.array(node, pa.int32()), pa.array(same, pa.bool_()), pa.array(list(met.values()), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["host", "layout", "node", "same", "n"])
