"""Readers of the three JSON contracts, of page-object tables and of raw files, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "array<struct<page:int,width:double,height:double>>"
TRUTH = f"version int, source_pdf string, origin string, family string, pages {PAGES}, widgets array<struct<page:int,type:string,rect:array<double>,label:string,expects_rule:string>>"
FIELDS = f"version int, source struct<pages:int>, notice struct<code:string,message:string>, pages {PAGES}, fields array<struct<id:string,page:int,type:string,rect:array<double>,label:string,group:string,rule:string,confidence:double,origin:string>>"
MANIFEST = "files array<struct<url:string,file:string,sha256:string,bytes:bigint,pages:int,producer:string,creator:string,has_acroform:boolean,widget_count:int,thin_h_rects:int,thin_v_rects:int,checkbox_glyphs:int,underscore_chars:int,fonts:array<string>,verdict:string,reason:string>>, skipped array<struct<url:string,reason:string>>, blocked_hosts array<string>"
PAGE_OBJECTS = {
    "pages": "doc_id string, page int, width double, height double",
    "words": "doc_id string, page int, word_ix int, text string, x0 double, x1 double, top double, bottom double",
    "chars": "doc_id string, page int, char_ix int, text string, x0 double, x1 double, top double, bottom double",
    "rects": "doc_id string, page int, rect_ix int, x0 double, x1 double, top double, bottom double, width double, height double, fill boolean, stroke boolean",
    "curves": "doc_id string, page int, curve_ix int, x0 double, x1 double, top double, bottom double, fill boolean, stroke boolean, path array<struct<op:string,x:double,y:double>>",
    "images": "doc_id string, page int, image_ix int, width double, height double",
}


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """doc, family, origin, ti, page, type, x0, y0, x1, y1, label, rule: one row per widget, corners in order. Broken files are left out of the rows, not of the run."""
    raw = spark.read.schema(TRUTH).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    w = raw.where("widgets is not null").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("doc"), "family", "origin", F.posexplode("widgets").alias("ti", "w"))
    r = [F.col("w.rect")[i] for i in range(4)]
    return w.select("doc", "family", "origin", F.col("ti").cast("long").alias("ti"), "w.page", "w.type", F.least(r[0], r[2]).alias("x0"), F.least(r[1], r[3]).alias("y0"), F.greatest(r[0], r[2]).alias("x1"), F.greatest(r[1], r[3]).alias("y1"), "w.label", F.coalesce("w.expects_rule", F.lit("unknown")).alias("rule"))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIELDS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Missing parts of a manifest are empty."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return m.select(*[F.coalesce(c, F.array()).alias(c) for c in m.columns])


def read_files(spark: SparkSession, path: str, most_bytes: int = 20 << 20) -> DataFrame:
    """path, bytes, sha256, content (null over the limit): raw documents, hashed in the JVM."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def read_page_objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(PAGE_OBJECTS[kind]).parquet(f"{path}/{kind}")


def pair_with_truth(files: DataFrame, truth_paths: DataFrame) -> DataFrame:
    """Each truth file with the document of its name beside it, or else the first of that name anywhere."""
    name, folder = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    f = files.select(F.col("path").alias("file"), name.alias("name"), folder.alias("dir"))
    t = truth_paths.select(F.col("path").alias("truth"), name.alias("name"), folder.alias("dir"))
    anywhere = f.groupBy("name").agg(F.min("file").alias("any"))
    return t.join(f, ["name", "dir"], "left").join(anywhere, "name", "left").select("truth", F.coalesce("file", "any").alias("file")).where("file is not null")
