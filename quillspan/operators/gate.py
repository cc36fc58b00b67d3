"""The gate between a candidate run and its baseline, and text tables of a report.

runs: run ('baseline' or 'candidate'), scope ('overall', 'holdout', 'family'), key, truth, f1, precision, label_accuracy (null: not measurable)
failures: run, form, reason    guards: run, guard, value    offenders: run, guard, form, id
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.sources.scratch import written

# What a run may lose, and the failures that count as new.
F1_DROP, LABEL_DROP, FAMILY_DROP, EPSILON, GLYPH_FLOOR, GUARD_RISE = 0.002, 0.02, 0.02, 1e-9, 0.98, 0.01
BAD_FORMS = ("crash", "timeout", "memory")
GUARDS = {8: "box_over_ink", 9: "label_plausibility"}


def _side_by_side(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: c_<value> of the candidate, b_<value> of the baseline."""
    of = lambda run, v, p: F.max(F.when(F.col("run") == run, F.col(v))).alias(f"{p}_{v}")
    has = [F.max((F.col("run") == run).cast("int")).alias(f"{p}_has") for run, p in (("candidate", "c"), ("baseline", "b"))]
    return df.groupBy(*keys).agg(*has, *[of(run, v, p) for v in values for run, p in (("candidate", "c"), ("baseline", "b"))])


def reasons(runs: DataFrame, failures: DataFrame, guards: DataFrame, offenders: DataFrame) -> DataFrame:
    """ord (of the check), level ('fail' or 'warn'), check, key: what speaks against the candidate. A family that it lacks counts as F1 0."""
    # written once: a row for each scope and key, and one for each guard, which every check reads
    r = written(_side_by_side(runs, ["scope", "key"], ["truth", "f1", "precision", "label_accuracy"]), "gate-runs")
    g = written(_side_by_side(guards, ["guard"], ["value"]), "gate-guards")
    delta = lambda v: F.coalesce(F.col(f"c_{v}"), F.lit(0.0)) - F.col(f"b_{v}")
    row = lambda df, n, level, check, key: df.select(F.lit(n).alias("ord"), (F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(check).alias("check"), key.alias("key"))
    overall, holdout, family = (r.where(f"scope = '{s}'") for s in ("overall", "holdout", "family"))
    none = F.lit("").cast("string")
    unmeasured = (F.coalesce("c_truth", F.lit(0)) == 0) | (F.coalesce("b_truth", F.lit(0)) == 0)
    label: Column = F.when(F.col("c_label_accuracy").isNull() | F.col("b_label_accuracy").isNull(), "warn").when(F.col("c_label_accuracy") - F.col("b_label_accuracy") < -LABEL_DROP, "fail")
    found = [
        row(overall.where(delta("f1") < -F1_DROP), 1, "fail", "overall_f1", none),
        row(holdout.withColumn("l", F.when(unmeasured, "warn").when(delta("f1") < -F1_DROP, "fail")).where("l is not null"), 2, F.col("l"), "holdout_f1", none),
        row(overall.withColumn("l", label).where("l is not null"), 3, F.col("l"), "label_accuracy", none),
        row(family.where("b_truth > 0").where(delta("f1") < -FAMILY_DROP), 4, "fail", "family_f1", F.col("key")),
        row(overall.where(delta("precision") < -EPSILON), 6, "fail", "precision", none),
        row(g.where(f"guard = 'glyph_coverage' AND c_value < {GLYPH_FLOOR}"), 7, "fail", "glyph_coverage", none),
    ]
    bad = failures.where(F.col("reason").isin(*BAD_FORMS))
    before = bad.where("run = 'baseline'").select("form").distinct()
    found.append(row(bad.where("run = 'candidate'").join(before, "form", "left_anti").select("form").distinct(), 5, "fail", "new_failure", F.col("form")))
    known = offenders.where("run = 'baseline'").select("guard", "form", "id").distinct()
    new = offenders.where("run = 'candidate'").join(known, ["guard", "form", "id"], "left_anti").groupBy("guard").agg(F.count("*").alias("n"))
    for n, guard in GUARDS.items():
        risen = g.where(F.col("guard") == guard).where(f"c_value - b_value > {GUARD_RISE}").join(new, "guard", "left")
        found.append(row(risen, n, F.when(F.col("n") > 0, "fail").otherwise("warn"), guard, none))
    return reduce(DataFrame.unionByName, found)


def verdict(found: DataFrame) -> DataFrame:
    """One row: passed, and the checks in their order that failed and that warned."""
    ordered = lambda level: F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == level, F.struct("ord", "key", "check")))), lambda x: F.when(x["key"] == "", x["check"]).otherwise(F.concat(x["check"], F.lit(":"), x["key"])))
    return found.agg(ordered("fail").alias("fails"), ordered("warn").alias("warns")).select((F.size("fails") == 0).alias("passed"), "fails", "warns")


def text_table(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """line_no, line: a head, a dashed rule and the rows in the given order, every cell as wide as its column's longest, two spaces between."""
    cells = df.select(order, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    # one row, so its size is known
    widths = cells.agg(*[F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(f"w_{c}") for c in columns])
    line = lambda value: F.rtrim(F.concat_ws("  ", *[F.rpad(value(c), F.col(f"w_{c}"), F.lit(" ")) for c in columns]))
    head = widths.select(F.lit(0).cast("long").alias("line_no"), line(F.lit).alias("line"))
    rule = widths.select(F.lit(1).cast("long").alias("line_no"), F.concat_ws("  ", *[F.repeat(F.lit("-"), F.col(f"w_{c}")) for c in columns]).alias("line"))
    numbered = cells.withColumn("line_no", F.expr(f"row_number() OVER (ORDER BY {order}) + 1").cast("long"))
    return head.unionByName(rule).unionByName(numbered.join(F.broadcast(widths)).select("line_no", line(F.col).alias("line")))
