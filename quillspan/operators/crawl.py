"""What a polite crawl does with each address of its list, told from a log of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Answers after which a host is left alone.
REFUSALS = (403, 429)


def host_of(url: str) -> F.Column:
    """The part after the scheme up to the path, with its port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def decisions(rows: DataFrame, robots: DataFrame, held: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """rows (ord, host, url, path, status, sha) -> ord, decision, in the order of ord.

    'limit' once `limit` files are new, else 'known' where the address was taken before, 'blocked' after a refusal of the host to this list, 'robots' where a rule of
    robots (host, prefix) forbids the path, 'refused' (403, 429), 'failed' (any status but 200), 'duplicate' where the content was taken before, or 'fetch'. held
    (url, sha, either null) is what earlier runs took. An address that once gave a duplicate is asked again, except that it can't get the host blocked.
    """
    key = ["ord", "host", "url", "path", "status", "sha"]
    forbidden = rows.alias("u").join(robots.alias("r"), (F.col("u.host") == F.col("r.host")) & F.startswith("u.path", "r.prefix"), "left_semi").select("ord").withColumn("forbidden", F.lit(True))
    u = rows.select(*key).join(forbidden, "ord", "left").withColumn("forbidden", F.coalesce("forbidden", F.lit(False)))
    if held is not None:
        u = u.join(held.where("url IS NOT NULL").select("url").distinct().withColumn("old_url", F.lit(True)), "url", "left")
        u = u.join(held.where("sha IS NOT NULL").select("sha").distinct().withColumn("old_sha", F.lit(True)), "sha", "left")
    else:
        u = u.withColumns({"old_url": F.lit(None).cast("boolean"), "old_sha": F.lit(None).cast("boolean")})
    u = u.withColumns({"old_url": F.coalesce("old_url", F.lit(False)), "old_sha": F.coalesce("old_sha", F.lit(False))})
    asked = ~F.col("forbidden") & ~F.col("old_url")
    answered = asked & (F.col("status") == 200)
    u = u.withColumn("answered_at", F.min(F.when(answered, F.col("ord"))).over(Window.partitionBy("url")))
    refusal = asked & F.col("status").isin(*REFUSALS) & (F.col("answered_at").isNull() | (F.col("answered_at") > F.col("ord")))
    u = u.withColumn("blocked_at", F.min(F.when(refusal, F.col("ord"))).over(Window.partitionBy("host")))
    u = u.withColumn("blocked", F.coalesce(F.col("blocked_at") < F.col("ord"), F.lit(False)))
    taken = answered & ~F.col("blocked") & ~F.col("old_sha")
    u = u.withColumn("sha_at", F.min(F.when(taken, F.col("ord"))).over(Window.partitionBy("sha")))
    kept = taken & (F.col("sha_at") == F.col("ord"))
    u = u.withColumn("url_at", F.min(F.when(kept, F.col("ord"))).over(Window.partitionBy("url")))
    decision = (
        F.when(F.col("old_url") | F.coalesce(F.col("url_at") < F.col("ord"), F.lit(False)), "known")
        .when(F.col("blocked"), "blocked")
        .when(F.col("forbidden"), "robots")
        .when(F.col("status").isin(*REFUSALS), "refused")
        .when(F.col("status") != 200, "failed")
        .when(F.col("old_sha") | F.coalesce(F.col("sha_at") < F.col("ord"), F.lit(False)), "duplicate")
        .otherwise("fetch")
    )
    out = u.select("ord", decision.alias("decision"))
    if limit is None:
        return out
    # one row: the place of the last file that is still taken
    last = out.where("decision = 'fetch'").orderBy("ord").limit(limit).agg(F.max("ord").alias("last"), F.count("*").alias("n"))
    over = (F.col("n") >= limit) & (F.col("ord") > F.coalesce("last", F.lit(-1)))
    return out.join(F.broadcast(last)).select("ord", F.when(over, "limit").otherwise(F.col("decision")).alias("decision"))


def manifest_summary(records: DataFrame, verdicts: list[str]) -> DataFrame:
    """records (verdict) -> ord, verdict, n: a row for each verdict in the given order, also where there is none of it, then those that aren't listed."""
    order = F.array_position(F.array(*map(F.lit, verdicts)), F.col("verdict"))
    known = records.sparkSession.createDataFrame([(v,) for v in verdicts], "verdict string")
    counted = records.groupBy("verdict").agg(F.count("*").alias("n"))
    every = known.join(counted, "verdict", "full").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))
    return every.select(F.when(order > 0, order).otherwise(len(verdicts) + 1).cast("long").alias("ord"), "verdict", "n")
