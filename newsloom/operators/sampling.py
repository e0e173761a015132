"""The quota draw over (country, season, phase), bucket sizes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import drawn

# How many articles each bucket gives; the junk buckets share one entry.
QUOTAS = {
    "P_A1_counts": 240, "P_B_trend_response": 200, "P_A2_case_event": 130, "Z_zoonotic_human": 30,
    "N_other_flu_mention": 150, "N_awareness": 110, "N_animal_flu": 75, "N_other_disease": 60, "N_no_flu_text": 50,
    "N_research": 40, "N_history_only": 40, "N_flu_idiom": 30, "N_business_policy": 20, "JUNK": 25,
}
JUNK = ["X_spam_stub", "X_too_short", "X_listing_garbled"]
COLUMNS = ["record_id", "url", "scan_date", "country", "season", "phase", "year", "bucket", "reason", "near_dup_group", "group_size"]
CELL = ["country", "season", "phase"]


def quota_name(bucket: Column) -> Column:
    return F.when(bucket.isin(JUNK), "JUNK").otherwise(bucket)


def quota_table(spark, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    return spark.createDataFrame([(i, n, q) for i, (n, q) in enumerate(quotas.items())], "ordinal int, name string, quota int")


def draw(articles: DataFrame, seed: int = 42, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """The sample with its order (ordinal, pos): each quota bucket's cells in turn, one article each.

    A cell's rank beyond the largest quota can never be drawn, which bounds what reaches the second
    window; light columns alone are shuffled where the caller selects them.
    """
    spark = articles.sparkSession
    named = articles.withColumn("name", quota_name(F.col("bucket")))
    cell = Window.partitionBy("name", *CELL).orderBy(drawn(seed, "cell", "record_id"), "record_id")
    turns = named.withColumn("turn", F.row_number().over(cell)).where(F.col("turn") <= max(quotas.values()))
    order = Window.partitionBy("name").orderBy("turn", drawn(seed, "order", "name", *CELL), *CELL)
    # tighter bound for the second window: the first `quota` of each bucket
    placed = turns.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= max(quotas.values()))
    return placed.join(F.broadcast(quota_table(spark, quotas)), "name").where("pos <= quota").drop("turn", "quota")


def bucket_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy(quota_name(F.col("bucket")).alias("name"), "country").agg(F.count("*").alias("n"))


def bucket_sizes(articles: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """Every quota bucket with its quota and size, zeros included."""
    sizes = articles.groupBy(quota_name(F.col("bucket")).alias("name")).agg(F.count("*").alias("n"))
    return F.broadcast(quota_table(articles.sparkSession, quotas)).join(sizes, "name", "left").select("ordinal", "name", "quota", F.coalesce("n", F.lit(0)).alias("n"))


def sizes_document(articles: DataFrame, quotas: dict[str, int] = QUOTAS) -> dict:
    """The summary: eligible articles, quotas, sizes by bucket, and by bucket and country (a few rows)."""
    per = {(r["name"], r["country"]): r["n"] for r in bucket_counts(articles).collect()}
    countries = {n: dict(sorted((c, k) for (b, c), k in per.items() if b == n)) for n in quotas}
    return {"eligible_articles": sum(per.values()), "quotas": dict(quotas), "per_bucket": {n: sum(countries[n].values()) for n in quotas}, "per_bucket_country": countries}


def rollup(articles: DataFrame) -> DataFrame:
    """Counts by bucket and country, by bucket, and in all (nulls mark the totals)."""
    return articles.withColumn("name", quota_name(F.col("bucket"))).rollup("name", "country").agg(F.count("*").alias("n"))


def frequency(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def pool_rate(sample: DataFrame, articles: DataFrame, flag: str, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """The pool's rate of a flag from the sample: each bucket weighs its size over its drawn rows."""
    drawn_rows = sample.groupBy(quota_name(F.col("bucket")).alias("name")).agg(F.count("*").alias("drawn"), F.sum(F.col(flag).cast("int")).alias("positive"))
    both = bucket_sizes(articles, quotas).join(drawn_rows, "name")
    return both.agg(F.round(F.sum(F.col("n") * F.col("positive") / F.col("drawn")) / F.sum("n"), 6).alias("rate"), F.sum("n").alias("n"), F.sum("drawn").alias("drawn"))


def cell_rate(sample: DataFrame, articles: DataFrame, flag: str) -> DataFrame:
    """pool_rate with a weight for each cell (bucket, country, season, phase) that was drawn from, an extension: the
    draw takes cells in turn, so that a bucket's small cells are drawn more densely than its large ones.

    Cells that were not drawn from weigh nothing; covered is the share of articles in those that were.
    """
    named = lambda rows: rows.withColumn("name", quota_name(F.col("bucket")))
    sizes = named(articles).groupBy("name", *CELL).agg(F.count("*").alias("n"))
    got = named(sample).groupBy("name", *CELL).agg(F.count("*").alias("drawn"), F.sum(F.col(flag).cast("int")).alias("positive"))
    both = sizes.join(got, ["name", *CELL], "left")
    seen = F.when(F.col("drawn") > 0, F.col("n"))
    return both.agg(F.round(F.sum(F.col("n") * F.col("positive") / F.col("drawn")) / F.sum(seen), 6).alias("rate"), F.round(F.sum(seen) / F.sum("n"), 6).alias("covered"), F.sum("n").alias("n"), F.sum("drawn").alias("drawn"))
