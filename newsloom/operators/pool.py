"""The article pool: eligibility, integrity checks, one article a near-duplicate group, season phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import drawn, phase


def eligible(seasons: DataFrame) -> DataFrame:
    """Season rows whose sampling season is neither null nor empty."""
    return seasons.where("coalesce(sampling_season, '') <> ''")


def english(pool: DataFrame) -> DataFrame:
    """The English articles of a pool that names its languages (lang), without that column; other pools as they are."""
    return pool.where("lang = 'en'").drop("lang") if "lang" in pool.columns else pool


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to as many tasks as the session has for shuffles, and one for each core at least.

    The cascade is bound by its patterns, not by bytes: tasks made by size would leave cores idle. The number is
    given by name, so that adaptive execution doesn't join the tasks again, and a join by key needs no other shuffle.
    Such a join should name the other side, of light rows, as the one that is hashed: a small pool would else be sent
    to the other side's few tasks.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def without_group(seasons: DataFrame, groups: DataFrame) -> DataFrame:
    """Eligible articles that the near-duplicate table does not know."""
    return eligible(seasons).join(groups, "gkg_record_id", "left_anti").select("gkg_record_id")


def without_window(seasons: DataFrame, windows: DataFrame) -> DataFrame:
    """Eligible articles whose season has no window."""
    return eligible(seasons).join(windows, eligible(seasons)["sampling_season"] == windows["season_id"], "left_anti").select("gkg_record_id")


def check(seasons: DataFrame, groups: DataFrame, windows: DataFrame) -> None:
    """Raise where a lookup would silently drop or repeat articles."""
    for what, missing in (("near-duplicate group", without_group(seasons, groups)), ("season window", without_window(seasons, windows))):
        if n := missing.count():
            raise ValueError(f"{n} eligible articles have no {what}")
    for name, table, key in (("season", seasons, "gkg_record_id"), ("group", groups, "gkg_record_id"), ("window", windows, "season_id")):
        if n := table.groupBy(key).count().where("count > 1").count():
            raise ValueError(f"{n} keys are repeated in the {name} table")


def one_per_group(seasons: DataFrame, groups: DataFrame, seed: int = 42) -> DataFrame:
    """The article drawn from each near-duplicate group, among eligible members alone.

    A minimum of (draw, id) in each group: a partial aggregation, so a large group needs no sort.
    """
    members = groups.join(eligible(seasons).select("gkg_record_id"), "gkg_record_id", "left_semi")
    best = members.groupBy("near_dup_group").agg(F.min(F.struct(drawn(seed, "pick", "gkg_record_id").alias("d"), F.col("gkg_record_id").alias("id"), "group_size")).alias("m"))
    return best.select(F.col("m.id").alias("gkg_record_id"), "near_dup_group", F.col("m.group_size").alias("group_size"))


def read_pool(pool: DataFrame, seasons: DataFrame, groups: DataFrame, windows: DataFrame, seed: int = 42, checked: bool = True) -> DataFrame:
    """Eligible articles, one a group, with phase: record_id, url, scan_date, year, text, country, season, phase, near_dup_group, group_size.

    Of a pool with lang, English articles alone. Ids are joined first; the texts come last and cross one shuffle.
    """
    pool = english(pool)
    if checked:
        check(seasons, groups, windows)
    kept = one_per_group(seasons, groups, seed).join(eligible(seasons).select("gkg_record_id", "sampling_country", "sampling_season"), "gkg_record_id")
    kept = kept.join(windows.select("season_id", "onset_date"), F.col("sampling_season") == F.col("season_id"))
    day = F.to_date(F.substring("datetime", 1, 10), "yyyy-MM-dd")
    full = spread(pool.select("gkg_record_id", "url", day.alias("day"), "article"), "gkg_record_id").join(kept.hint("shuffle_hash"), "gkg_record_id")
    return full.select(F.col("gkg_record_id").alias("record_id"), "url", F.col("day").cast("string").alias("scan_date"), F.year("day").alias("year"), F.coalesce("article", F.lit("")).alias("text"),
                       F.col("sampling_country").alias("country"), F.col("sampling_season").alias("season"), phase(F.col("day"), F.col("onset_date")).alias("phase"), "near_dup_group", "group_size")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each distinct text: the smallest key and the number of copies. The texts are compared by a 256-bit hash."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256")).agg(F.min(key).alias(key), F.count("*").alias("copies"))
