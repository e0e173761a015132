"""Readers: article pool, season assignments, near-duplicate groups, season windows, samples, label rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POOL = "gkg_record_id string, url string, datetime string, article string, themes array<string>, locations array<string>"
SEASONS = "gkg_record_id string, datetime string, country_seasons array<string>, sampling_country string, sampling_season string"
GROUPS = "gkg_record_id string, near_dup_group string, group_size int"
WINDOWS = "season_id string, country string, season_year int, onset_date date, window_start date, window_end date"
SAMPLE = "record_id string, url string, scan_date string, country string, season string, phase string, year int, bucket string, reason string, near_dup_group string, group_size int, text string"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def pool_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four relations of a pool folder: articles, seasons, groups, windows."""
    return (jsonl(spark, f"{folder}/pooled_articles.jsonl", POOL), jsonl(spark, f"{folder}/season_assignments.jsonl", SEASONS),
            jsonl(spark, f"{folder}/near_dup_groups.jsonl", GROUPS), json_array(spark, f"{folder}/season_windows.json", WINDOWS))


def sample(spark: SparkSession, path: str) -> DataFrame:
    """The drawn sample, one object a line; a blank line raises, unlike in the pool's files."""
    if n := spark.read.text(path).where("trim(value) = ''").count():
        raise ValueError(f"{n} blank lines in {path}")
    return jsonl(spark, path, SAMPLE)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A filled sheet: CSV with a header, a byte-order mark, quoted fields and line feeds inside them."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def useful_flag(rows: DataFrame, column: str = "useful") -> DataFrame:
    """Yes and no of people, and JSON booleans of models, as one boolean; anything else is null."""
    word = F.lower(F.trim(F.col(column).cast("string")))
    return rows.withColumn(column, F.when(word.isin("yes", "true"), True).when(word.isin("no", "false"), False))
