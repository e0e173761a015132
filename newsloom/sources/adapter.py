"""The documents table as an article pool: seasons, near-duplicate groups and a phrase for each branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# By doc_id modulo their number, one phrase for each branch of the cascade, then some of several sentences
# that meet the rarer patterns and give shares between none and all.
PHRASES = [
    "Health officials confirmed 12 flu cases this week.",
    "A second flu infection was confirmed in the city yesterday.",
    "Influenza is widespread across the region.",
    "Schools were closed because of the flu.",
    "A man was infected with bird flu in the district.",
    "Bird flu was found in poultry and the flock was culled.",
    "She had stomach flu all weekend.",
    "Measles came first. Measles came again. Dengue came too. Flu was mentioned once.",
    "The 1918 flu killed many.",
    "Last year 40 people died of flu.",
    "Researchers published a paper about influenza.",
    "Shares of the flu drug manufacturer were flat.",
    "Lawmakers discussed flu funding.",
    "Get your flu shot before winter.",
    "The word flu appears here.",
    "Play at the casino tonight.",
    "Jan 5, 2016 news item. " * 6,
    "20 percent of students are sick with flu.",
    "The study reported 12 flu cases this week.",
    "",
    "Flu cases are rising faster than at this time last year. The flu came early. The word flu is here too.",
    "The virus killed at least 30 people as flu spread this month.",
    "In the 1990s 40 people died of flu. The flu was severe then. Nobody spoke of flu for long.",
    "Flu season usually peaks in February. Flu cases are usually rising then.",
    "Flu cases could rise if the weather stays cold. Flu might spread.",
    "She was hospitalized with the flu. The singer left the hospital.",
    "There is no evidence that flu activity is widespread. Flu was discussed.",
    "Zika and flu outbreaks are spreading. The flu is around. Polio came up.",
    "The football team said flu activity was rising among players. Flu again.",
    "Flu activity is rising sharply in the north. Get your flu shot. Tips on flu. More on flu.",
    "There were no human cases of bird flu, which poses no danger. An h5n1 flock was culled.",
    "3 human cases of h7n9 were confirmed today. Poultry was culled after bird flu.",
    "Researchers wrote about flu. The word flu appears here. Flu is named once more.",
    "Last season the flu was mild. The word flu appears here. Nothing else on flu. Flu.",
    "Shares fell on flu news. Flu came up in the talk. Flu was named. Flu.",
    "She had stomach flu. The word flu appears here.",
    "Visiting restrictions are in place at wards because of flu. Ebola was ruled out.",
    "Flu cases rose to 1,200 on Monday, up from 800 a week before. Vaccination protects against flu.",
    "Officials reported no new cases of dengue, measles or polio.\nThe flu season has not yet begun.",
    "In 2009 the hospital admitted 20 patients with flu.\nAbout 15 residents died of the flu yesterday. 30 percent of pupils are sick.",
]
COUNTRIES = ["USA", "India", "Australia", "Brazil", "Indonesia", "Kenya"]
FIRST_YEAR, YEARS = 2015, 3


def _pick(values: list[str], at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def article_pool(docs: DataFrame) -> DataFrame:
    """Documents as articles: gkg_record_id, url, datetime, article, lang."""
    k = F.pmod(F.col("doc_id"), F.lit(len(PHRASES)))
    day = F.date_add(_onset(), (F.pmod(F.col("doc_id") * 37, F.lit(91)) - 70).cast("int"))
    return docs.select(
        F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("gkg_record_id"),
        F.concat(F.lit("http://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(day.cast("string"), F.lit("T06:00:00")).alias("datetime"),
        F.concat(F.col("text"), F.lit("\n"), _pick(PHRASES, k)).alias("article"), "doc_id", F.md5("text").alias("text_md5"), "lang")


def _onset():
    c, y = F.pmod(F.col("doc_id"), F.lit(6)), F.pmod(F.floor(F.col("doc_id") / 6), F.lit(YEARS))
    return F.make_date((y + FIRST_YEAR).cast("int"), (c + 1).cast("int"), (c + 5).cast("int"))


def seasons(pool: DataFrame) -> DataFrame:
    """gkg_record_id, sampling_country, sampling_season; every seventeenth article has no season."""
    c, y = F.pmod(F.col("doc_id"), F.lit(6)), F.pmod(F.floor(F.col("doc_id") / 6), F.lit(YEARS)) + FIRST_YEAR
    none = F.pmod(F.col("doc_id"), F.lit(17)) == 0
    country = F.when(~none, _pick(COUNTRIES, c))
    return pool.select("gkg_record_id", country.alias("sampling_country"), F.when(none, F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, "")).otherwise(F.concat_ws("-", country, y)).alias("sampling_season"))


def groups(pool: DataFrame) -> DataFrame:
    """gkg_record_id, near_dup_group, group_size: articles of one document text form a group."""
    sizes = pool.groupBy("text_md5").agg(F.min("gkg_record_id").alias("near_dup_group"), F.count("*").cast("int").alias("group_size"))
    return pool.select("gkg_record_id", "text_md5").join(sizes, "text_md5").drop("text_md5")


def windows(spark) -> DataFrame:
    """season_id, country, season_year, onset_date, window_start, window_end, from constants."""
    base = spark.range(len(COUNTRIES) * YEARS).select(F.pmod("id", F.lit(6)).alias("c"), (F.floor(F.col("id") / 6) + FIRST_YEAR).cast("int").alias("season_year"))
    onset = F.make_date("season_year", (F.col("c") + 1).cast("int"), (F.col("c") + 5).cast("int"))
    return base.select(F.concat_ws("-", _pick(COUNTRIES, F.col("c")), "season_year").alias("season_id"), _pick(COUNTRIES, F.col("c")).alias("country"), "season_year",
                       onset.alias("onset_date"), F.date_sub(onset, 70).alias("window_start"), F.date_add(onset, 14).alias("window_end"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


#: The same relations in DuckDB SQL, as common table expressions.
SQL = f"""
pool AS (
  SELECT 'a' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS gkg_record_id, 'http://news.example/' || doc_id AS url,
         strftime(make_date(CAST({FIRST_YEAR} + (doc_id // 6) % {YEARS} AS BIGINT), doc_id % 6 + 1, doc_id % 6 + 5) + CAST((doc_id * 37) % 91 - 70 AS INT), '%Y-%m-%d') || 'T06:00:00' AS datetime,
         text || chr(10) || {_sql_list(PHRASES)}[CAST(doc_id % {len(PHRASES)} + 1 AS INT)] AS article, doc_id, md5(text) AS text_md5
  FROM documents WHERE lang = 'en'),
seasons AS (
  SELECT gkg_record_id, CASE WHEN doc_id % 17 <> 0 THEN {_sql_list(COUNTRIES)}[CAST(doc_id % 6 + 1 AS INT)] END AS sampling_country,
         CASE WHEN doc_id % 17 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '' END ELSE {_sql_list(COUNTRIES)}[CAST(doc_id % 6 + 1 AS INT)] || '-' || CAST((doc_id // 6) % {YEARS} + {FIRST_YEAR} AS VARCHAR) END AS sampling_season
  FROM pool),
grp AS (
  SELECT gkg_record_id, min(gkg_record_id) OVER (PARTITION BY text_md5) AS near_dup_group, CAST(count(*) OVER (PARTITION BY text_md5) AS INT) AS group_size FROM pool),
win AS (
  SELECT {_sql_list(COUNTRIES)}[CAST(i % 6 + 1 AS INT)] || '-' || CAST(i // 6 + {FIRST_YEAR} AS VARCHAR) AS season_id, make_date(CAST(i // 6 + {FIRST_YEAR} AS BIGINT), i % 6 + 1, i % 6 + 5) AS onset_date
  FROM range({len(COUNTRIES) * YEARS}) t(i))"""
