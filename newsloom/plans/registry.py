"""The queries of the sampling engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import classify, packets, pool, sampling, statements
from newsloom.plans import sql as S
from newsloom.session import kept, table
from newsloom.sources import adapter

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, ctes: str, select: str):
    """Register a query under a name, with its SQL twin."""
    def put(f):
        _QUERIES[name] = f
        _SQL[name] = (f"WITH {ctes} " if ctes else "") + select
        return f
    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- inputs ------------------------------------------------------------------------------------

def relations(spark, sf_dir):
    p = pool.english(adapter.article_pool(table(spark, sf_dir, "documents")))
    return p, adapter.seasons(p), adapter.groups(p), adapter.windows(spark)


def articles(spark, sf_dir):
    return pool.read_pool(*relations(spark, sf_dir), checked=False)


def featured(spark, sf_dir):
    return classify.features(articles(spark, sf_dir))


def buckets(spark, sf_dir):
    return classify.bucketed(articles(spark, sf_dir))


def sample(spark, sf_dir):
    return sampling.draw(buckets(spark, sf_dir).drop("text"))


def cells(spark, sf_dir):
    """The buckets' rows with what cells and their draw need, computed once for queries that use them twice."""
    return kept(buckets(spark, sf_dir).select("record_id", "bucket", "year", *sampling.CELL))


def dealt(spark, sf_dir):
    return packets.deal(sample(spark, sf_dir))


def _places(spark, sf_dir):
    """Extracted items from the events: an article, a place (city, state, country), a kind, a date and a number."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("state"))
    e = table(spark, sf_dir, "events").withColumns({"_n": F.pmod("user_id", F.lit(25)).cast("int"), "city": F.concat(F.lit("city_"), F.pmod("user_id", F.lit(50)))})
    return e.join(named, e["_n"] == named["n_nationkey"]).select(
        "event_id", F.pmod("event_id", F.lit(1000)).alias("article_id"), "country", "state", "city", F.col("event_type").alias("kind"), F.to_date("ts").alias("start_date"), F.date_add(F.to_date("ts"), F.pmod("event_id", F.lit(3)).cast("int")).alias("end_date"),
        F.floor("value").cast("bigint").alias("number"), F.when(F.pmod("event_id", F.lit(2)) == 0, "new").otherwise("total").alias("total_or_new"))


_ITEMS = """items AS (
  SELECT event_id, event_id % 1000 AS article_id, n_name AS country, r_name AS state, 'city_' || (user_id % 50) AS city, event_type AS kind, CAST(ts AS DATE) AS start_date, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS end_date,
         CAST(floor(value) AS BIGINT) AS number, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'total' END AS total_or_new
  FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON r_regionkey = n_regionkey)"""

# ---- scalars and features ----------------------------------------------------------------------


@query("normalise_len", S.FEATURES, "SELECT record_id, CAST(n_norm AS BIGINT) AS n_norm FROM junk")
def normalise_len(spark, sf_dir):
    return classify.junk_features(articles(spark, sf_dir)).select("record_id", F.col("n_norm").cast("long").alias("n_norm"))


@query("junk_spam", S.FEATURES, "SELECT record_id FROM junk WHERE is_spam")
def junk_spam(spark, sf_dir):
    return classify.junk_features(articles(spark, sf_dir)).where("is_spam").select("record_id")


@query("junk_short", S.FEATURES, "SELECT record_id, CAST(n_norm AS BIGINT) AS n_norm FROM junk WHERE NOT is_spam AND n_norm < 300")
def junk_short(spark, sf_dir):
    return classify.junk_features(articles(spark, sf_dir)).where("n_norm < 300 and not is_spam").select("record_id", F.col("n_norm").cast("long").alias("n_norm"))


@query("junk_listing", S.FEATURES, "SELECT record_id, CAST(n_digits AS BIGINT) AS n_digits, CAST(n_dated AS BIGINT) AS n_dated FROM junk WHERE NOT is_spam AND n_norm >= 300 AND (n_digits / n_norm > 0.05 OR n_dated >= 6)")
def junk_listing(spark, sf_dir):
    f = classify.junk_features(articles(spark, sf_dir)).where("n_norm >= 300 and (n_digits / nullif(n_norm, 0) > 0.05D or n_dated >= 6) and not is_spam")
    return f.select("record_id", F.col("n_digits").cast("long").alias("n_digits"), F.col("n_dated").cast("long").alias("n_dated"))


@query("sentence_count", S.FEATURES, "SELECT record_id, count(*) AS n FROM sent GROUP BY record_id")
def sentence_count(spark, sf_dir):
    return articles(spark, sf_dir).select("record_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("flu_sentence_count", S.FEATURES, "SELECT record_id, count(*) FILTER (flu) AS n FROM sent GROUP BY record_id")
def flu_sentence_count(spark, sf_dir):
    found = F.size(F.filter(F.col("ss"), lambda s: X.has(s, "FLU")))
    return articles(spark, sf_dir).select("record_id", X.sentences(F.col("text")).alias("ss")).where("size(ss) > 0").select("record_id", found.cast("long").alias("n"))


@query("near_flu_sentences", S.FEATURES, "SELECT record_id, CAST(near AS BIGINT) AS n FROM feat WHERE near > 0")
def near_flu_sentences(spark, sf_dir):
    return featured(spark, sf_dir).select("record_id", F.col("sums.near").cast("long").alias("n")).where("n > 0")


@query("flu_occurrences", S.FEATURES, "SELECT record_id, CAST(n_flu AS BIGINT) AS n_flu FROM junk")
def flu_occurrences(spark, sf_dir):
    return classify.junk_features(articles(spark, sf_dir)).select("record_id", F.col("n_flu").cast("long").alias("n_flu"))


@query("animal_share", S.FEATURES, "SELECT record_id, CAST(n_animal AS BIGINT) AS n_animal, CAST(n_flu + n_animal AS BIGINT) AS n_both FROM junk WHERE n_flu + n_animal > 0")
def animal_share(spark, sf_dir):
    f = classify.junk_features(articles(spark, sf_dir))
    return f.select("record_id", F.col("n_animal").cast("long").alias("n_animal"), (F.col("n_flu") + F.col("n_animal")).cast("long").alias("n_both")).where("n_both > 0")


def _sums(spark, sf_dir, names):
    return featured(spark, sf_dir).where("sums.flu > 0").select("record_id", *[F.col(f"sums.{n}").cast("long").alias(n) for n in names])


def _sums_sql(names):
    return f"SELECT record_id, {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in names)} FROM feat WHERE flu > 0"


@query("idiom_share", S.FEATURES, _sums_sql(["idiom", "flu"]))
def idiom_share(spark, sf_dir):
    return _sums(spark, sf_dir, ["idiom", "flu"])


_TOPICS = ["flu", "research", "past", "business", "policy", "aware"]


@query("topic_shares", S.FEATURES, _sums_sql(_TOPICS))
def topic_shares(spark, sf_dir):
    return _sums(spark, sf_dir, _TOPICS)


@query("other_disease_gate", S.FEATURES, "SELECT record_id, CAST(other_disease AS BIGINT) AS other_disease, CAST(n_flu AS BIGINT) AS n_flu, other_disease > n_flu AND numbered + event + trend + response = 0 AS gate FROM feat WHERE flu > 0")
def other_disease_gate(spark, sf_dir):
    f = featured(spark, sf_dir).where("sums.flu > 0")
    return f.select("record_id", F.col("sums.other_disease").cast("long").alias("other_disease"), F.col("n_flu").cast("long").alias("n_flu"),
                    F.expr("sums.other_disease > n_flu and sums.numbered + sums.event + sums.trend + sums.response = 0").alias("gate"))


_EVIDENCE = ["numbered", "event", "history", "anchored", "trend", "response", "bird_flu_human"]


@query("evidence_counts", S.FEATURES, _sums_sql(_EVIDENCE))
def evidence_counts(spark, sf_dir):
    return _sums(spark, sf_dir, _EVIDENCE)


# ---- buckets -----------------------------------------------------------------------------------

@query("bucket_assign", S.BUCKETS, "SELECT record_id, bucket, reason FROM bucketed")
def bucket_assign(spark, sf_dir):
    return buckets(spark, sf_dir).select("record_id", "bucket", "reason")


@query("bucket_histogram", S.BUCKETS, "SELECT bucket, count(*) AS n FROM bucketed GROUP BY bucket")
def bucket_histogram(spark, sf_dir):
    return buckets(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


@query("bucket_country_rollup", S.BUCKETS, "SELECT name, country, count(*) AS n FROM qn GROUP BY ROLLUP (name, country)")
def bucket_country_rollup(spark, sf_dir):
    return sampling.rollup(buckets(spark, sf_dir))


@query("bucket_quota_outer", S.BUCKETS, "SELECT ordinal, quotas.name, quota, count(record_id) AS n FROM quotas LEFT JOIN qn USING (name) GROUP BY ALL")
def bucket_quota_outer(spark, sf_dir):
    return sampling.bucket_sizes(buckets(spark, sf_dir))


@query("bucket_country_map", S.BUCKETS, "SELECT name, string_agg(country || '=' || n, ',' ORDER BY country) AS per_country FROM (SELECT name, country, count(*) AS n FROM qn GROUP BY ALL) GROUP BY name")
def bucket_country_map(spark, sf_dir):
    per = sampling.bucket_counts(buckets(spark, sf_dir)).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("country", "n"))).alias("m"))
    return per.select("name", F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["country"], x["n"])), ",").alias("per_country"))


# ---- pool --------------------------------------------------------------------------------------

@query("phase_of", S.ARTICLES, "SELECT record_id, scan_date, season, phase FROM art")
def phase_of(spark, sf_dir):
    return articles(spark, sf_dir).select("record_id", "scan_date", "season", "phase")


@query("phase_histogram", S.ARTICLES, "SELECT season, phase, count(*) AS n FROM art GROUP BY ALL")
def phase_histogram(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("season", "phase").agg(F.count("*").alias("n"))


@query("eligible_pool", S.ARTICLES, "SELECT record_id, url, scan_date, year, country, season, phase, near_dup_group, group_size, CAST(length(text) AS BIGINT) AS n_chars FROM art")
def eligible_pool(spark, sf_dir):
    return articles(spark, sf_dir).select("record_id", "url", "scan_date", "year", "country", "season", "phase", "near_dup_group", "group_size", F.length("text").cast("long").alias("n_chars"))


@query("missing_groups_anti", S.ARTICLES, "SELECT gkg_record_id FROM elig ANTI JOIN (SELECT * FROM grp WHERE group_size = 1) USING (gkg_record_id)")
def missing_groups_anti(spark, sf_dir):
    _, seasons, groups, _ = relations(spark, sf_dir)
    return pool.without_group(seasons, groups.where("group_size = 1"))


@query("season_window_join", S.ARTICLES, "SELECT gkg_record_id, season_id, onset_date FROM elig JOIN win ON season_id = sampling_season")
def season_window_join(spark, sf_dir):
    _, seasons, _, windows = relations(spark, sf_dir)
    return pool.eligible(seasons).join(windows, F.col("sampling_season") == F.col("season_id")).select("gkg_record_id", "season_id", "onset_date")


@query("one_per_group", S.ARTICLES, "SELECT gkg_record_id, near_dup_group, group_size FROM one")
def one_per_group(spark, sf_dir):
    _, seasons, groups, _ = relations(spark, sf_dir)
    return pool.one_per_group(seasons, groups)


@query("exact_dedup", "", "SELECT sha256(coalesce(text, '')) AS text_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def exact_dedup(spark, sf_dir):
    return pool.exact_dedup(table(spark, sf_dir, "documents"))


# ---- sample and packets ------------------------------------------------------------------------

@query("stratified_draw", S.SAMPLE, "SELECT record_id, url, scan_date, country, season, phase, year, bucket, reason, near_dup_group, group_size, ordinal, CAST(pos AS INT) AS pos FROM sample")
def stratified_draw(spark, sf_dir):
    return sample(spark, sf_dir).select(*sampling.COLUMNS, "ordinal", "pos")


@query("sample_by_cell", S.SAMPLE, "SELECT bucket, country, season, phase, count(*) AS n FROM sample GROUP BY ALL")
def sample_by_cell(spark, sf_dir):
    return sample(spark, sf_dir).groupBy("bucket", *sampling.CELL).agg(F.count("*").alias("n"))


@query("sample_report", S.SAMPLE, "SELECT country, count(*) AS n FROM sample GROUP BY country")
def sample_report(spark, sf_dir):
    return sampling.frequency(sample(spark, sf_dir), "country")


@query("deal_packets", S.PACKETS, "SELECT record_id, bucket, owner, packet_pos FROM dealt")
def deal_packets(spark, sf_dir):
    return dealt(spark, sf_dir).select("record_id", "bucket", "owner", "packet_pos")


_LABELER = "['labeler_1', 'labeler_2', 'labeler_3', 'labeler_4']"


@query("packet_mix", S.PACKETS, f"SELECT {_LABELER}[owner + 1] AS labeler, count(*) AS n, count(*) FILTER (side) AS useful, count(*) FILTER (pilot) AS pilots FROM dealt GROUP BY owner")
def packet_mix(spark, sf_dir):
    return packets.packet_mix(dealt(spark, sf_dir))


@query("pilot_pick", S.PACKETS, "SELECT record_id, owner, pilot_pos FROM dealt WHERE pilot")
def pilot_pick(spark, sf_dir):
    return dealt(spark, sf_dir).where("pilot").select("record_id", "owner", "pilot_pos")


@query("packet_sheet_rows", S.PACKETS, f"""SELECT CAST(row_number() OVER (PARTITION BY labeler ORDER BY part, pos_) AS INT) AS "row", round, article_id, link, scan_date, labeler FROM (
  SELECT record_id AS article_id, url AS link, scan_date, {_LABELER}[owner + 1] AS labeler, CASE WHEN pilot THEN '1-own' ELSE '2' END AS round, CASE WHEN pilot THEN 1 ELSE 3 END AS part, CASE WHEN pilot THEN pilot_pos ELSE packet_pos END AS pos_ FROM dealt
  UNION ALL SELECT record_id, url, scan_date, {_LABELER}[(owner + 3) % 4 + 1], '1-check-' || {_LABELER}[owner + 1], 2, pilot_pos FROM dealt WHERE pilot)""")
def packet_sheet_rows(spark, sf_dir):
    return packets.sheets(dealt(spark, sf_dir))


@query("assignment_key", S.PACKETS, f"SELECT record_id AS article_id, {_LABELER}[owner + 1] AS owner, pilot, CASE WHEN pilot THEN {_LABELER}[(owner + 3) % 4 + 1] ELSE '' END AS checked_by, bucket FROM dealt")
def assignment_key(spark, sf_dir):
    return packets.assignment_key(dealt(spark, sf_dir))


# ---- statements --------------------------------------------------------------------------------

@query("weekly_new_cases", _ITEMS, "SELECT CAST(date_trunc('week', start_date) AS DATE) AS week, country, state, city, kind, coalesce(sum(number) FILTER (total_or_new = 'new'), 0)::BIGINT AS new_number, count(number) FILTER (total_or_new = 'new') AS n_items FROM items GROUP BY ALL")
def weekly_new_cases(spark, sf_dir):
    return statements.weekly_new(_places(spark, sf_dir), ["country", "state", "city"])


@query("running_total_delta", _ITEMS, "SELECT event_id, country, state, kind, start_date, number, CAST(number - lag(number) OVER (PARTITION BY country, state, kind ORDER BY start_date, event_id) AS DOUBLE) AS change FROM items WHERE total_or_new = 'total'")
def running_total_delta(spark, sf_dir):
    return statements.total_changes(_places(spark, sf_dir), ["country", "state"], "event_id")


_WORDINGS = ["cases are rising", "Declining now", "at its peak", "widespread activity", "low activity", "unclear", "season is spreading"]


@query("trend_vocab", "", f"""SELECT event_id, words, CASE {" ".join(f"WHEN regexp_matches(lower(words), '{p}') THEN '{n}'" for n, p in statements.TREND_WORDS.items())} END AS trend
  FROM (SELECT event_id, {_WORDINGS}[CAST(event_id % {len(_WORDINGS)} + 1 AS INT)] AS words FROM events)""")
def trend_vocab(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(w) for w in _WORDINGS]), (F.pmod("event_id", F.lit(len(_WORDINGS))) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", words.alias("words")).withColumn("trend", statements.trend_word(F.col("words")))


@query("weekday_resolution", "", "SELECT event_id, CAST(CAST(ts AS DATE) - (CAST(isodow(ts) AS INT) % 7 + 1) AS DATE) AS saturday FROM events")
def weekday_resolution(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.last_weekday(F.to_date("ts"), "SAT").alias("saturday"))


@query("evidence_check", "", """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'no_reply' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'bad_kind' END,
    CASE WHEN doc_id % 5 <> 0 AND NOT contains(text, CASE WHEN doc_id % 3 = 0 THEN 'never said so, ever' ELSE substr(text, 2, 30) END) THEN 'invented_evidence' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents WHERE text IS NOT NULL""")
def evidence_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    quote = F.when(F.pmod("doc_id", F.lit(3)) == 0, "never said so, ever").otherwise(F.substring("text", 2, 30))
    item = F.struct(F.when(F.pmod("doc_id", F.lit(7)) == 0, "other kind").otherwise("cases").alias("kind"), F.lit(12).alias("number"), F.lit("USA").alias("country"), quote.alias("evidence"))
    reply = F.when(F.pmod("doc_id", F.lit(5)) == 0, "no json").otherwise(F.to_json(F.struct(F.lit(True).alias("useful"), F.array(item).alias("items"))))
    read = docs.select("doc_id", "text", statements.parsed(reply).alias("reply"))
    return read.select("doc_id", F.array_join(statements.reply_errors("reply", "text"), ",").alias("errors"))


_TIMES = ["on Saturday", "today", "yesterday", "this week", "last week", "since October", "since january", "between 1 and 5 January", "between 28 and 31 February", "Monday", "2024-01-09", "some time ago", "between 20 and 30 November"]
_DATES = f"""days AS (
  SELECT event_id, {_TIMES}[CAST(event_id % {len(_TIMES)} + 1 AS INT)] AS words, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) + 1 END AS day FROM events),
parts AS (
  SELECT *, lower(words) AS w, CAST(date_trunc('week', day) AS DATE) AS monday, list_position({statements.WEEKDAYS}, replace(lower(words), 'on ', '')) AS wd,
         list_position({statements.MONTHS}, replace(lower(words), 'since ', '')) AS since, list_position({statements.MONTHS}, regexp_extract(lower(words), '^between [0-9]+ and [0-9]+ (.*)$', 1)) AS mon,
         regexp_extract(words, '^between ([0-9]+)', 1) AS a, regexp_extract(words, 'and ([0-9]+) ', 1) AS b FROM days),
known AS (
  SELECT *, CASE WHEN make_date(year(day), coalesce(since, 1)::BIGINT, 1) <= day THEN year(day) ELSE year(day) - 1 END AS sy,
         CASE WHEN try_cast(printf('%04d-%02d-%02d', year(day), coalesce(mon, 1)::BIGINT, coalesce(try_cast(a AS BIGINT), 1)) AS DATE) <= day THEN year(day) ELSE year(day) - 1 END AS y FROM parts),
spans AS (
  SELECT *, try_cast(printf('%04d-%02d-%02d', y, coalesce(mon, 1)::BIGINT, coalesce(try_cast(a AS BIGINT), 1)) AS DATE) AS d1, try_cast(printf('%04d-%02d-%02d', y, coalesce(mon, 1)::BIGINT, coalesce(try_cast(b AS BIGINT), 1)) AS DATE) AS d2,
         day - CAST((isodow(day) - 1 - coalesce(wd, 1) + 7) % 7 + 1 AS INT) AS back FROM known)"""


@query("date_rules", _DATES, """SELECT event_id, words, coalesce(CAST(start_date AS VARCHAR), '') AS start_date, coalesce(CAST(end_date AS VARCHAR), '') AS end_date FROM (SELECT event_id, words, CASE WHEN w = 'today' THEN day WHEN w = 'yesterday' THEN day - 1 WHEN w = 'this week' THEN monday WHEN w = 'last week' THEN monday - 7 WHEN wd > 0 THEN back
    WHEN since > 0 THEN make_date(sy, since::BIGINT, 1) WHEN mon > 0 THEN CASE WHEN d1 <= d2 THEN d1 END ELSE try_cast(w AS DATE) END AS start_date,
  CASE WHEN w = 'today' THEN day WHEN w = 'yesterday' THEN day - 1 WHEN w = 'this week' THEN day WHEN w = 'last week' THEN monday - 1 WHEN wd > 0 THEN back
    WHEN since > 0 THEN day WHEN mon > 0 THEN CASE WHEN d1 <= d2 THEN d2 END ELSE try_cast(w AS DATE) END AS end_date FROM spans)""")
def date_rules(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(w) for w in _TIMES]), (F.pmod("event_id", F.lit(len(_TIMES))) + 1).cast("int"))
    day = F.to_date("ts")
    rows = table(spark, sf_dir, "events").select("event_id", words.alias("words"), F.when(F.pmod("event_id", F.lit(3)) != 0, day).alias("article_date"), F.date_add(day, 1).alias("scan_date"))
    return rows.select("event_id", "words", statements.resolved(F.col("words"), F.col("article_date"), F.col("scan_date")).alias("d")).select("event_id", "words", *[F.coalesce(F.col(f"d.{c}").cast("string"), F.lit("")).alias(c) for c in ("start_date", "end_date")])


@query("items_with_labels", _ITEMS, "SELECT event_id, article_id, kind, number, coalesce(CAST(useful AS VARCHAR), '') AS useful FROM items LEFT JOIN (SELECT doc_id AS article_id, quality = 1 AS useful FROM labels) USING (article_id)")
def items_with_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("useful"))
    return statements.items_with_labels(_places(spark, sf_dir), labels).select("event_id", "article_id", "kind", "number", F.coalesce(F.col("useful").cast("string"), F.lit("")).alias("useful"))


def _sheets(spark, sf_dir):
    """Filled sheets: every labeled document read by its owner, and again by the labeler before, who differs now and then."""
    q = F.col("quality") == 1
    name = lambda k: F.concat(F.lit("labeler_"), F.pmod(F.col("doc_id") + k, F.lit(4)) + 1)
    rows = table(spark, sf_dir, "labels").select("doc_id", q.alias("q"))
    own = rows.select(F.col("doc_id").alias("article_id"), name(0).alias("labeler"), F.lit("1-own").alias("round"), F.col("q").alias("useful"))
    check = rows.select(F.col("doc_id").alias("article_id"), name(3).alias("labeler"), F.concat(F.lit("1-check-"), name(0)).alias("round"), F.when(F.pmod("doc_id", F.lit(10)) == 0, ~F.col("q")).otherwise(F.col("q")).alias("useful"))
    return own.unionByName(check)


_PAIRS = """sheets AS (
  SELECT doc_id AS article_id, 'labeler_' || (doc_id % 4 + 1) AS labeler, '1-own' AS round, quality = 1 AS useful FROM labels
  UNION ALL SELECT doc_id, 'labeler_' || ((doc_id + 3) % 4 + 1), '1-check-labeler_' || (doc_id % 4 + 1), CASE WHEN doc_id % 10 = 0 THEN quality <> 1 ELSE quality = 1 END FROM labels),
pairs AS (
  SELECT a.article_id, a.labeler AS owner, b.labeler AS checker, a.useful AS owner_useful, b.useful AS checker_useful
  FROM sheets a JOIN sheets b USING (article_id) WHERE a.round = '1-own' AND b.round LIKE '1-check-%')"""


@query("double_labels", _PAIRS, "SELECT * FROM pairs")
def double_labels(spark, sf_dir):
    return statements.double_labels(_sheets(spark, sf_dir))


@query("label_confusion", _PAIRS, "SELECT owner_useful, checker_useful, count(*) AS n FROM pairs GROUP BY ALL")
def label_confusion(spark, sf_dir):
    return statements.confusion(double_labels(spark, sf_dir), "owner_useful", "checker_useful")


@query("label_agreement", _PAIRS, """SELECT n, CAST(same AS BIGINT) AS same, round(same / n, 6) AS observed, round(CASE WHEN pe < 1 THEN (same / n - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM (
  SELECT *, (a * b + (n - a) * (n - b)) / (n * n) AS pe FROM (SELECT count(*) AS n, count(*) FILTER (owner_useful = checker_useful) AS same, count(*) FILTER (owner_useful) AS a, count(*) FILTER (checker_useful) AS b FROM pairs))""")
def label_agreement(spark, sf_dir):
    return statements.agreement(double_labels(spark, sf_dir), "owner_useful", "checker_useful")


def _printed(rows, columns):
    """rows with those columns as text, nulls empty."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


@query("useful_outcomes", """answers AS (
  SELECT article_id, h.useful AS human_useful, m.useful AS model_useful FROM (SELECT doc_id AS article_id, quality = 1 AS useful FROM labels WHERE doc_id % 9 <> 0) h
  FULL JOIN (SELECT doc_id AS article_id, CASE WHEN doc_id % 7 = 0 THEN quality <> 1 ELSE quality = 1 END AS useful FROM labels WHERE doc_id % 8 <> 0) m USING (article_id))""",
       "SELECT article_id, coalesce(CAST(human_useful AS VARCHAR), '') AS human_useful, coalesce(CAST(model_useful AS VARCHAR), '') AS model_useful, CASE WHEN human_useful IS NULL THEN 'no_label' WHEN model_useful IS NULL THEN 'no_answer' WHEN human_useful = model_useful THEN 'right' ELSE 'wrong_useful' END AS outcome FROM answers")
def useful_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("useful"))
    human = rows.where("article_id % 9 <> 0")
    model = rows.where("article_id % 8 <> 0").withColumn("useful", F.when(F.pmod("article_id", F.lit(7)) == 0, ~F.col("useful")).otherwise(F.col("useful")))
    return _printed(statements.compare_useful(human, model), ["human_useful", "model_useful"])


_SIDES = f"""{_ITEMS},
human AS (SELECT *, row_number() OVER (PARTITION BY article_id, kind, total_or_new, country, state, city ORDER BY start_date, number, end_date) AS nth FROM items WHERE event_id % 13 <> 0),
answered AS (
  SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN number + 5 ELSE number END AS number, CASE WHEN event_id % 7 = 0 THEN start_date + 1 ELSE start_date END AS start_date, CASE WHEN event_id % 7 = 0 THEN end_date + 1 ELSE end_date END AS end_date) FROM items WHERE event_id % 11 <> 0),
model AS (SELECT *, row_number() OVER (PARTITION BY article_id, kind, total_or_new, country, state, city ORDER BY start_date, number, end_date) AS nth FROM answered)"""


@query("item_outcomes", _SIDES, """SELECT article_id, kind, total_or_new, country, state, city, nth::INT AS nth, coalesce(CAST(h.number AS VARCHAR), '') AS human_number, coalesce(CAST(m.number AS VARCHAR), '') AS model_number, coalesce(CAST(h.start_date AS VARCHAR), '') AS human_start_date, coalesce(CAST(m.start_date AS VARCHAR), '') AS model_start_date,
  CASE WHEN m.event_id IS NULL THEN 'missed_item' WHEN h.event_id IS NULL THEN 'invented_item' WHEN h.number IS DISTINCT FROM m.number THEN 'wrong_number' WHEN h.start_date <> m.start_date OR h.end_date <> m.end_date THEN 'wrong_date' ELSE 'right' END AS outcome
  FROM human h FULL JOIN model m USING (article_id, kind, total_or_new, country, state, city, nth)""")
def item_outcomes(spark, sf_dir):
    items = _places(spark, sf_dir)
    seventh = F.pmod("event_id", F.lit(7)) == 0
    model = items.where("event_id % 11 <> 0").withColumns({"number": F.when(F.pmod("event_id", F.lit(17)) == 0, F.col("number") + 5).otherwise(F.col("number")), **{c: F.when(seventh, F.date_add(c, 1)).otherwise(F.col(c)) for c in ("start_date", "end_date")}})
    return _printed(statements.compare_items(items.where("event_id % 13 <> 0"), model), ["human_number", "model_number", "human_start_date", "model_start_date"])


_INSTRUCTIONS, _EXAMPLES = "You read one news article.", [statements.example("2016-02-08", "20 flu cases today.", '{"useful": true}'), statements.example("2016-02-09", "Old news.", '{"useful": false}')]


@query("prompt_text", "", "SELECT d.doc_id, md5('" + "\n\n".join([_INSTRUCTIONS, *_EXAMPLES]) + "' || chr(10) || chr(10) || 'Scan date: ' || (DATE '2016-01-01' + CAST(d.doc_id % 300 AS INT)) || chr(10) || 'Article:' || chr(10) || coalesce(text, '')) AS prompt_md5 FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id")
def prompt_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    ready = docs.select("doc_id", "text", F.date_add(F.lit("2016-01-01").cast("date"), F.pmod("doc_id", F.lit(300)).cast("int")).alias("scan_date"))
    return ready.select("doc_id", F.md5(statements.prompt(_INSTRUCTIONS, _EXAMPLES)).alias("prompt_md5"))


@query("pool_weighted_rate", S.SAMPLE, """SELECT round(sum(n * positive / drawn) / sum(n), 6) AS rate, CAST(sum(n) AS BIGINT) AS n, CAST(sum(drawn) AS BIGINT) AS drawn FROM (
  SELECT name, count(*) AS n FROM qn SEMI JOIN quotas USING (name) GROUP BY name) JOIN (SELECT name, count(*) AS drawn, count(*) FILTER (phase = 'late') AS positive FROM sample GROUP BY name) USING (name)""")
def pool_weighted_rate(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return sampling.pool_rate(sampling.draw(rows).withColumn("late", F.col("phase") == "late"), rows, "late")


@query("pool_cell_rate", S.SAMPLE, """SELECT round(sum(n * positive / drawn) / sum(n) FILTER (drawn > 0), 6) AS rate, round(sum(n) FILTER (drawn > 0) / sum(n), 6) AS covered, CAST(sum(n) AS BIGINT) AS n, CAST(sum(drawn) AS BIGINT) AS drawn FROM (
  SELECT name, country, season, phase, count(*) AS n FROM qn GROUP BY ALL) LEFT JOIN (SELECT name, country, season, phase, count(*) AS drawn, count(*) FILTER (year = 2016) AS positive FROM sample GROUP BY ALL) USING (name, country, season, phase)""")
def pool_cell_rate(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return sampling.cell_rate(sampling.draw(rows).withColumn("hit", F.col("year") == 2016), rows, "hit")


@query("season_split", S.SAMPLE, "SELECT record_id, season, CASE WHEN season IN ('USA-2016', 'India-2017') THEN 'test' ELSE 'dev' END AS split FROM sample")
def season_split(spark, sf_dir):
    return statements.season_split(sample(spark, sf_dir), ["USA-2016", "India-2017"]).select("record_id", "season", "split")
