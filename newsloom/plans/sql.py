"""The SQL twins' shared parts: the article pool, the sentence table, the features and the buckets."""

from __future__ import annotations

from newsloom.functions.lexicon import sql_count, sql_match
from newsloom.operators.classify import REASONS
from newsloom.operators.sampling import JUNK, QUOTAS
from newsloom.sources.adapter import SQL as ADAPTER

ARTICLES = f"""{ADAPTER},
elig AS (SELECT * FROM seasons WHERE coalesce(sampling_season, '') <> ''),
one AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT g.*, row_number() OVER (PARTITION BY near_dup_group ORDER BY md5('42:pick:' || g.gkg_record_id), g.gkg_record_id) AS k
    FROM grp g SEMI JOIN elig USING (gkg_record_id)) WHERE k = 1),
art AS (
  SELECT p.gkg_record_id AS record_id, p.url, substr(p.datetime, 1, 10) AS scan_date, CAST(substr(p.datetime, 1, 4) AS INT) AS year, p.article AS text,
         e.sampling_country AS country, e.sampling_season AS season,
         CASE WHEN d >= 0 THEN 'post' WHEN d >= -35 THEN 'late' ELSE 'early' END AS phase, o.near_dup_group, o.group_size
  FROM (SELECT pool.*, CAST(substr(datetime, 1, 10) AS DATE) - onset_date AS d FROM pool JOIN elig USING (gkg_record_id) JOIN win ON season_id = sampling_season) p
  JOIN elig e USING (gkg_record_id) JOIN one o USING (gkg_record_id))"""

FEATURES = f"""{ARTICLES},
junk AS (
  SELECT record_id, year, length(norm) AS n_norm, {sql_match("SPAM", "norm")} AS is_spam, length(regexp_replace(norm, '[^0-9]', '', 'g')) AS n_digits,
         {sql_count("DATE_HEAD", "norm")} AS n_dated, {sql_count("FLU", "norm")} AS n_flu, {sql_count("ANIMAL_TERMS", "norm")} AS n_animal
  FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm FROM art)),
sent AS (
  SELECT *, flu OR coalesce(lag(flu) OVER w, false) OR coalesce(lead(flu) OVER w, false) AS near FROM (
    SELECT record_id, year, i, s, {sql_match("FLU", "s")} AS flu FROM (
      SELECT record_id, year, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (
        SELECT record_id, year, string_split(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM art))
    WHERE regexp_matches(s, '\\S'))
  WINDOW w AS (PARTITION BY record_id ORDER BY i)),
seen AS (
  SELECT *, {", ".join(f"near AND {sql_match(n, 's')} AS {n.lower()}" for n in ("CUR", "AWARE", "HYPO", "GENERIC", "RESEARCH", "BUSINESS"))},
         near AND {sql_match("HIST", "s")} AND NOT {sql_match("COMPARE", "s")} AS past, {sql_match("OTHER_DIS", "s")} AS other,
         near AND {sql_match("ANIMAL", "s")} AND NOT {sql_match("HUMAN", "s")} AS animal_only
  FROM sent),
walk AS (
  SELECT *, near AND NOT animal_only AND NOT (other AND NOT flu) AND NOT (research AND NOT cur) AS w,
         near AND ({sql_match("COUNT_A", "s")} OR {sql_match("COUNT_B", "s")} OR {sql_match("COUNT_C", "s")}) AS number, near AND {sql_match("SICK_NOW", "s")} AS sick
  FROM seen),
cases AS (
  SELECT *, w AND (number OR sick OR {sql_match("EVENT_C", "s")} OR ({sql_match("INDIVIDUAL", "s")} AND NOT aware AND NOT hypo AND NOT {sql_match("ADVICE", "s")})) AND NOT generic
           AND NOT (({sql_match("RATE", "s")} OR aware) AND NOT cur AND NOT sick) AS is_case
  FROM walk),
dated AS (
  SELECT *, is_case AND NOT cur AND (past OR {sql_match("DECADE", "s")}
      OR len(list_filter(regexp_extract_all(s, '\\b(19\\d\\d|20[01]\\d)\\b'), lambda y: CAST(y AS INT) <= year - 2)) > 0) AS old FROM cases),
sums AS (
  SELECT record_id, count(*) FILTER (other) AS other_disease, count(*) FILTER (flu) AS flu, count(*) FILTER (near) AS near,
         count(*) FILTER (flu AND {sql_match("IDIOM", "s")}) AS idiom, count(*) FILTER (flu AND research) AS research, count(*) FILTER (flu AND past) AS past,
         count(*) FILTER (flu AND business) AS business, count(*) FILTER (flu AND {sql_match("POLICY", "s")}) AS policy, count(*) FILTER (flu AND aware) AS aware,
         count(*) FILTER (is_case AND NOT old AND number) AS numbered, count(*) FILTER (is_case AND NOT old AND NOT number) AS event, count(*) FILTER (old) AS history,
         count(*) FILTER (is_case AND NOT old AND cur) AS anchored,
         count(*) FILTER (w AND flu AND NOT business AND NOT past AND NOT {sql_match("SPORT", "s")} AND NOT ({sql_match("OLDYEAR", "s")} AND NOT cur)
           AND NOT {sql_match("NONFLU_EMERG", "s")} AND NOT {sql_match("NEG_EVID", "s")}
           AND ((NOT aware AND NOT generic AND NOT hypo AND NOT {sql_match("PHARMA", "s")} AND {sql_match("TREND_NEAR", "s")}) OR (NOT hypo AND {sql_match("STATUS", "s")}))) AS trend,
         count(*) FILTER (w AND {sql_match("RESPONSE", "s")}) AS response,
         count(*) FILTER (near AND {sql_match("ZOON_SUB", "s")} AND {sql_match("ZOON_HUM", "s")} AND NOT {sql_match("ZOON_NEG", "s")}) AS bird_flu_human
  FROM dated GROUP BY record_id),
feat AS (
  SELECT j.*, {", ".join(f"CASE WHEN passed THEN coalesce({n}, 0) ELSE 0 END AS {n}" for n in ("other_disease", "flu", "near", "idiom", "research", "past", "business", "policy", "aware", "numbered", "event", "history", "anchored", "trend", "response", "bird_flu_human"))}
  FROM (SELECT *, NOT is_spam AND n_norm >= 300 AND NOT (n_digits / nullif(n_norm, 0) > 0.05) AND n_dated < 6 AND n_flu > 0 AS passed FROM junk) j LEFT JOIN sums USING (record_id))"""

_STEPS = {
    "X_spam_stub": "is_spam", "X_too_short": "n_norm < 300", "X_listing_garbled": "n_digits / n_norm > 0.05 OR n_dated >= 6", "N_no_flu_text": "flu = 0",
    "Z_zoonotic_human": "n_animal / (n_flu + n_animal) >= 0.5 AND bird_flu_human > 0", "N_animal_flu": "n_animal / (n_flu + n_animal) >= 0.5", "N_flu_idiom": "idiom / flu >= 0.5",
    "N_other_disease": "other_disease > n_flu AND numbered + event + trend + response = 0",
    "P_A1_counts": "numbered + event > 0 AND (research / flu < 0.5 OR anchored > 0) AND numbered > 0", "P_A2_case_event": "numbered + event > 0 AND (research / flu < 0.5 OR anchored > 0)",
    "P_B_trend_response": "(trend > 0 OR response > 0) AND (research / flu < 0.5 OR trend > 0) AND past / flu < 0.5",
    "N_history_only": "past / flu >= 0.4 OR (history > 0 AND numbered + event = 0)", "N_research": "research / flu >= 0.4",
    "N_business_policy": "business / flu >= 0.3 OR policy / flu >= 0.4", "N_awareness": "aware / flu >= 0.3",
}
_CHAIN = " ".join(f"WHEN {c} THEN '{b}'" for b, c in _STEPS.items())

BUCKETS = f"""{FEATURES},
named AS (SELECT record_id, CASE {_CHAIN} ELSE 'N_other_flu_mention' END AS bucket FROM feat),
reasons AS (SELECT * FROM (VALUES {", ".join(f"('{b}', '{r}')" for b, r in REASONS.items())}) r(bucket, reason)),
bucketed AS (SELECT art.*, bucket, reason FROM art JOIN named USING (record_id) JOIN reasons USING (bucket)),
quotas AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', {q})" for i, (n, q) in enumerate(QUOTAS.items()))}) q(ordinal, name, quota)),
qn AS (SELECT *, CASE WHEN bucket IN ({", ".join(f"'{j}'" for j in JUNK)}) THEN 'JUNK' ELSE bucket END AS name FROM bucketed)"""

SAMPLE = f"""{BUCKETS},
turns AS (SELECT *, row_number() OVER (PARTITION BY name, country, season, phase ORDER BY md5('42:cell:' || record_id), record_id) AS turn FROM qn),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn, md5('42:order:' || name || ':' || country || ':' || season || ':' || phase), country, season, phase) AS pos FROM turns),
sample AS (SELECT p.*, ordinal FROM placed p JOIN quotas USING (name) WHERE pos <= quota)"""

PACKETS = f"""{SAMPLE},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY bsize DESC, bucket, md5('42:deal:' || record_id), record_id) - 1 AS rnk
  FROM (SELECT *, count(*) OVER (PARTITION BY bucket) AS bsize FROM sample)),
owned AS (SELECT *, CAST(rnk % 4 AS INT) AS owner, CAST(rnk // 4 + 1 AS INT) AS packet_pos, substr(bucket, 1, 1) IN ('P', 'Z') AS side FROM ranked),
queued AS (SELECT *, row_number() OVER (PARTITION BY owner, bucket ORDER BY packet_pos) AS r, count(*) OVER (PARTITION BY owner, bucket) AS bn FROM owned),
picked AS (SELECT *, row_number() OVER (PARTITION BY owner, side ORDER BY r, bn DESC, bucket) <= 10 AS pilot FROM queued),
dealt AS (SELECT *, CASE WHEN pilot THEN CAST(row_number() OVER (PARTITION BY owner, pilot ORDER BY md5('42:pilot:' || record_id), record_id) AS INT) END AS pilot_pos FROM picked)"""
