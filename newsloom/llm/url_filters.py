"""URL filters: a temporal join of captures with dated lists.

List entries (list, kind, pattern, action, verdict, at) are dated: `add` opens and `remove` closes an
entry. A window over each entry's history turns them into validity intervals [from, to); the
intervals of one pattern are gathered in one row, so that a capture meets a pattern once and never a
pair for each interval. A capture's URL gives its candidate patterns (host, parent domains, path
prefixes), which join the lists by equality; the entry that is active at fetch time is found as of
that time.

The verdict is that of the most specific active entry: longest path, then host, then the longest
domain; among equals `block` wins over `allow`. No active entry: `pass`.

Defined results: a null or unparsable URL, or a null fetch time, passes; repeated list entries count
once; a removal without an addition has no effect; of events at one time the removal acts last; empty
lists pass everything; repeated captures are judged one by one; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import table, without

RANK = {"path": 3, "host": 2, "domain": 1}


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, verdict, valid_from, valid_to) from dated additions and removals; open ends are null."""
    keys = ["list", "kind", "pattern", "verdict"]
    events = entries.select(*keys, "action", "at").where("at is not null and pattern is not null").distinct()
    order = Window.partitionBy(*keys).orderBy("at", F.when(F.col("action") == "add", 0).otherwise(1))
    spans = events.withColumn("valid_to", F.lead("at").over(order)).where("action = 'add'")
    return spans.select(*keys, F.col("at").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")


def parts(url):
    """(host, path) of a URL column: host in lower case without user, port and trailing dot."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#?]*)", 1)
    authority = F.regexp_extract(rest, r"^([^/]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r"(:[0-9]*)?\.?$", "")
    return host, F.regexp_extract(rest, r"^[^/]*(/.*)$", 1)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", key: list[str] | None = None) -> DataFrame:
    """captures with host, verdict, rule (kind:pattern), list and active_since."""
    added = ["host", "verdict", "rule", "list", "active_since"]
    captures = without(captures, *added, "_cand", "_best")
    host, path = parts(F.col(url))
    # one row a pattern: its history, which is as long as its list's edits of it
    history = validity(entries).groupBy("kind", "pattern").agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "verdict", "list"))).alias("spans"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    domains = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern"))))
    steps = F.filter(F.split("_path", "/"), lambda s: s != "")
    paths = F.when((F.col("host") != "") & (F.size(steps) > 0), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("path").alias("kind"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern"))))
    hosts = F.when(F.col("host") != "", F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"))))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    known = captures.withColumns({"host": F.coalesce(host, F.lit("")), "_path": F.coalesce(path, F.lit(""))})
    # hosts repeat: patterns are looked up once for each distinct host and path of the captures' site keys
    asked = known.select("host", "_path", F.col(fetched).alias("_t")).where("host <> '' and _t is not null").distinct()
    asked = asked.withColumn("_cand", F.explode(F.concat(F.coalesce(domains, none), F.coalesce(hosts, none), F.coalesce(paths, none))))
    asked = asked.select("host", "_path", "_t", F.col("_cand.kind").alias("kind"), F.col("_cand.pattern").alias("pattern"))
    met = asked.join(history, ["kind", "pattern"])
    active = F.filter("spans", lambda s: (s["valid_from"] <= F.col("_t")) & (s["valid_to"].isNull() | (s["valid_to"] > F.col("_t"))))
    met = met.withColumn("_on", active).where(F.size("_on") > 0)
    rank = F.when(F.col("kind") == "path", RANK["path"]).when(F.col("kind") == "host", RANK["host"]).otherwise(RANK["domain"])
    first = F.array_min(F.transform("_on", lambda s: F.struct(F.when(s["verdict"] == "block", 0).otherwise(1).alias("o"), s["list"].alias("list"), s["valid_from"].alias("since"), s["verdict"].alias("verdict"))))
    met = met.withColumn("_first", first)
    best = met.groupBy("host", "_path", "_t").agg(F.min(F.struct((-rank).alias("a"), (-F.length("pattern")).alias("b"), F.col("_first.o").alias("o"), F.col("_first.list").alias("list"), F.col("_first.since").alias("since"), F.col("_first.verdict").alias("verdict"), "kind", "pattern")).alias("m"))
    best = best.select(F.col("host").alias("_h"), F.col("_path").alias("_p"), F.col("_t").alias("_f"), "m")
    out = known.join(best, (known["host"] == best["_h"]) & (known["_path"] == best["_p"]) & (known[fetched] == best["_f"]), "left")
    return out.select(*captures.columns, "host", F.coalesce("m.verdict", F.lit("pass")).alias("verdict"), F.concat_ws(":", "m.kind", "m.pattern").alias("rule"), F.col("m.list").alias("list"), F.col("m.since").alias("active_since"))


def _day(seed: str, of, days: int):
    """A day of 2024 from a hash that both engines have."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(seed), of)), 1, 6), 16, 10).cast("int")
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(number, F.lit(days)).cast("int"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """Dated lists over the hosts of the pages: every host and its parent domain come, go and come again."""
    host, _ = parts(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    named = [(F.lit("domain"), parent), (F.lit("host"), F.col("host")), (F.lit("path"), F.concat("host", F.lit("/en")))]
    every = hosts.select(F.explode(F.array(*[F.struct(k.alias("kind"), p.alias("pattern")) for k, p in named])).alias("e")).select("e.*").where("pattern <> ''").distinct()
    bit = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("v"), "pattern")), 1, 6), 16, 10).cast("int"), F.lit(3))
    every = every.withColumns({"list": F.concat(F.lit("list_"), "kind"), "verdict": F.when(bit == 0, "allow").otherwise("block")})
    dates = [("add", "a", 120), ("remove", "r", 240), ("add", "b", 360)]
    events = F.array(*[F.struct(F.lit(action).alias("action"), _day(seed, F.col("pattern"), days).alias("at")) for action, seed, days in dates])
    return every.withColumn("_e", F.explode(events)).select("list", "kind", "pattern", "verdict", "_e.action", "_e.at")


def op2(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day("f", F.col("page_id").cast("string"), 366))
    out = filter_urls(captures, demo_entries(pages))
    return out.select("page_id", F.col("fetched_at").cast("string").alias("fetched_at"), "host", "verdict", "rule", F.coalesce("list", F.lit("")).alias("list"), F.coalesce(F.col("active_since").cast("string"), F.lit("")).alias("active_since"))


SQL = r"""
WITH cap AS (
  SELECT page_id, DATE '2024-01-01' + ((('0x' || substr(md5('f' || page_id), 1, 6))::INT) % 366) AS fetched_at, coalesce(url, '') AS url,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^#?]*)', 1) AS rest
  FROM pages),
c AS (
  SELECT page_id, fetched_at, regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/]*)', 1), '^.*@', '')), '(:[0-9]*)?\.?$', '') AS host,
         regexp_extract(rest, '^[^/]*(/.*)$', 1) AS path
  FROM cap),
hosts AS (SELECT DISTINCT host FROM c WHERE host <> ''),
pats AS (
  SELECT DISTINCT 'domain' AS kind, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS pattern FROM hosts WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
  UNION ALL SELECT 'host', host FROM hosts
  UNION ALL SELECT 'path', host || '/en' FROM hosts),
ent AS (
  SELECT kind, pattern, 'list_' || kind AS list, CASE WHEN (('0x' || substr(md5('v' || pattern), 1, 6))::INT) % 3 = 0 THEN 'allow' ELSE 'block' END AS verdict, act AS action,
         DATE '2024-01-01' + ((('0x' || substr(md5(seed || pattern), 1, 6))::INT) % days) AS d0
  FROM pats, (VALUES ('add', 'a', 120), ('remove', 'r', 240), ('add', 'b', 360)) v(act, seed, days)),
spans AS (
  SELECT * FROM (
    SELECT *, lead(d0) OVER (PARTITION BY list, kind, pattern, verdict ORDER BY d0, CASE WHEN action = 'add' THEN 0 ELSE 1 END) AS valid_to
    FROM (SELECT DISTINCT list, kind, pattern, verdict, action, d0 FROM ent))
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > d0)),
hit AS (
  SELECT c.page_id, s.*, row_number() OVER (PARTITION BY c.page_id ORDER BY
      CASE s.kind WHEN 'path' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(s.pattern) DESC, CASE WHEN s.verdict = 'block' THEN 0 ELSE 1 END, s.list, s.d0) AS k
  FROM c JOIN spans s ON c.fetched_at >= s.d0 AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to) AND c.host <> ''
   AND ((s.kind = 'host' AND s.pattern = c.host)
     OR (s.kind = 'domain' AND (s.pattern = c.host OR ends_with(c.host, '.' || s.pattern)))
     OR (s.kind = 'path' AND starts_with(c.host || regexp_replace(c.path, '/+', '/', 'g') || '/', s.pattern || '/'))))
SELECT c.page_id, CAST(CAST(c.fetched_at AS DATE) AS VARCHAR) AS fetched_at, c.host, coalesce(h.verdict, 'pass') AS verdict, coalesce(h.kind || ':' || h.pattern, '') AS rule, coalesce(h.list, '') AS list, coalesce(CAST(CAST(h.d0 AS DATE) AS VARCHAR), '') AS active_since
FROM c LEFT JOIN hit h ON h.page_id = c.page_id AND h.k = 1
"""
