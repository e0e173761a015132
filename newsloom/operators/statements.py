"""Extracted statements: reply schema and checks, dates, trend words, weekly sums, agreement, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The domains of the reply's fields.
KINDS, STATUSES, COUNTING = ["cases", "deaths", "hospitalized", "trend", "other"], ["confirmed", "suspected"], ["total", "new"]
TREND_WORDS = {
    "rising": "ris(e|es|ing|en)|increas|surg|spik|climb|spread|grow|upward",
    "falling": "fall|declin|decreas|drop|eas(e|ing)|subsid|wan(e|ing)|slow",
    "peak": "peak|height|worst",
    "widespread": "widespread|epidemic|outbreak|everywhere|nationwide",
    "low": "low|quiet|mild|sporadic|minimal|few",
}


def item_type() -> str:
    fields = ["kind string", "number bigint", "status string", "total_or_new string", "city string", "state string", "country string", "start_date date", "end_date date", "words string", "evidence string"]
    return "array<struct<" + ",".join(f.replace(" ", ":") for f in fields) + ">>"


def parsed(reply: Column) -> Column:
    """A model's JSON reply as a struct; null where it is no JSON."""
    return F.from_json(reply, f"useful boolean, disease string, strain string, causes string, symptoms string, items {item_type()}", {"mode": "PERMISSIVE"})


def reply_errors(reply: str, text: str) -> Column:
    """Names of the checks that a parsed reply fails: structure, domains, and evidence that is not in the text."""
    r = F.col(reply)
    items = F.coalesce(r["items"], F.array().cast(item_type()))

    def bad(test):
        return F.exists(items, test)

    tests = {
        "no_reply": r.isNull() | r["useful"].isNull(),
        "not_useful_but_filled": ~r["useful"] & ((F.size(items) > 0) | F.coalesce(r["disease"], r["strain"], r["causes"], r["symptoms"]).isNotNull()),
        "bad_kind": bad(lambda i: i["kind"].isNull() | ~i["kind"].isin(KINDS)),
        "bad_status": bad(lambda i: i["status"].isNotNull() & ~i["status"].isin(STATUSES)),
        "bad_counting": bad(lambda i: i["total_or_new"].isNotNull() & ~i["total_or_new"].isin(COUNTING)),
        "no_country": bad(lambda i: F.coalesce(i["country"], F.lit("")) == ""),
        "dates_reversed": bad(lambda i: i["end_date"] < i["start_date"]),
        "invented_evidence": bad(lambda i: ~F.coalesce(F.contains(F.col(text), i["evidence"]), F.lit(False))),
    }
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()]), lambda x: x.isNotNull())


def trend_word(words: Column) -> Column:
    """The shortlist's word for a trend wording; null if none fits."""
    chain = None
    for name, pattern in TREND_WORDS.items():
        hit = F.lower(words).rlike(pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def weekly_new(items: DataFrame, place: list[str]) -> DataFrame:
    """Sums of new numbers by week (Monday) and place; running totals are never added."""
    new = F.when(F.col("total_or_new") == "new", F.col("number"))
    return items.groupBy(F.to_date(F.date_trunc("week", "start_date")).alias("week"), *place, "kind").agg(F.coalesce(F.sum(new), F.lit(0)).alias("new_number"), F.count(new).alias("n_items"))


def total_changes(items: DataFrame, place: list[str], key: str) -> DataFrame:
    """Running totals with the change from the place's previous one.

    Totals are compared inside their month; a month's first one takes the last of the place's month before, from a
    light table with one row a month. So a place that holds a third of all totals is not one task.
    """
    by = [*place, "kind"]
    totals = items.where("total_or_new = 'total'").select(key, *by, "start_date", "number").withColumn("_m", F.trunc("start_date", "month"))
    last = totals.groupBy(*by, "_m").agg(F.max_by("number", F.struct("start_date", key)).alias("_last"))
    before = last.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_m").alias("_n"), F.lag("_last").over(Window.partitionBy(*by).orderBy("_m")).alias("_before"))
    order = Window.partitionBy(*by, "_m").orderBy("start_date", key)
    inner = totals.withColumns({"_k": F.row_number().over(order), "_lag": F.lag("number").over(order)})
    on = inner["_m"].eqNullSafe(before["_n"])
    for c in by:
        on = on & inner[c].eqNullSafe(before[f"_{c}"])
    previous = F.when(F.col("_k") > 1, F.col("_lag")).otherwise(F.col("_before"))
    return inner.join(before, on).select(key, *by, "start_date", "number", (F.col("number") - previous).cast("double").alias("change"))


def items_with_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Every item with its article's useful flag; null where the article has no label (one row an article in labels)."""
    return items.join(labels.select("article_id", "useful"), "article_id", "left")


def double_labels(rows: DataFrame) -> DataFrame:
    """(article_id, owner, checker, owner_useful, checker_useful): the two readings of each article of the pilot.

    rows: filled sheets (article_id, labeler, round, useful); the owner's row has round 1-own, the checker's 1-check-*.
    """
    own = rows.where("round = '1-own'").select("article_id", F.col("labeler").alias("owner"), F.col("useful").alias("owner_useful"))
    check = rows.where("round like '1-check-%'").select("article_id", F.col("labeler").alias("checker"), F.col("useful").alias("checker_useful"))
    return own.join(check, "article_id")


def compare_useful(human: DataFrame, model: DataFrame) -> DataFrame:
    """(article_id, human_useful, model_useful, outcome) of a full outer join: right, wrong_useful, no_answer, no_label."""
    h, m = human.select("article_id", F.col("useful").alias("human_useful")), model.select("article_id", F.col("useful").alias("model_useful"))
    outcome = F.when(F.col("human_useful").isNull(), "no_label").when(F.col("model_useful").isNull(), "no_answer").when(F.col("human_useful") == F.col("model_useful"), "right").otherwise("wrong_useful")
    return h.join(m, "article_id", "full_outer").withColumn("outcome", outcome)


ITEM_KEY = ["article_id", "kind", "total_or_new", "country", "state", "city"]


def compare_items(human: DataFrame, model: DataFrame) -> DataFrame:
    """ITEM_KEY, nth, both numbers and start dates, and outcome: right, missed_item, invented_item, wrong_number, wrong_date.

    Items have no ids: the nth item of an article, kind, counting and place (null is equal to null), by start date, number and
    end date, is compared with the other side's nth. A wrong number is named before a wrong date.
    """
    def ranked(rows, side):
        order = Window.partitionBy(*ITEM_KEY).orderBy("start_date", "number", "end_date")
        return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in ITEM_KEY], F.row_number().over(order).alias(f"{side}_nth"), F.lit(True).alias(f"in_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in ("number", "start_date", "end_date")])

    h, m = ranked(human, "human"), ranked(model, "model")
    keys = [*ITEM_KEY, "nth"]
    on = F.lit(True)
    for c in keys:
        on = on & h[f"human_{c}"].eqNullSafe(m[f"model_{c}"])
    same = lambda c: F.col(f"human_{c}").eqNullSafe(F.col(f"model_{c}"))
    outcome = F.when(F.col("in_model").isNull(), "missed_item").when(F.col("in_human").isNull(), "invented_item").when(~same("number"), "wrong_number").when(~same("start_date") | ~same("end_date"), "wrong_date").otherwise("right")
    found = F.when(F.col("in_human"), F.struct(*[F.col(f"human_{c}").alias(c) for c in keys])).otherwise(F.struct(*[F.col(f"model_{c}").alias(c) for c in keys]))
    return h.join(m, on, "full_outer").select(found.alias("k"), "human_number", "model_number", "human_start_date", "model_start_date", outcome.alias("outcome")).select("k.*", "human_number", "model_number", "human_start_date", "model_start_date", "outcome")


# The names that times are written with.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def resolved(words: Column, article_date: Column, scan_date: Column) -> Column:
    """struct(start_date, end_date) of a wording of time, counted from the article's date, else the scan date.

    today, yesterday and "on Saturday" (the most recent one before the date) are single days. "this week" and "since
    October" are still going on: they end on the date; a month is the most recent one that has begun. "last week" is
    Monday to Sunday; "between 1 and 5 January" lies in the most recent year that doesn't begin it after the date. An
    ISO date stands for itself. Anything else, and days that no calendar has, leave both empty.
    """
    day, w = F.coalesce(article_date, scan_date), F.lower(F.trim(words))
    span = lambda a, b: F.struct(a.alias("start_date"), b.alias("end_date"))
    none = F.lit(None).cast("date")
    monday = F.to_date(F.date_trunc("week", day))
    weekday = F.regexp_extract(w, rf"^(?:on )?({'|'.join(WEEKDAYS)})$", 1)
    month = F.regexp_extract(w, rf"^since ({'|'.join(MONTHS)})$", 1)
    between = rf"^between ([0-9]{{1,2}}) and ([0-9]{{1,2}}) ({'|'.join(MONTHS)})$"
    iso = F.regexp_extract(w, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)

    def number(name):
        return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")

    def date(year, name, of_month):
        return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(number(name).cast("string"), 2, "0"), F.lpad(of_month, 2, "0")))

    def recent(name, of_month):
        """The year in which that day was last on or before the date."""
        return F.when(date(F.year(day), name, of_month) <= day, F.year(day)).otherwise(F.year(day) - 1)

    name, a, b = F.regexp_extract(w, between, 3), F.regexp_extract(w, between, 1), F.regexp_extract(w, between, 2)
    first, last = date(recent(name, a), name, a), date(recent(name, a), name, b)
    whole = first.isNotNull() & last.isNotNull() & (first <= last)
    back = F.pmod(F.weekday(day) - F.array_position(F.array(*[F.lit(x) for x in WEEKDAYS]), weekday).cast("int"), F.lit(7)) + 1
    that = F.date_sub(day, back.cast("int"))
    chain = F.when(w == "today", span(day, day)).when(w == "yesterday", span(F.date_sub(day, 1), F.date_sub(day, 1)))
    chain = chain.when(w == "this week", span(monday, day)).when(w == "last week", span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
    chain = chain.when(weekday != "", span(that, that))
    chain = chain.when(month != "", span(date(recent(month, F.lit("01")), month, F.lit("01")), day))
    chain = chain.when(name != "", span(F.when(whole, first), F.when(whole, last)))
    return chain.when(iso != "", span(F.try_to_date(iso), F.try_to_date(iso))).otherwise(span(none, none))


def confusion(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.groupBy(left, right).agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Observed agreement and Cohen's kappa of two yes-or-no columns."""
    x, y = F.col(left).cast("int"), F.col(right).cast("int")
    s = pairs.agg(F.count("*").alias("n"), F.sum((x == y).cast("int")).alias("same"), F.sum(x).alias("a"), F.sum(y).alias("b"))
    po = F.col("same") / F.col("n")
    pe = (F.col("a") * F.col("b") + (F.col("n") - F.col("a")) * (F.col("n") - F.col("b"))) / (F.col("n") * F.col("n"))
    return s.select("n", "same", F.round(po, 6).alias("observed"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"))


def example(scan_date: str, text: str, answer: str) -> str:
    """One example of the prompt, from a labeled article of the development set."""
    return f"<example>\nScan date: {scan_date}\nArticle:\n{text}\n\nAnswer:\n{answer}\n</example>"


def prompt(instructions: str, examples: list[str], scan_date: str = "scan_date", text: str = "text") -> Column:
    """The prompt for one article: instructions, examples, and the article with its scan date; null texts are empty."""
    head = "\n\n".join([instructions, *examples])
    return F.concat(F.lit(head + "\n\nScan date: "), F.coalesce(F.col(scan_date).cast("string"), F.lit("")), F.lit("\nArticle:\n"), F.coalesce(F.col(text), F.lit("")))


def season_split(rows: DataFrame, test_seasons: list[str]) -> DataFrame:
    """rows with split: whole seasons go to test, the others to dev."""
    return rows.withColumn("split", F.when(F.col("season").isin(test_seasons), "test").otherwise("dev"))
