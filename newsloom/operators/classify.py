"""The sixteen-bucket cascade, as column expressions over the sentences of a text.

No row is exploded and nothing is shuffled: the flags of all sentences are summed in place, so the
cascade is one narrow projection at any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import digits, flu_in, has, has_low, let, maybe, normalised, occurrences, plain, sentences, year_number
from newsloom.functions import lexicon as L
from newsloom.functions.screen import screened


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 300
    max_digit_ratio: float = 0.05
    max_dated: int = 6
    animal: float = 0.5
    idiom: float = 0.5
    research_max: float = 0.5
    history_max: float = 0.5
    history_min: float = 0.4
    research_min: float = 0.4
    business_min: float = 0.3
    policy_min: float = 0.4
    aware_min: float = 0.3
    #: Let up to forty characters stand between a person and a bird-flu strain; the reference's rules do not.
    wide_zoonotic: bool = False


# Buckets and their reasons, in the order of the cascade.
REASONS = {
    "X_spam_stub": "spam, blocked page, paywall or site notice",
    "X_too_short": "under 300 characters",
    "X_listing_garbled": "many digits or many dated headlines (index page)",
    "N_no_flu_text": "no flu term anywhere in the text",
    "Z_zoonotic_human": "bird flu article with a human-case sentence",
    "N_animal_flu": "animal-flu terms dominate and no human cases",
    "N_flu_idiom": "stomach flu, man flu, dog flu or flu-trends",
    "N_other_disease": "another disease is mentioned more than flu",
    "P_A1_counts": "current numbered count (cases, deaths, patients)",
    "P_A2_case_event": "current case or death event without a number",
    "P_B_trend_response": "trend, onset, quiet-season or response statement",
    "N_history_only": "flu sentences are about past years",
    "N_research": "study, lab or research framing",
    "N_business_policy": "market, funding or regulation framing",
    "N_awareness": "vaccine, prevention or explainer wording",
    "N_other_flu_mention": "flu is mentioned but no pattern matched",
}

#: Sums over sentences: of all of them, of those with a flu term, of those near one, and of the evidence near flu terms.
EVIDENCE = ["idiom", "research", "past", "business", "policy", "aware", "numbered", "event", "history", "anchored", "trend", "response", "bird_flu_human"]
SUMS = ["other_disease", "flu", "near", *EVIDENCE]


def _flags(x: Column, year: Column, diseases: Column, rules: Thresholds) -> Column:
    """What one sentence near a flu term counts for, in the order of EVIDENCE. Conditions stand before dearer ones.

    x: the sentence s, whether it holds a flu term, its lower case and whether it is ASCII alone. A sentence without a flu
    term counts by a case, a response or bird flu alone: one that names none of them is not looked at further.
    """
    s, flu = x["s"], x["flu"]

    def found(name):
        return has(s, name) if name in L.CASED else has_low(s, x["low"], x["ascii"], name)

    base = F.struct(
        found("CUR").alias("cur"), found("AWARE").alias("aware"), found("HYPO").alias("hypo"), found("GENERIC").alias("generic"),
        (found("HIST") & ~found("COMPARE")).alias("past"), found("RESEARCH").alias("research"), found("BUSINESS").alias("business"))

    def full(b):
        animal_only = found("ANIMAL") & ~found("HUMAN")
        bird = found("ZOON_SUB") & found("ZOON_HUM_WIDE" if rules.wide_zoonotic else "ZOON_HUM") & ~found("ZOON_NEG")
        walked = ~(b["research"] & ~b["cur"]) & ~(~flu & diseases & found("OTHER_DIS")) & ~animal_only

        def evidence(w):
            def counted(c):
                number, sick = c["number"], c["sick"]
                person = found("INDIVIDUAL") & ~b["aware"] & ~b["hypo"] & ~found("ADVICE")
                rate = ~b["cur"] & ~sick & (b["aware"] | found("RATE"))
                case = w & (number | sick | found("EVENT_C") | person) & ~b["generic"] & ~rate
                years = F.regexp_extract_all(s, F.lit(L.java("YEAR")), F.lit(1))
                old = F.exists(years, lambda y: year_number(y) <= year - 2) | found("DECADE")
                return F.struct(case.alias("case"), number.alias("number"), (case & ~b["cur"] & (b["past"] | old)).alias("history"))

            number = w & (found("COUNT_A") | found("COUNT_B") | found("COUNT_C"))
            return let(F.struct(number.alias("number"), (w & found("SICK_NOW")).alias("sick")), counted)

        barred = b["business"] | found("SPORT") | b["past"] | (~b["cur"] & found("OLDYEAR")) | found("NONFLU_EMERG") | found("NEG_EVID")
        wording = ~(b["aware"] | b["generic"] | b["hypo"] | found("PHARMA")) & found("TREND_NEAR")
        trend = flu & ~barred & (wording | (~b["hypo"] & found("STATUS")))
        number = lambda c: c.cast("int")
        return let(walked, lambda w: let(evidence(w), lambda e: F.struct(
            number(flu & found("IDIOM")).alias("idiom"), number(flu & b["research"]).alias("research"),
            number(flu & b["past"]).alias("past"), number(flu & b["business"]).alias("business"), number(flu & found("POLICY")).alias("policy"), number(flu & b["aware"]).alias("aware"),
            number(e["case"] & ~e["history"] & e["number"]).alias("numbered"), number(e["case"] & ~e["history"] & ~e["number"]).alias("event"), number(e["history"]).alias("history"),
            number(e["case"] & ~e["history"] & b["cur"]).alias("anchored"), number(w & trend).alias("trend"), number(w & found("RESPONSE")).alias("response"), number(bird).alias("bird_flu_human"))))

    named = reduce(lambda a, n: a | found(n), ["COUNT_A", "COUNT_B", "COUNT_C", "SICK_NOW", "EVENT_C", "INDIVIDUAL", "RESPONSE", "ZOON_SUB"], flu)
    return F.when(named, let(base, full)).otherwise(F.struct(*[F.lit(0).alias(n) for n in EVIDENCE]))


def sentence_sums(text: Column, year: Column, diseases: Column, rules: Thresholds = Thresholds()) -> Column:
    """A struct of SUMS over a text's sentences; near: a flu term stands in the sentence or beside it.

    diseases: whether the text can name another disease at all. Evidence is looked for near flu terms alone.
    """
    zero = F.struct(*[F.lit(0).alias(n) for n in EVIDENCE])

    def summed(kept, flu):
        def near(f, i):
            return F.when(f | F.coalesce(F.get(flu, i - 1), F.lit(False)) | F.coalesce(F.get(flu, i + 1), F.lit(False)), i)

        def placed(i):
            return let(F.get(kept, i), lambda s: F.struct(s.alias("s"), F.get(flu, i).alias("flu"), F.lower(s).alias("low"), plain(s).alias("ascii")))

        def sums(near):
            flags = F.transform(near, lambda x: _flags(x, year, diseases, rules))
            return let(F.aggregate(flags, zero, lambda a, x: F.struct(*[(a[n] + x[n]).alias(n) for n in EVIDENCE])), lambda e: F.struct(
                F.when(diseases, F.size(F.filter(kept, lambda s: has_low(s, F.lower(s), plain(s), "OTHER_DIS")))).otherwise(0).alias("other_disease"),
                F.size(F.filter(flu, lambda f: f)).alias("flu"), F.size(near).alias("near"), *[e[n].alias(n) for n in EVIDENCE]))

        # places alone go through the filter: a few sentences of a text are near a flu term
        return let(F.transform(F.filter(F.transform(flu, near), lambda i: i.isNotNull()), placed), sums)

    return let(sentences(text), lambda kept: let(F.transform(kept, flu_in), lambda flu: summed(kept, flu)))


def junk_features(articles: DataFrame, text: str = "text") -> DataFrame:
    """Adds norm and the features of the first steps; text: null is empty.

    norm and its lower case come from generators of one row: they are computed once, and filters on features stay above
    them. Catalyst would else push the filters into the scan of all articles, where each search for a word would compute norm again.
    """
    filled = articles.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    norm = filled.select("*", F.explode(F.array(normalised(F.col(text)))).alias("norm"))
    rows = norm.select("*", F.explode(F.array(F.lower("norm"))).alias("_low"))
    t, low = F.col("norm"), F.col("_low")
    # one condition, not two joined by "and": of a filter, the dear half would be pushed below _low, to all texts
    spam = F.when(maybe(low, "SPAM"), has(t, "SPAM")).otherwise(False)
    dated = F.when(t.rlike(r"(?U)20\d\d"), occurrences(t, "DATE_HEAD")).otherwise(0)
    return rows.withColumns({"n_norm": F.length(t), "is_spam": spam, "n_digits": digits(t), "n_dated": dated, **_topics("_low")}).drop("_low")


def _topics(words: str) -> dict[str, Column]:
    """Counts of flu and animals in norm, and whether it can name another disease. words: what an ASCII text's are counted in."""
    t, low = F.col("norm"), F.col("_low")

    def counted(name):
        simple = F.regexp_count(words, F.lit(L.low_ascii(name))).cast("int")
        return F.when(plain(t), simple).when(maybe(low, name), occurrences(t, name)).otherwise(0)

    return {"n_flu": counted("FLU"), "n_animal": counted("ANIMAL_TERMS"), "_diseases": F.when(plain(t), F.col(words).rlike(L.word_beginnings("OTHER_DIS"))).otherwise(maybe(low, "OTHER_DIS"))}


def features(articles: DataFrame, text: str = "text", year: str = "year", rules: Thresholds = Thresholds()) -> DataFrame:
    """Adds the junk features and, for texts that pass them and name flu, the sentence sums (zeros else)."""
    filled = articles.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    # whole texts are searched in linear time; Java's patterns see what that leaves: the sentences that can count, and the texts it can't tell
    seen = filled.withColumn("_seen", screened(F.col(text))).withColumn("_near", F.col("_seen.near"))
    low = seen.withColumn("norm", normalised(F.col("_near"))).withColumn("_low", F.lower("norm"))
    # the words of all topics in one pass, not in one for each topic
    words = low.withColumn("_words", F.when(plain(F.col("norm")), F.array_join(F.regexp_extract_all("_low", F.lit(L.topic_words()), F.lit(0)), " ")))
    whole, known = normalised(F.col(text)), lambda name, other: F.coalesce(F.col(f"_seen.{name}"), other)
    f = words.withColumns({"n_norm": F.col("_seen.n_norm"), "is_spam": known("spam", has(whole, "SPAM")), "n_digits": known("digits", digits(F.col(text))),
                           "n_dated": known("dated", occurrences(whole, "DATE_HEAD")), **_topics("_words")})
    passed = ~F.col("is_spam") & (F.col("n_norm") >= rules.min_chars) & ~(F.try_divide("n_digits", "n_norm") > rules.max_digit_ratio) & (F.col("n_dated") < rules.max_dated) & (F.col("n_flu") > 0)
    zero = F.struct(*[F.lit(0).alias(n) for n in SUMS])
    # a generator of one row: the sums are computed once, and filters on them stay above it (else Catalyst would push the
    # whole cascade, twice, below the joins that thin out the articles)
    sums = F.when(passed, sentence_sums(F.col("_near"), F.col(year), F.col("_diseases"), rules)).otherwise(zero)
    return f.select(*[c for c in f.columns if c not in ("norm", "_diseases", "_seen", "_near", "_low", "_words")], F.explode(F.array(sums)).alias("sums"))


def bucket_of(rules: Thresholds = Thresholds()) -> Column:
    """struct(bucket, reason) from the columns of features(); the first rule that holds wins."""
    x = {n: F.col(f"sums.{n}") for n in SUMS}
    flu, n, chars = x["flu"], F.col("n_flu"), F.col("n_norm")
    current = x["numbered"] + x["event"]
    share = lambda name: F.try_divide(x[name], flu)
    quiet_research = share("research") < rules.research_max
    animal = F.try_divide("n_animal", n + F.col("n_animal")) >= rules.animal
    steps = [
        ("X_spam_stub", F.col("is_spam")),
        ("X_too_short", chars < rules.min_chars),
        ("X_listing_garbled", (F.try_divide("n_digits", chars) > rules.max_digit_ratio) | (F.col("n_dated") >= rules.max_dated)),
        ("N_no_flu_text", flu == 0),
        ("Z_zoonotic_human", animal & (x["bird_flu_human"] > 0)),
        ("N_animal_flu", animal),
        ("N_flu_idiom", share("idiom") >= rules.idiom),
        ("N_other_disease", (x["other_disease"] > n) & (current + x["trend"] + x["response"] == 0)),
        ("P_A1_counts", (current > 0) & (quiet_research | (x["anchored"] > 0)) & (x["numbered"] > 0)),
        ("P_A2_case_event", (current > 0) & (quiet_research | (x["anchored"] > 0))),
        ("P_B_trend_response", ((x["trend"] > 0) | (x["response"] > 0)) & (quiet_research | (x["trend"] > 0)) & (share("past") < rules.history_max)),
        ("N_history_only", (share("past") >= rules.history_min) | ((x["history"] > 0) & (current == 0))),
        ("N_research", share("research") >= rules.research_min),
        ("N_business_policy", (share("business") >= rules.business_min) | (share("policy") >= rules.policy_min)),
        ("N_awareness", share("aware") >= rules.aware_min),
    ]
    row = lambda b: F.struct(F.lit(b).alias("bucket"), F.lit(REASONS[b].replace("300", str(rules.min_chars))).alias("reason"))
    chain = None
    for name, holds in steps:
        chain = F.when(holds, row(name)) if chain is None else chain.when(holds, row(name))
    return chain.otherwise(row("N_other_flu_mention"))


def bucketed(articles: DataFrame, text: str = "text", year: str = "year", rules: Thresholds = Thresholds()) -> DataFrame:
    """articles with bucket and reason; the input's rows and columns stay as they are."""
    kept = articles.drop("bucket", "reason")
    b = features(kept.withColumn("_own", F.col(text)), "_own", year, rules).withColumn("_b", bucket_of(rules))
    return b.select(*kept.columns, "_b.bucket", "_b.reason")
