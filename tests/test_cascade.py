import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import lexicon as L
from newsloom.functions import text as X
from newsloom.functions.screen import screened
from newsloom.operators import classify
from newsloom.sources.adapter import PHRASES

FILL = "The council met in the hall and spoke at length about the new road and the old bridge over the river. " * 4


def bucket(spark, texts, year=2016):
    rows = spark.createDataFrame([(i, t, year) for i, t in enumerate(texts)], "i int, text string, year int")
    return [r["bucket"] for r in classify.bucketed(rows).orderBy("i").collect()]


CASES = [
    ("P_A1_counts", PHRASES[0]), ("P_A2_case_event", PHRASES[1]), ("P_B_trend_response", PHRASES[2]), ("P_B_trend_response", PHRASES[3]), ("N_animal_flu", PHRASES[4]),
    ("N_animal_flu", PHRASES[5]), ("N_flu_idiom", PHRASES[6]), ("N_other_disease", PHRASES[7]), ("N_history_only", PHRASES[8]), ("N_history_only", PHRASES[9]), ("N_research", PHRASES[10]),
    ("N_business_policy", PHRASES[11]), ("N_business_policy", PHRASES[12]), ("N_awareness", PHRASES[13]), ("N_other_flu_mention", PHRASES[14]), ("X_spam_stub", PHRASES[15]),
    ("X_listing_garbled", PHRASES[16]), ("P_A2_case_event", PHRASES[17]), ("P_A1_counts", PHRASES[18]), ("N_no_flu_text", PHRASES[19]),
    ("P_B_trend_response", "Flu cases are rising faster than last year."), ("N_research", "The study followed 12 patients with flu."),
    ("N_other_flu_mention", "The Centers for Disease Control and Prevention named flu."), ("N_awareness", "Flu shots prevent flu."),
    ("Z_zoonotic_human", "Doctors reported 3 human cases of bird flu. Poultry was culled."), ("N_animal_flu", "There were no human cases of bird flu, and the poultry was culled."),
    ("N_other_flu_mention", "There is no evidence that flu activity is widespread. Flu was discussed."), ("N_other_flu_mention", "The football team said flu activity was rising among players. Flu again."),
    ("N_other_flu_mention", "Flu season usually peaks in February. Flu cases are usually rising then."), ("N_other_flu_mention", "Flu cases could rise if the weather stays cold. Flu might spread."),
    ("P_A2_case_event", "She was hospitalized with the flu. The singer left the hospital."), ("P_A1_counts", "The virus killed at least 30 people as flu spread this month."),
    ("N_history_only", "In the 1990s 40 people died of flu. The flu was severe then. Nobody spoke of flu for long."), ("N_other_flu_mention", "Zika and flu outbreaks are spreading. The flu is around. Polio came up."),
    ("P_B_trend_response", "Flu activity is rising sharply in the north. Get your flu shot. Tips on flu. More on flu."),
    ("P_A1_counts", "The flu came.\nDoctors confirmed 12 cases today.\nNothing more."), ("N_no_flu_text", "Doctors confirmed 12 cases today."),
]


def test_each_branch(spark):
    assert bucket(spark, [FILL + "\n" + t for _, t in CASES]) == [b for b, _ in CASES]


def test_ties(spark):
    flat = lambda n, tail="": ("word " * 200)[: n - len(tail)].rstrip() .ljust(n - len(tail), "x") + tail
    assert bucket(spark, [flat(299, " flu"), flat(300, " flu"), "", None]) == ["X_too_short", "N_other_flu_mention", "X_too_short", "X_too_short"]
    dated = lambda k: FILL + " flu " + "Jan 5, 2016 x " * k
    assert bucket(spark, [dated(5) + FILL * 3, dated(6) + FILL * 3]) == ["N_other_flu_mention", "X_listing_garbled"]
    assert bucket(spark, ["a" * 376 + " flu " + "1" * 19, "a" * 375 + " flu " + "1" * 20 + "", "a" * 374 + " flu " + "1" * 21]) == ["N_other_flu_mention", "N_other_flu_mention", "X_listing_garbled"]


def test_half_of_the_sentences(spark):
    two = "Researchers wrote about flu. The word flu appears here."
    assert bucket(spark, [FILL + "\n" + two]) == ["N_research"]
    assert bucket(spark, [FILL + "\nShe had stomach flu. The word flu appears here."]) == ["N_flu_idiom"]


def test_old_years_depend_on_the_scan_year(spark):
    t = FILL + "\nIn 2014 officials confirmed 12 flu cases."
    assert bucket(spark, [t], 2015) == ["P_A1_counts"]
    assert bucket(spark, [t], 2016) == ["N_history_only"]


def test_person_and_strain_in_one_sentence(spark):
    """The branch "a man ... bird flu" never matches in the reference's rules; a switch lets it."""
    rows = spark.createDataFrame([(FILL + "\nA man was infected with bird flu in the district.", 2016)], "text string, year int")
    assert classify.bucketed(rows).first()["bucket"] == "N_animal_flu"
    assert classify.bucketed(rows, rules=classify.Thresholds(wide_zoonotic=True)).first()["bucket"] == "Z_zoonotic_human"


def test_years_in_digits_of_other_scripts(spark):
    old = FILL + "\nIn 19٤٤ officials confirmed 12 flu cases."
    new = FILL + "\nIn 20१६ officials confirmed 12 flu cases."
    odd = FILL + "\nIn 19𝟒𝟖 officials confirmed 12 flu cases."
    assert bucket(spark, [old, new, odd]) == ["N_history_only", "P_A1_counts", "N_history_only"]


def test_the_cascade_is_spread_and_computed_once(spark):
    """Filters on the features stay above the cascade, and the pool's tasks are as many as the session's."""
    from newsloom.plans import registry
    rows = registry.articles(spark, "/root/testdata/sf0.001")
    plan = classify.bucketed(rows).where("bucket = 'P_A1_counts'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") and plan.count("Generate") == 1
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = {r[0] for r in classify.bucketed(rows).select(F.spark_partition_id()).collect()}
    assert len(parts) == n


@pytest.mark.parametrize("name", ["junk_short", "junk_listing", "junk_spam"])
def test_filters_on_features_do_not_repeat_the_text_work(spark, name):
    """White space is replaced at one place of the plan, above the joins that thin out the articles."""
    from newsloom.plans import registry
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"| [\x09-\x0d\x1c-\x20]+") == 1
    assert plan.index("Filter") < plan.index("Generate") < plan.index("Join")


@pytest.mark.parametrize("name", ["junk_short", "junk_listing", "junk_spam"])
def test_spam_is_searched_behind_its_beginnings(spark, name):
    """The dear pattern stands above the lower-case text, which is searched for plain beginnings first."""
    from newsloom.plans import registry
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?iU)ugbet") == 1
    assert plan.index(r"\Q404 not found\E") < plan.index("(?iU)ugbet") < plan.index("Generate")


def test_reason_and_input_columns(spark):
    rows = spark.createDataFrame([("x", "short", 2016, "old")], "record_id string, text string, year int, bucket string")
    r = classify.bucketed(rows).first()
    assert (r["bucket"], r["reason"], r["text"]) == ("X_too_short", "under 300 characters", "short")
    assert classify.bucketed(rows.limit(0)).count() == 0


SAMPLES = ["Flu cases rose to 1,200 on Monday, up from last year.", "and prevention of flu; Prevent it", "twelve of the patients", "twelve new flu patients", "café naïve fièvre ÉCOLE flu season", "In 1998 and 2013 and the 1990s, SARS.",
           "xem trực tiếp", "系统维护", "H5N1 infected a man in the district", "20 percent of students are sick", "No evidence of flu", "", "flu-like; influenza's", "the flu season is worse than usual", "Schools were shut", "ſhares of ﬂu K"]


def test_patterns_agree_with_the_other_language(spark):
    """Our Java patterns and the same patterns in Python's engine find the same texts."""
    names = [n for n in dir(L) if n.isupper() and n not in ("NUM", "VERB_AFTER", "TREND_UP", "TREND_DN", "PEAK", "ONSET", "EXTENT", "LOWQ", "QUIET", "EPI_N", "TREND_ANY", "SPACE", "SENTENCE", "DIGIT", "DECIMALS", "CASED", "MARK", "_SQL_REWRITES")]
    texts = SAMPLES + PHRASES
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", *[X.has(F.col("t"), n).alias(n) for n in names]).orderBy("i").collect()
    for n in names:
        p = re.compile(getattr(L, n), 0 if n in L.CASED else re.I)
        assert [r[n] for r in got] == [bool(p.search(t)) for t in texts], n


def test_search_by_starts_finds_the_same(spark):
    texts = SAMPLES + PHRASES + ["CASıNO", "CaSiNo", "a CFD b", "aCFDb", "PORN star", "porno", "xem trực nothing", "caſino", "access denied", "Access  denied"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.has(F.col("t"), "SPAM").alias("a"), (X.maybe(F.lower("t"), "SPAM") & X.has(F.col("t"), "SPAM")).alias("b"), *[(X.has(F.col("t"), n) & ~X.maybe(F.lower("t"), n)).alias(n) for n in ("FLU", "ANIMAL_TERMS", "OTHER_DIS")], (X.has(F.col("t"), "FLU") != X.flu_in(F.col("t"))).alias("c")).collect()
    assert not any(r[n] for r in rows for n in ("FLU", "ANIMAL_TERMS", "OTHER_DIS", "c"))
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and sum(r["a"] for r in rows) >= 7


def test_words_that_hold_a_disease_are_not_one(spark):
    """Beginnings of whole words count at the beginning of a word alone: else most texts would be searched for diseases."""
    no = ["farmers counted large numbers of raids after the football outbreak", "stb 5tb _tb étb", "aflu inh1n1", "chick duc"]
    yes = {"OTHER_DIS": ["tb", "a tb b", "x-aids", "(mers)", "\nrsv", "é tb", "①tb", "-ſars", "aİds"], "FLU": ["flu", "é-flu", "“h1n1”", "ınfluenza"], "ANIMAL_TERMS": ["ducks", "the\tflock", "chicKen", "ﬂ avian flu"]}
    for name, texts in yes.items():
        rows = spark.createDataFrame([(t,) for t in no + texts], "t string").select(X.maybe(F.lower("t"), name).alias("m"), X.has(F.col("t"), name).alias("h")).collect()
        assert not any(r["h"] and not r["m"] for r in rows), name
        assert [r["m"] for r in rows] == [False] * len(no) + [True] * len(texts), name


def test_counts_of_words_are_those_of_the_patterns(spark):
    """ASCII texts are counted in lower case without flags, others as they are."""
    texts = SAMPLES + PHRASES + ["FLU Flu fluent aflu flu_ flu-flu H1N1h1n1 h1n1 BIRD FLU bird  flu Avian Influenza", "ﬂu Flu ſwine flu", "é flu INFLUENZA ıNFLUENZA", "DUCK ducks. Ducks' chickenpox Chickens CULLED culling", "canards, DUCKS é chicKens"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plan = classify.junk_features(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert L.low_ascii("FLU") in plan and L.low_ascii("ANIMAL_TERMS") in plan
    got = classify.junk_features(rows).select("n_flu", "n_animal", X.occurrences(F.col("norm"), "FLU").alias("f"), X.occurrences(F.col("norm"), "ANIMAL_TERMS").alias("a")).collect()
    assert [(r["n_flu"], r["n_animal"]) for r in got] == [(r["f"], r["a"]) for r in got] and sum(r["f"] for r in got) > 60 and sum(r["a"] for r in got) > 10


SENTENCE_NAMES = ["CUR", "AWARE", "HYPO", "GENERIC", "HIST", "COMPARE", "RESEARCH", "BUSINESS", "ANIMAL", "HUMAN", "ZOON_SUB", "ZOON_HUM", "ZOON_HUM_WIDE", "ZOON_NEG", "OTHER_DIS", "INDIVIDUAL", "ADVICE", "RATE", "EVENT_C",
                  "COUNT_A", "COUNT_B", "COUNT_C", "SICK_NOW", "SPORT", "NONFLU_EMERG", "NEG_EVID", "PHARMA", "TREND_NEAR", "STATUS", "IDIOM", "POLICY", "RESPONSE"]


def test_ascii_sentences_are_searched_in_lower_case(spark):
    """The patterns of the cascade's plan are those for lower case, and they find what the patterns themselves find."""
    texts = SAMPLES + PHRASES + [t for _, t in CASES] + ["1,200 NEW Patients; 5% per cent. (Monday) _monday xmonday", "And prevent, prevented", "a man with h5n1; a\tman\nof h5n1", "In the 1990S", "TO DATE\x1ftoday", "", "9", "per 100000", "é today", "today é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t, low = F.col("t"), F.lower("t")
    got = rows.select("t", *[F.struct(X.has(t, n), X.has_low(t, low, X.plain(t), n)).alias(n) for n in SENTENCE_NAMES]).collect()
    for n in SENTENCE_NAMES:
        assert all(a == b for a, b in (r[n] for r in got)), n
        assert L.low_search(n).endswith(getattr(L, n)) or L.low_search(n).endswith(f"(?:{getattr(L, n)})")
    plan = rows.select(classify.sentence_sums(t, F.lit(2016), F.lit(True)))._jdf.queryExecution().optimizedPlan().toString()
    assert all(L.low_search(n) in plan for n in ("TREND_NEAR", "COUNT_A", "CUR", "OTHER_DIS"))
    assert sum(L.low_search(n) != getattr(L, n) for n in SENTENCE_NAMES) == len(SENTENCE_NAMES) - 1  # all but SICK_NOW
    with pytest.raises(ValueError, match="case"):
        L.low_search("YEAR")


def test_plain_beginnings_of_patterns():
    assert L._prefixes(re._parser.parse(r"\b(?:a[bc]?d|x+|\dz|(?:no )?w\w)"), 3) == ({"abd", "acd", "ad", *[f"{i}z" for i in range(10)]} - {"abd", "acd"}, {"abd", "acd", "", "w", "no "})


def test_topics_are_counted_in_one_pass(spark):
    """The words found, joined, give the counts and the gate of the texts that they are from."""
    texts = [t for t in SAMPLES + PHRASES + [t for _, t in CASES] if t.isascii()] + ["Swine flu, swine-flu; bird flu bird flue avian avian flu avian influenza avian h5n1 bird", "TB strep HIV archive farmers yellow fever yellow whooping cough coughs", "bird flu flu bird\nflu", "ducks' chickens culled cull", "h5n2 h5n1 h1n1h1n1 h9n2 flu_ flu-flu"]
    rows = spark.createDataFrame([(FILL + t, 2016) for t in texts], "text string, year int")
    plan = classify.features(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(L.topic_words()) == 1
    got = classify.features(rows).select("text", "n_flu", "n_animal").collect()
    norm = X.normalised(F.col("text"))
    want = rows.select("text", X.occurrences(norm, "FLU").alias("n_flu"), X.occurrences(norm, "ANIMAL_TERMS").alias("n_animal")).collect()
    assert sorted(got) == sorted(want) and sum(r["n_animal"] for r in got) > 15
    found = rows.select(F.array_join(F.regexp_extract_all(F.lower(norm), F.lit(L.topic_words()), F.lit(0)), " ").alias("w"), X.has(norm, "OTHER_DIS").alias("d"))
    assert all(not r["d"] or r["m"] for r in found.select("d", F.col("w").rlike(L.word_beginnings("OTHER_DIS")).alias("m")).collect())


def test_sentences_near_flu_are_taken_by_their_places(spark):
    """No struct is made for a sentence that is not near a flu term."""
    texts = ["Flu.", "None.", "", " \n ", "A. B. Flu C. D. E. Flu F.", "Flu A. Flu B. C. D. E", "A. B. C. flu", "flu A. B. flu C. D. E. F. G. flu H. I"]
    rows = spark.createDataFrame([(t, 2016) for t in texts], "t string, year int").select("t", classify.sentence_sums(F.col("t"), F.col("year"), F.lit(True)).alias("sums"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", near, ") == 1  # that of the sums
    for r in rows.collect():
        here = ["flu" in s.lower() for s in re.split(r"(?<=[.!?])\s+|\n+", r["t"]) if s.strip()]
        near = [any(here[max(0, i - 1):i + 2]) for i in range(len(here))]
        assert (r["sums"]["flu"], r["sums"]["near"]) == (sum(here), sum(near)), r["t"]


ODD_TEXTS = ["İ flu ducks 2016", "ſ flu; 系统维护 é", "bird flu é ducks", "avian influenza é", "flu\x85 Next line é. Flu \x1c. Ebola.", "jan 5, 20१६ é flu " * 9, "Jan 5, 2016 é flu " * 7, "١٢٣" * 60 + " flu", "aCFDé CFD flu", "porné flu", "pornoé flu",
             "é casino flu", "xem trực tiếp flu", "Caſino flu", "flué ducké tb tbé", "bird\n \nflu\n\x0b\nducks", "bird\n\n flu. \t ducks.Poultry", "a.\x1cFlu one.\x1d\x1e 12 cases. Ebola", "flu \u3000 x. \u3000Flu", "bird\xa0flu é", "one.  \n\n  Two flu\n  lead\n3. Trail  \nflu season has begun",
             "", "  ", "\n\n", "flu", "flu ﬂu \u212a KELVIN", "duc\u212as flu", "ducks 1\u017f ſhingles flu\u0307", "1990S flu in 1990s", "20 flu² ③ cases é", "whooping\ncough flu", "yellow\n\nfever. flu", "mers farmers flu. no.no.Flu", "No ducks. No. No. None é. Flu. No. No. Measles"]


def test_screened_texts_give_the_features_of_whole_texts(spark):
    """What the linear-time searches say and leave out changes no feature: those of junk_features and the sums of whole texts."""
    texts = SAMPLES + PHRASES + ODD_TEXTS
    texts = texts + [FILL + "\n" + t for t in texts] + [f"{a} {FILL}{b} \u2028{c}" for a, b, c in zip(texts, texts[3:], texts[11:])]
    rows = spark.createDataFrame([(i, t, 2016) for i, t in enumerate(texts)], "i int, text string, year int").repartition(2)
    names = ["n_norm", "is_spam", "n_digits", "n_dated", "n_flu", "n_animal"]
    got = classify.features(rows).select("i", *names, "sums").orderBy("i").collect()
    want = classify.junk_features(rows).select("i", *names, classify.sentence_sums(F.col("text"), F.col("year"), F.lit(True)).alias("sums")).orderBy("i").collect()
    plan = classify.features(rows)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1
    empty = 0
    for g, w in zip(got, want, strict=True):
        assert g[:-1] == w[:-1], texts[g["i"]]
        passed = not w["is_spam"] and w["n_norm"] >= 300 and w["n_digits"] <= 0.05 * w["n_norm"] and w["n_dated"] < 6 and w["n_flu"]
        assert g["sums"] == w["sums"] if passed else not any(g["sums"]), texts[g["i"]]
        empty += not passed
    assert 100 < empty < len(texts) - 100


def test_screen_leaves_sentences_that_can_count(spark):
    texts = ["A. B. Flu C. D. E.\nF", "A. Measles. B. Ducks. C", "farmers. shelf-flush. flus", "", "é. B. C flué. D. E. F", "x \u212a. y. z", "Play at the CASINO."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", screened(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"]["near"] for r in rows] == ["B.\nFlu C.\nD.", "Measles.\nDucks.", "", "", "B.\nC flué.\nD.", "x \u212a. y. z", ""]
    assert [r["s"]["spam"] for r in rows] == [False] * 5 + [None, True] and [r["s"]["digits"] for r in rows] == [0, 0, 0, 0, None, None, 0]


def test_screen_looks_at_few_texts_at_a_time(spark, monkeypatch):
    """Pieces bound memory; they change no result, whatever mix of texts they hold."""
    import pyarrow as pa

    from newsloom.functions import screen
    texts = pa.array(ODD_TEXTS + PHRASES)
    whole = screen._looked_at()(texts)
    monkeypatch.setattr(screen, "PIECE", 60)
    assert screen._looked_at()(texts).equals(whole) and len(screen._looked_at()(texts[:0])) == 0


def test_sentences_digits_and_spaces(spark):
    texts = ["One. Two!  Three?\n\nFour", "a.b. c", "", " \n ", "x\x1cy.\x85z", "² ١٢ 12 ①"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select(X.sentences(F.col("t")).alias("s"), X.normalised(F.col("t")).alias("n"), X.digits(F.col("t")).alias("d")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r["s"] == [s for s in re.split(r"(?<=[.!?])\s+|\n+", t) if s.strip()]
        assert r["n"] == " ".join(t.split())
        assert r["d"] == sum(c.isdigit() for c in t)


@pytest.mark.parametrize(("days", "name"), [(-70, "early"), (-36, "early"), (-35, "late"), (-1, "late"), (0, "post"), (14, "post")])
def test_phase(spark, days, name):
    onset = F.lit("2020-03-02").cast("date")
    assert spark.range(1).select(X.phase(F.date_add(onset, days), onset).alias("p")).first()["p"] == name
