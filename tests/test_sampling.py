import csv
import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from newsloom import jobs
from newsloom.operators import classify, packets, pool, sampling, statements
from newsloom.sources import readers, writers
from newsloom.streaming.incremental import bucket_stream

ONSET = dt.date(2020, 3, 2)


def write_pool(folder, missing_group=False):
    day = (ONSET - dt.timedelta(days=3)).isoformat()
    art = lambda i: {"gkg_record_id": i, "url": f"http://x/{i}", "datetime": f"{day}T01:02:03", "article": "Flu cases are rising in the city.", "themes": [], "locations": []}
    season = lambda i, s: {"gkg_record_id": i, "datetime": day, "country_seasons": ["USA-2019"] if s else [], "sampling_country": "USA" if s else None, "sampling_season": "USA-2019" if s else None}
    groups = [("A1", "A1", 3), ("A2", "A1", 3), ("A3", "A1", 3), ("B", "B", 1), ("C", "C", 1)]
    folder.mkdir(exist_ok=True)
    (folder / "pooled_articles.jsonl").write_text("\n".join(json.dumps(art(i)) for i in ("A1", "A2", "A3", "B", "C")) + "\n  \n\n")
    (folder / "season_assignments.jsonl").write_text("\n".join(json.dumps(season(i, i != "C")) for i in ("A1", "A2", "A3", "B", "C")))
    (folder / "near_dup_groups.jsonl").write_text("\n".join(json.dumps({"gkg_record_id": i, "near_dup_group": g, "group_size": n}) for i, g, n in groups if not (missing_group and i == "B")))
    (folder / "season_windows.json").write_text(json.dumps([{"season_id": "USA-2019", "country": "USA", "season_year": 2019, "onset_date": ONSET.isoformat(), "window_start": "2019-12-23", "window_end": "2020-03-16"}]))
    return str(folder)


@pytest.fixture(scope="module")
def articles(spark, tmp_path_factory):
    folder = write_pool(tmp_path_factory.mktemp("pool"))
    return pool.read_pool(*readers.pool_folder(spark, folder)).cache()


def test_one_article_a_group_with_phase_and_size(articles):
    rows = {r["near_dup_group"]: r for r in articles.collect()}
    assert set(rows) == {"A1", "B"} and articles.count() == 2
    assert rows["A1"]["group_size"] == 3 and rows["A1"]["phase"] == "late" and rows["A1"]["scan_date"] == "2020-02-28"


def test_lookups_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="1 eligible articles have no near-duplicate group"):
        pool.read_pool(*readers.pool_folder(spark, write_pool(tmp_path, missing_group=True)))
    p, s, g, w = readers.pool_folder(spark, write_pool(tmp_path))
    with pytest.raises(ValueError, match="season window"):
        pool.read_pool(p, s, g, w.where("season_id = 'none'"))
    with pytest.raises(ValueError, match="repeated in the group"):
        pool.read_pool(p, s, g.unionByName(g), w)


def test_malformed_lines_raise(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"gkg_record_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "x.jsonl"), readers.GROUPS).collect()


@pytest.fixture(scope="module")
def big(spark):
    """Articles of every bucket in uneven cells."""
    rows = []
    for b, q in sampling.QUOTAS.items():
        name = "X_too_short" if b == "JUNK" else b
        for i in range(q // 2 if b == "Z_zoonotic_human" else 2 * q + 7):
            rows.append((f"{name}-{i}", "u", "2020-03-01", f"c{i % 3 if i % 7 else 0}", f"s{i % 2}", ("early", "late", "post")[i % 3], 2020, name, "r", f"g{name}{i}", 1, f"text {i}"))
    rows += [(f"X_spam_stub-{i}", "u", "2020-03-01", "c0", "s0", "late", 2020, "X_spam_stub", "r", f"x{i}", 1, "t") for i in range(9)]
    return spark.createDataFrame(rows, "record_id string, url string, scan_date string, country string, season string, phase string, year int, bucket string, reason string, near_dup_group string, group_size int, text string").cache()


def turn_by_turn(rows):
    """The draw as a procedure: cells in drawn order, one from each in turn."""
    import hashlib

    md5 = lambda *k: hashlib.md5(":".join(("42", *k)).encode()).hexdigest()
    out = {}
    for name, quota in sampling.QUOTAS.items():
        cells = {}
        for r in rows:
            if ("JUNK" if r["bucket"] in sampling.JUNK else r["bucket"]) == name:
                cells.setdefault((r["country"], r["season"], r["phase"]), []).append(r["record_id"])
        queues = [sorted(cells[c], key=lambda i: md5("cell", i)) for c in sorted(cells, key=lambda c: md5("order", name, *c))]
        taken = [q[k] for k in range(max(map(len, queues), default=0)) for q in queues if k < len(q)]
        out[name] = taken[:quota]
    return out


def test_draw_equals_the_procedure(big):
    want = turn_by_turn(big.collect())
    for n in (1, 4, 17):
        got = {}
        for r in sampling.draw(big.repartition(n)).orderBy("ordinal", "pos").collect():
            got.setdefault(r["name"], []).append(r["record_id"])
        assert got == {k: v for k, v in want.items() if v}


def test_other_seed_other_sample(big):
    a, b = ({r["record_id"] for r in sampling.draw(big, seed=s).collect()} for s in (42, 43))
    assert a != b and len(a) == len(b) == 1200 - 15


def test_sizes(big):
    d = sampling.sizes_document(big)
    assert d["eligible_articles"] == big.count() and d["per_bucket"]["JUNK"] == 57 + 9 and list(d["per_bucket"]) == list(sampling.QUOTAS)
    few = sampling.bucket_sizes(big.where("bucket = 'N_research'")).collect()
    assert len(few) == 14 and sum(r["n"] for r in few) == 87


@pytest.fixture(scope="module")
def sample(spark):
    sizes = {b: q for b, q in sampling.QUOTAS.items() if b != "JUNK"} | {"X_too_short": 17, "X_spam_stub": 4, "X_listing_garbled": 4}
    rows = [(f"{b}-{i}", f"http://x/{b}/{i}", "2020-03-01", b, f" article {i} in {b}\n") for b, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "record_id string, url string, scan_date string, bucket string, text string").cache()


@pytest.fixture(scope="module")
def dealt(sample):
    return packets.deal(sample).cache()


def test_deal(dealt):
    rows = dealt.collect()
    by = {}
    for r in rows:
        by.setdefault(r["owner"], []).append(r)
    assert len({r["record_id"] for r in rows}) == 1200 and all(len(v) == 300 for v in by.values())
    for v in by.values():
        useful = sum(r["bucket"][0] in "PZ" for r in v)
        assert abs(useful - 150) <= 2
        pilot = [r for r in v if r["pilot"]]
        assert sum(r["bucket"][0] in "PZ" for r in pilot) == 10 and len(pilot) == 20 and len({r["bucket"] for r in pilot}) >= 12
        assert sorted(r["pilot_pos"] for r in pilot) == list(range(1, 21))
        assert sorted(r["packet_pos"] for r in v) == list(range(1, 301))
    for b in {r["bucket"] for r in rows}:
        n = sum(r["bucket"] == b for r in rows)
        assert all(abs(sum(r["bucket"] == b for r in v) - n / 4) < 1 for v in by.values())


def test_sheets_and_key(dealt):
    sheet = packets.sheets(dealt).collect()
    mine = sorted((r for r in sheet if r["labeler"] == "labeler_4"), key=lambda r: r["row"])
    assert [r["row"] for r in mine] == list(range(1, 321))
    assert {r["round"] for r in mine[:20]} == {"1-own"} and {r["round"] for r in mine[20:40]} == {"1-check-labeler_1"} and {r["round"] for r in mine[40:]} == {"2"}
    first = sorted((r for r in sheet if r["labeler"] == "labeler_1"), key=lambda r: r["row"])
    assert [r["article_id"] for r in mine[20:40]] == [r["article_id"] for r in first[:20]]
    key = packets.assignment_key(dealt).collect()
    assert len(key) == 1200 and sum(r["pilot"] for r in key) == 80
    before = {f"labeler_{i}": f"labeler_{(i + 2) % 4 + 1}" for i in range(1, 5)}
    assert all(r["checked_by"] == (before[r["owner"]] if r["pilot"] else "") for r in key)


def test_packets_depend_on_the_seed_alone(sample, dealt):
    same = packets.deal(sample.repartition(7))
    other = packets.deal(sample, seed=1)
    cols = ["record_id", "owner", "packet_pos", "pilot_pos"]
    rows = lambda d: sorted(map(tuple, d.select([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).collect()))
    assert rows(same) == rows(dealt) != rows(other)


def test_written_packets(dealt, tmp_path):
    (tmp_path / "how.md").write_text("read this")
    writers.save_packets(str(tmp_path / "out"), dealt, str(tmp_path / "how.md"))
    raw = (tmp_path / "out/labeler_1_labels.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    rows = list(csv.DictReader(raw.decode("utf-8-sig").splitlines()))
    assert len(rows) == 320 and "bucket" not in rows[0] and rows[0]["useful"] == "" and rows[0]["labeler"] == "labeler_1"
    assert (tmp_path / "out/labeler_2_items.csv").read_text("utf-8-sig").strip().split(",") == packets.ITEM_COLUMNS
    text = (tmp_path / "out/labeler_1_texts.txt").read_text()
    assert text.startswith("=" * 80 + "\n#1  [1-own]  ") and "\n" + "-" * 80 + "\narticle " in text
    key = list(csv.DictReader((tmp_path / "out/assignment_key.csv").open()))
    assert {r["pilot"] for r in key} == {"True", "False"} and (tmp_path / "out/how.md").exists()


def test_jobs_end_to_end(spark, tmp_path):
    out = str(tmp_path / "run")
    summary = jobs.run_sampling(spark, write_pool(tmp_path / "pool"), out)
    assert summary["per_bucket"]["JUNK"] == 2
    again = readers.sample(spark, f"{out}/sample_jsonl")
    assert again.count() == 2 and again.first()["text"].startswith("Flu cases")
    head = spark.read.text(f"{out}/sample").first()["value"]
    assert head == ",".join(sampling.COLUMNS)
    jobs.run_packets(spark, f"{out}/sample_jsonl", str(tmp_path / "packets"))
    assert (tmp_path / "packets/assignment_key.csv").exists()


def test_csv_quotes_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', None, "x, y")], "p string, q string, r string").coalesce(1)
    writers.csv_rows(rows, str(tmp_path / "c"), ["r", "q", "p"])
    data = next((tmp_path / "c").glob("part*.csv")).read_bytes()
    assert data == b'r,q,p\r\n"x, y",,"a ""b"", c"\r\n'
    writers.json_lines(rows, str(tmp_path / "j"), ["p", "q"])
    assert json.loads(next((tmp_path / "j").glob("part*.json")).read_text()) == {"p": 'a "b", c', "q": None}


def test_stream_equals_batch(spark, tmp_path):
    folder = write_pool(tmp_path / "pool")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text((tmp_path / "pool/pooled_articles.jsonl").read_text().strip())
    q = bucket_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert folder and rows.count() == 5 and {r["bucket"] for r in rows.collect()} == {"X_too_short"}


def test_replies(spark):
    good = '{"useful": true, "disease": "flu", "items": [{"kind": "cases", "number": 20, "status": null, "total_or_new": "total", "country": "USA", "start_date": "2020-01-02", "end_date": "2020-01-02", "evidence": "20 cases"}]}'
    bad = '{"useful": false, "disease": "flu", "items": [{"kind": "x", "status": "y", "total_or_new": "z", "start_date": "2020-01-03", "end_date": "2020-01-02", "evidence": "not there"}]}'
    rows = spark.createDataFrame([(1, "There were 20 cases.", good), (2, "There were 20 cases.", bad), (3, "t", "no json"), (4, "t", None), (5, None, good)], "i int, text string, raw string")
    got = {r["i"]: r["e"] for r in rows.withColumn("reply", statements.parsed(F.col("raw"))).select("i", statements.reply_errors("reply", "text").alias("e")).collect()}
    assert got[1] == [] and got[3] == got[4] == ["no_reply"] and got[5] == ["invented_evidence"]
    assert got[2] == ["not_useful_but_filled", "bad_kind", "bad_status", "bad_counting", "no_country", "dates_reversed", "invented_evidence"]


def test_dates_and_flags(spark):
    from newsloom.functions.text import last_weekday

    r = spark.sql("select date'2016-02-08' as a, date'2016-02-06' as b").select(last_weekday(F.col("a"), "SAT").alias("a"), last_weekday(F.col("b"), "SAT").alias("b")).first()
    assert (str(r["a"]), str(r["b"])) == ("2016-02-06", "2016-01-30")
    rows = spark.createDataFrame([(" Yes",), ("no",), ("true",), ("?",), (None,)], "useful string")
    assert [r["useful"] for r in readers.useful_flag(rows).collect()] == [True, False, True, None, None]


def test_cascade_handles_many_partitions(big):
    assert classify.bucketed(big.repartition(9)).count() == big.count()


def test_dates_of_wordings(spark):
    d = dt.date
    cases = [("on Saturday", d(2016, 2, 8), None, d(2016, 2, 6), d(2016, 2, 6)), ("Monday", None, d(2016, 2, 8), d(2016, 2, 1), d(2016, 2, 1)), (" Today ", d(2016, 2, 8), d(2016, 3, 1), d(2016, 2, 8), d(2016, 2, 8)),
             ("this week", d(2016, 2, 10), None, d(2016, 2, 8), d(2016, 2, 10)), ("since October", d(2016, 2, 8), None, d(2015, 10, 1), d(2016, 2, 8)), ("since february", d(2016, 2, 8), None, d(2016, 2, 1), d(2016, 2, 8)),
             ("between 1 and 5 January", d(2016, 2, 8), None, d(2016, 1, 1), d(2016, 1, 5)), ("between 1 and 5 March", d(2016, 2, 8), None, d(2015, 3, 1), d(2015, 3, 5)), ("between 28 and 31 February", d(2016, 2, 8), None, None, None),
             ("last week", d(2016, 2, 10), None, d(2016, 2, 1), d(2016, 2, 7)), ("2016-01-02", None, None, d(2016, 1, 2), d(2016, 1, 2)), ("long ago", d(2016, 2, 8), None, None, None), (None, d(2016, 2, 8), None, None, None), ("today", None, None, None, None)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, w string, a date, s date")
    got = rows.select("i", statements.resolved(F.col("w"), F.col("a"), F.col("s")).alias("d")).orderBy("i").collect()
    assert [tuple(r["d"]) for r in got] == [c[3:] for c in cases]


def test_answers_are_compared(spark):
    kind = "article_id long, kind string, total_or_new string, country string, state string, city string, number long, start_date date, end_date date"
    day = dt.date(2016, 2, 6)
    item = lambda a, n, city=None, kind="cases", start=day: (a, kind, "new", "India", None, city, n, start, day)
    human = spark.createDataFrame([item(1, 20), item(1, 3, "V"), item(2, 5), item(3, 7), item(4, None, kind="trend")], kind)
    model = spark.createDataFrame([item(1, 20), item(2, 6), item(3, 7, start=dt.date(2016, 2, 5)), item(3, 9, "X"), item(4, None, kind="trend")], kind)
    got = sorted((r["article_id"], r["city"] or "", r["outcome"]) for r in statements.compare_items(human, model).collect())
    assert got == [(1, "", "right"), (1, "V", "missed_item"), (2, "", "wrong_number"), (3, "", "wrong_date"), (3, "X", "invented_item"), (4, "", "right")]
    h, m = (spark.createDataFrame(r, "article_id long, useful boolean") for r in ([(1, True), (2, False), (3, True)], [(1, True), (2, True), (4, False)]))
    assert {r["article_id"]: r["outcome"] for r in statements.compare_useful(h, m).collect()} == {1: "right", 2: "wrong_useful", 3: "no_answer", 4: "no_label"}


def test_totals_change_across_months(spark):
    rows = [(i, "a" if i % 3 else None, "cases", dt.date(2016, 1 + i // 8, 1 + i % 8), 10 * i + i % 3, "total" if i % 5 else "new") for i in range(40)]
    items = spark.createDataFrame(rows, "id int, place string, kind string, start_date date, number long, total_or_new string")
    got = {r["id"]: r["change"] for r in statements.total_changes(items, ["place"], "id").collect()}
    last = {}
    for i, place, _, _, number, t in rows:
        if t == "total":
            assert got.pop(i) == (number - last[place] if place in last else None)
            last[place] = number
    assert not got


def test_prompt_has_the_form_of_the_examples(spark):
    ex = statements.example("2016-02-08", "Flu.", "{}")
    row = spark.createDataFrame([("2016-03-01", "Text.")], "scan_date string, text string").select(statements.prompt("Do.", [ex]).alias("p")).first()
    assert row["p"] == "Do.\n\n<example>\nScan date: 2016-02-08\nArticle:\nFlu.\n\nAnswer:\n{}\n</example>\n\nScan date: 2016-03-01\nArticle:\nText."


def test_cell_weights(spark, big):
    drawn = sampling.draw(big).withColumn("late", F.col("phase") == "late")
    r = sampling.cell_rate(drawn, big, "late").first()
    truth = big.where("phase = 'late'").count() / big.count()
    assert r["n"] == big.count() and r["covered"] == 1.0 and abs(r["rate"] - truth) < 1e-6


def test_files_that_are_refused(spark, dealt, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"record_id": "a"}\n\n{"record_id": "b"}\n')
    with pytest.raises(ValueError, match="blank"):
        readers.sample(spark, str(tmp_path / "s.jsonl"))
    with pytest.raises(ValueError, match="hold a sample"):
        writers.save_packets(str(tmp_path / "o"), dealt, most=10)


def test_pool_keeps_english_alone(spark):
    rows = spark.createDataFrame([("a", "en"), ("b", "fr"), ("c", None)], "gkg_record_id string, lang string")
    assert [r[0] for r in pool.english(rows).collect()] == ["a"] and pool.english(rows.drop("lang")).count() == 3


CASCADE = "Generate explode("  # the generator that holds the cascade


@pytest.mark.parametrize("name", ["packet_sheet_rows", "assignment_key", "deal_packets", "packet_mix", "pilot_pick"])
def test_packets_compute_the_cascade_once(spark, name):
    from newsloom.plans import registry
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(CASCADE) == 1


@pytest.mark.parametrize("name", ["packet_mix", "deal_packets"])
def test_packets_search_ascii_texts_by_the_cheaper_patterns(spark, name):
    from newsloom.functions import lexicon
    from newsloom.plans import registry
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(lexicon.topic_words()) == 1 and lexicon.low_search("TREND_NEAR") in plan


def test_packet_mix_looks_at_whole_texts_once(spark):
    """Linear-time searches look at each whole text; Java's sentences are those that they leave."""
    from newsloom.plans import registry
    plan = registry.queries()["packet_mix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1
    cascade = plan.index(CASCADE)
    assert cascade < plan.index("ArrowEvalPython [") < plan.index("Join", cascade)


@pytest.mark.parametrize("name", ["pool_weighted_rate", "pool_cell_rate"])
def test_rates_read_rows_that_were_computed_once(spark, name):
    from newsloom.plans import registry
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(CASCADE) == 0
