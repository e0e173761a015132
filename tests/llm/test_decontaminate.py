import hashlib
import re

import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate as D

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOW))


def brute(text, items):
    w = split(text)
    hit, found = set(), set()
    for item, t in items:
        v = split(t)
        for k in range(max(1, len(v) - 12)) if v else ():
            win = v[k : k + 13]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    names = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def case(spark):
    long = "One two THREE four, five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = [(1, long), (2, "short é item"), (3, None), (4, "..."), (5, "x y"), (10, "short É item"), (11, long), (11, long)]
    texts = [None, "", long, long.upper() + " and more " * 200, "a short é item b", "a short-é_item", "short É item", "x y x y", "nothing here", "y x", "two three four five six seven eight nine ten eleven twelve thirteen fourteen"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    return docs, spark.createDataFrame(items, "item_id long, text string"), texts, items


@pytest.mark.parametrize("limit", [D.MAX_WINDOW_CHARS, 20])
def test_equals_brute_force(case, limit):
    docs, items, texts, rows = case
    out = D.contamination(docs, items, limit=limit)
    assert out.columns.count("n_hit") == 1
    for r in out.collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], rows), r


def test_spans_are_places_of_the_original(case):
    docs, items, texts, _ = case
    r = D.contamination(docs, items).where("doc_id = 4").first()
    assert [texts[4][a:b] for a, b in r["spans"]] == ["short é item"]


def test_clean_rows_alone(case):
    docs, items, texts, rows = case
    kept = {r["doc_id"] for r in D.contamination(docs, items, keep="clean").collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute(t, rows)[4]}


def test_scrubbed_texts_hold_no_window(case):
    docs, items, texts, rows = case
    long = "x " * 300 + texts[2] + ", y " * 40 + "short é item" + " z" * 300
    more = docs.unionByName(docs.sparkSession.createDataFrame([(100, long, 1)], docs.schema))
    kept = {r["doc_id"]: r["text"] for r in D.contamination(more, items, keep="clean", scrub=True).collect()}
    assert kept[100] == "x " * 300 + ", y " * 40 + " z" * 300
    assert all(kept[i] == texts[i] for i in kept if i < 100 and brute(texts[i], rows)[1] == 0)
    assert all(brute(t, rows)[1] == 0 for i, t in kept.items() if i != 100)


def test_empty_tables(case):
    docs, items, *_ = case
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_digest_query(case, docs, tmp_path):
    docs.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    case[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    assert D.op3(docs.sparkSession, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("limit", [D.MAX_WINDOW_CHARS, 20])
def test_items_without_an_id_give_hits_and_spans(case, limit):
    docs, items, texts, _ = case
    nameless = items.select(F.when(F.col("item_id") == 5, F.col("item_id")).alias("item_id"), "text")
    out = {r["doc_id"]: r for r in D.contamination(docs, nameless, limit=limit).collect()}
    named = {r["doc_id"]: r for r in D.contamination(docs, items, limit=limit).collect()}
    for i in named:
        assert all(out[i][c] == named[i][c] for c in ("n_words", "n_hit", "spans", "contaminated")), i
        assert out[i]["item_ids"] == [k for k in named[i]["item_ids"] if k == 5] and out[i]["n_items"] == len(out[i]["item_ids"])
    assert out[2]["contaminated"] and out[2]["n_items"] == 0
    kept = {r["doc_id"]: r["text"] for r in D.contamination(docs, nameless, keep="clean", scrub=True, limit=limit).collect()}
    assert 2 not in kept and all("thirteen" not in (t or "") for t in kept.values())


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q/10", "a b"), ("q/9", "c d"), (None, "x")], "item_id string, text string")
    for limit in (D.MAX_WINDOW_CHARS, 3):
        got = {r["doc_id"]: r for r in D.contamination(docs, items, carry=["doc_id"], limit=limit).collect()}
        assert got[1]["item_ids"] == ["q/10", "q/9"] and got[1]["n_items"] == 2 and got[1]["n_hit"] == 5 and got[2]["item_ids"] == []
    small = items.where("item_id is not null").selectExpr("cast(substring(item_id, 3) as int) as item_id", "text")
    assert D.contamination(docs, small, carry=["doc_id"]).orderBy("doc_id").first()["item_ids"] == [9, 10]
