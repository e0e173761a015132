"""Null keys in every operator: no row is lost and nothing breaks."""
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, fingerprints, mixing, ngram_join, quality, secrets_scan, sharding, token_counts

LONG = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def odd(spark, none):
    rows = [(None, LONG, None, None, None), (None, LONG, "en", "s", 3), (None, None, None, None, None), (5, LONG, None, None, 1), (7, "", "en", "s", 0), (9, LONG + " x", "en", None, None)]
    return spark.createDataFrame(rows, none.schema).cache()


def test_rows_stay(spark, odd):
    n = odd.count()
    items = spark.createDataFrame([(None, LONG), (1, None), (2, LONG)], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (5, None, 0), (7, 1, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    flat = [0.0] * (secrets_scan._WIDE * secrets_scan._WIDE)
    assert ngram_join.near_duplicates(odd).count() == n
    assert {r["component_id"] for r in ngram_join.near_duplicates(odd).where("doc_id in (5, 9)").collect()} == {5}
    assert decontaminate.contamination(odd, items).where("contaminated").agg(F.max("n_items")).first()[0] == 1
    assert secrets_scan.scan_secrets(odd, flat).count() == n
    assert fingerprints.with_next(odd.select("doc_id", "text"), ["text"]).count() == n
    models = quality.train(odd, labels)
    evidence = quality.scored(odd, models, ["doc_id", "source", "lang"])
    assert quality.judged(evidence, quality.posteriors(evidence)).count() == n
    for law in ("bytes", "rows", "key"):
        out = sharding.shard_documents(odd, law=law).collect()
        assert len({(r["shard"], r["slot"]) for r in out}) == n
    assert token_counts.token_counts(odd, ["source", "text"], ["doc_id"]).count() == n
    assert mixing.Mix(odd).taken().count() == n
    assert mixing.mix_documents(odd).columns == odd.columns


def test_mix_returns_rows_without_an_id(spark, none):
    rows = [(None, f"{k} " + "w " * 99, "en", "s" if k % 2 else None, k) for k in range(20)]
    frame = spark.createDataFrame(rows, none.schema)
    out = mixing.mix_documents(frame, block=10, share=2.0)
    per = {k: [r["text"] for r in out.collect() if r["n_chars"] == k] for k in range(20)}
    assert all(sum(len(x.split()) for x in texts) == 200 for texts in per.values())
    plan = mixing.Mix(frame, block=10, share=2.0)
    texts = [r["text"].split() for r in plan.texts(frame).collect()]
    assert len(texts) == plan.sources.agg(F.sum("slots")).first()[0] == 400 and all(len(t) == 10 for t in texts)
