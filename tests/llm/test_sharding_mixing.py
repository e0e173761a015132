import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing as M
from newsloom.llm import sharding as H


def size(text):
    return len((text or "").encode()) + 1


@pytest.mark.parametrize("reuse", [True, False])
@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_laws(docs, rows, law, reuse):
    out = H.shard_documents(docs, law=law, reuse=reuse).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, size(t)) for i, t, *_ in rows)
    slots = {}
    for r in out:
        assert 0 <= r["shard"] < 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    if law == "key":
        assert all(r["grown_shard"] in (r["shard"], 16) for r in out)


def test_bytes_are_near_equal_and_copies_stay_together(spark):
    rows = [(i, f"text {i % 700} " * (1 + i % 9)) for i in range(4000)] + [(i, "hot copy " * 5) for i in range(4000, 7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = H.shard_documents(docs).collect()
    totals = {}
    for r in out:
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["size"]
    mean = sum(totals.values()) / 16
    assert len(totals) == 16 and max(abs(t - mean) for t in totals.values()) < 0.1 * mean
    per_text = {}
    text = dict(rows)
    for r in out:
        per_text.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    hot = per_text.pop("hot copy " * 5)
    assert len(hot) > 1 and all(len(s) == 1 for s in per_text.values())


@pytest.mark.parametrize("reuse", [True, False])
def test_bytes_are_nearly_equal_with_long_texts(spark, reuse):
    """Texts of a third of a shard, copies of long texts, a row given many times, and a hot text: within 2 % of the mean."""
    rows = [(i, "x" * (40 + i * 37 % 900)) for i in range(4000)] + [(5000 + i, f"{i} " * 15_000) for i in range(20)] + [(6000 + i, "c" * 30_000) for i in range(9)] + [(7000, "d" * 9_000)] * 30 + [(8000 + i, "hot " * 40) for i in range(4000)]
    out = H.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), carry=["doc_id"], reuse=reuse).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, len(t) + 1) for i, t in rows)
    totals, slots = {}, {}
    for r in out:
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(totals.values()) / 16
    assert len(totals) == 16 and max(abs(t - mean) for t in totals.values()) < 0.02 * mean, sorted(totals.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_text_larger_than_a_shard(spark):
    rows = [(1, "x" * 100_000)] + [(i, "y" * 50 + str(i)) for i in range(2, 600)]
    out = H.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = next(r["shard"] for r in out if r["doc_id"] == 1)
    assert [r["doc_id"] for r in out if r["shard"] == alone] == [1]


def test_sharding_is_repeatable_and_handles_nothing(docs, none):
    a, b = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in H.shard_documents(d, carry=["doc_id"]).collect()) for d in (docs, docs.repartition(3)))
    assert a == b
    assert H.shard_documents(none).count() == 0


def test_clashing_columns_are_replaced(docs):
    out = H.shard_documents(docs.withColumn("shard", F.lit("x")).withColumn("size", F.lit("y")))
    assert dict(out.dtypes)["shard"] == "int" and out.columns.count("size") == 1


def test_digests(docs, tmp_path, rows):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["text_crc32"]) for r in H.op7(docs.sparkSession, str(tmp_path)).collect())
    assert got == sorted((i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The rule of the targets, read off its description."""
    left, open_, got = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if unit * weights[i % len(weights)] > most * sizes[i]}
        for i in over or open_:
            got[i] = most * sizes[i] if over else unit * weights[i % len(weights)]
        left -= sum(got[i] for i in over)
        open_ = open_ - over if over else set()
    return got


@pytest.mark.parametrize("sizes", [[100, 10, 100, 0], [5], [0, 0], [], [1000, 1, 1, 1, 7, 3, 900, 2], list(range(50))])
def test_targets_reshare_the_excess(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "s long, size long")
    got = [r["target"] for r in M.targets(rows).orderBy("s").collect()]
    assert got == pytest.approx(shares(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(got, sizes, strict=True))


def test_sources_are_numbered_by_code_points(spark):
    names = [None, "b", "a", "", "\U0001f600", "\uffee", "B", *[f"s{i}" for i in range(500)]]
    got = M.numbered(spark.createDataFrame([(n, 1) for n in names], "source string, size long").repartition(7)).collect()
    assert [r["source"] for r in sorted(got, key=lambda r: r["s"])] == [*sorted(n for n in names if n is not None), None]
    assert sorted(r["s"] for r in got) == list(range(len(names)))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    assert sorted(M.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert n < 17 or M.permuted(np.arange(n), n, 5).tolist() != M.permuted(np.arange(n), n, 6).tolist()


@pytest.mark.parametrize(("slots", "shards"), [(1000, 7), (3, 64), (10**12, 5), (0, 3), (500, 1)])
def test_shard_draws_add_up_and_agree(slots, shards):
    which, counts, before = M.shard_draw(slots, 4, shards, 3)
    assert counts.sum() == slots and before == 0 and (np.diff(which) > 0).all() and (counts > 0).all()
    for depth in range(1, 4):
        parts = [M.shard_draw(slots, 4, shards, 3, depth, path) for path in range(2**depth)]
        seen = {}
        for w, c, b in parts:
            assert b == sum(n for k, n in zip(which, counts, strict=True) if len(w) and k < w[0]) or not len(w)
            for k, n in zip(w.tolist(), c.tolist(), strict=True):
                seen[k] = seen.get(k, 0) + n
        assert seen == dict(zip(which.tolist(), counts.tolist(), strict=True))


def test_shard_draws_are_multinomial():
    all_ = np.zeros((400, 5))
    for s in range(400):
        which, counts, _ = M.shard_draw(1000, s, 5, 9)
        all_[s, which] = counts
    assert np.abs(all_.mean(0) - 200).max() < 3 and np.abs(all_.var(0) - 160).max() < 40


def test_mix(docs, rows, none):
    got = M.Mix(docs, block=16).taken().collect()
    assert len(got) == len(rows)
    n = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, n(t)) for i, t, *_ in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["taken"]
        s[1] += r["size"]
    for (source, target), (taken, total) in by.items():
        assert total == source and abs(taken - target) <= max(32, 0.05 * target)
    again = M.Mix(docs.repartition(2), block=16).taken().collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert M.Mix(none).taken().count() == 0
    assert M.mix_documents(none).count() == 0


def test_mixed_texts_hold_the_taken_words(docs):
    plan = M.Mix(docs, block=16)
    taken = plan.taken().agg(F.sum("taken")).first()[0]
    texts = plan.texts(docs.dropDuplicates(["doc_id"]))
    assert texts.count() == plan.sources.agg(F.sum("slots")).first()[0]
    have = texts.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(have - taken) <= 2 * 16


def test_taken_words_equal_brute_force(docs, rows):
    """taken, recomputed from the packed places and the slots one by one; and the pieces that a mix of documents returns."""
    import re

    plan = M.Mix(docs, block=16)
    place = {}
    for r in plan.packed.collect():
        place.setdefault(r["s"], []).append((r["start"], r["size"], r["doc_id"], r["tie"]))
    names = sorted({s for *_, s, _ in rows}, key=lambda x: (x is None, x or ""))
    assert {r["s"]: r["source"] for r in plan.sources.collect()} == dict(enumerate(names))
    sizes = [sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, s, _ in rows if s == name) for name in names]
    assert [r["target"] for r in plan.sources.orderBy("s").collect()] == pytest.approx(shares(sizes))
    want, seen = {}, {}
    for r in plan.slot_table().collect():
        seen.setdefault(r["s"], []).append((r["nth"], r["block"]))
        for start, size, i, tie in place[r["s"]]:
            n = min(start + size, (r["block"] + 1) * 16) - max(start, r["block"] * 16)
            if n > 0:
                want[r["s"], i, tie] = want.get((r["s"], i, tie), 0) + n
    for r in plan.sources.collect():
        mine = sorted(seen.get(r["s"], []))
        assert [n for n, _ in mine] == list(range(r["slots"]))
        for epoch in range(0, r["slots"], max(r["blocks"], 1)):
            part = [b for _, b in mine[epoch : epoch + r["blocks"]]]
            assert len(set(part)) == len(part) and set(part) <= set(range(r["blocks"]))
        spans = sorted((a, a + n) for a, n, *_ in place[r["s"]])
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == r["source_size"]
    got = {}
    for r in plan.taken().collect():
        got[r["s"], r["doc_id"], r["tie"]] = got.get((r["s"], r["doc_id"], r["tie"]), 0) + r["taken"]
    assert {k: v for k, v in got.items() if v} == want
    out = M.mix_documents(docs, block=16).collect()
    text = {i: t for i, t, *_ in rows}
    assert all(r["text"] in text[r["doc_id"]] for r in out)
    words = {}
    for r in out:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    per = {}
    for (_, i, _), n in want.items():
        per[i] = per.get(i, 0) + n
    assert words == per


def test_pieces_of_whole_sources_are_whole_texts(spark):
    rows = [(i, f"  {i} " + " \n ".join(f"w{k}" for k in range(i * 7 % 90)) + "\t", "a" if i % 2 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = M.mix_documents(docs, block=8, share=2.0).collect()
    for i, t, _ in rows:
        mine = [r["text"] for r in out if r["doc_id"] == i]
        assert sum(map(len, mine)) == 2 * len(t) and all(x in t for x in mine)


def test_mixed_documents_keep_columns(docs):
    out = M.mix_documents(docs.withColumn("_p", F.lit(1)))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_mixed_documents_meet_the_targets_of_sources_of_long_documents(spark):
    """Documents of 10 blocks and more, sources with targets below half, above half and twice their sizes."""
    n = {"a": 60, "b": 400, "c": 350, "d": 150}
    rows = [(k * 1000 + i, "w " * (2560 + 97 * (i % 11)), s) for k, (s, m) in enumerate(n.items()) for i in range(m)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = M.mix_documents(docs, share=0.8).select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("n")).collect()
    goals = {r["source"]: (r["target"], r["source_size"]) for r in M.Mix(docs, share=0.8).sources.collect()}
    assert any(0.1 < t / z < 0.4 for t, z in goals.values()) and any(0.5 < t / z < 0.95 for t, z in goals.values())
    for s, (target, _) in goals.items():
        assert abs(sum(r["n"] for r in out if r["source"] == s) - target) <= 2 * M.BLOCK, (s, target)
    again = M.mix_documents(docs.repartition(3), share=0.8).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in again)


def test_repeated_rows_are_mixed_one_by_one(spark):
    rows = [(1, "w " * 3000, "a", k) for k in range(40)] + [(2, "w " * 3000, None, k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int")
    out = M.mix_documents(docs, share=2.0, weights=(1, 1)).collect()
    for s in ("a", None):
        for k in range(40):
            assert sum(len(r["text"]) // 2 for r in out if r["source"] == s and r["k"] == k) == 6000
