import random
import re

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import ngram_join as N
from newsloom.llm.shingles import shingle_sets

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b >= a:
                break
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_set_sizes_match_words(rows):
    texts = [t for _, t, *_ in rows]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_hashes_do_not_depend_on_the_neighbours():
    a, b = shingle_sets(pa.array(["q w e r t y", "zz " * 300_000 + "q w e r t y"]))
    assert set(a.tolist()) <= set(b.tolist())


@pytest.mark.parametrize(("tree", "block"), [(N.TREE, N.BLOCK), (3, 4), (2, 2)])
def test_components_equal_brute_force(docs, rows, tree, block):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, tree=tree, block=block).collect()}
    assert got == brute(rows)


def test_one_row_a_document_and_clashing_columns(docs, rows):
    from pyspark.sql import functions as F

    out = N.near_duplicates(docs.withColumn("component_id", F.lit("x")).withColumn("keys", F.lit(1)))
    assert out.count() == len(rows)


def test_empty_table(none):
    assert N.near_duplicates(none).count() == 0
    assert N.one_of_each(none).count() == 0


def test_one_of_each_keeps_the_smallest_of_each_group(docs, rows):
    kept = sorted(r["doc_id"] for r in N.one_of_each(docs).collect())
    assert kept == sorted({c for _, c in brute(rows).values()})


def test_bound_never_refuses_a_link():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.93], r.integers(0, 1 << 63, int(r.integers(0, max(1, n // 12)))).astype(np.uint64)]))
        if len(y) and N.linked(x, y):
            tree = N.CountTree(np.array([len(y)] * 40), [N.point(y)] * 40)
            assert len(tree.near(len(x), N.point(x))) == 40


def test_trees_of_all_sizes_find_every_link():
    """Sizes about the borders of the levels, next to very short and very long sets."""
    r = np.random.default_rng(8)
    sets = []
    for n in (20, 450, 511, 512, 600, 1800, 2047, 2048, 2400, 7000, 8191, 8192, 9000, 17000):
        x = r.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [np.unique(x), np.unique(np.concatenate([x[: int(n * 0.9)], r.integers(0, 1 << 63, max(1, n // 40)).astype(np.uint64)])), np.unique(np.concatenate([x, r.integers(0, 1 << 63, n // 5).astype(np.uint64)]))]
    sizes, points = np.array([len(s) for s in sets]), [N.point(s) for s in sets]
    tree, passed = N.Trees(sizes, points), 0
    for i, s in enumerate(sets):
        near = set(tree.near(len(s), points[i]).tolist())
        passed += len(near)
        assert {j for j, o in enumerate(sets) if N.linked(s, o)} <= near
    assert passed < 4 * len(sets)


def test_linked_sets_share_a_route():
    r, missed, tried = np.random.default_rng(2), 0, 0
    common = np.zeros(N.CELLS, bool)
    for _ in range(400):
        n = int(r.integers(2, 700))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], r.integers(0, 1 << 63, n // 12).astype(np.uint64)]))
        if len(y) and N.linked(x, y):
            tried += 1
            missed += not set(N.routes(x, common).tolist()) & set(N.routes(y, common).tolist())
    assert tried > 100 and missed == 0


def test_long_texts_use_finer_points():
    r = random.Random(3)
    sizes = [N.n_groups(n) for n in (10, 600, 3000, 50_000)]
    assert sizes == sorted(set(sizes))
    p = N.point(np.unique(np.array([r.getrandbits(63) for _ in range(2000)], np.uint64)))
    assert N.folded(p, N.GROUPS).sum() == p.sum()


def test_texts_that_share_an_id_or_have_none(spark, none):
    r = random.Random(6)
    a, b, c = (" ".join(f"w{r.randint(0, 10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (7, a + " x"), (None, b + " y"), (None, c), (None, c + " z"), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], none.schema)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in N.near_duplicates(docs).collect())
    assert got == sorted([(5, 76, 5), (5, 76, 5), (5, 76, 5), (7, 77, 5), (-1, 77, 5), (-1, 76, -1), (-1, 77, -1), (9, 0, 9), (-1, 0, -1), (-1, 0, -1)])
    kept = [(r["doc_id"], r["text"]) for r in N.one_of_each(docs).collect()]
    assert sorted((i or -1, len(t or "")) for i, t in kept if t != c and t != c + " z") == sorted([(5, len(a)), (5, len(b)), (9, 0), (-1, 0)])
    assert sum(t in (c, c + " z") for _, t in kept) == 1 and len(kept) == 5


def lines_of(r, n, words):
    return [" ".join(f"v{r.randint(0, 10**6)}" for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize(("tree", "block", "probe"), [(30, 40, 64), (30, 500, 50)])
def test_look_alikes_equal_brute_force(spark, tree, block, probe):
    """Texts made of a few common lines: all routes are hot, one group holds all, some link and most do not."""
    r = random.Random(11)
    lines, rows = lines_of(r, 14, 20), []
    for i in range(420):
        rows.append((i, " ".join(r.sample(lines, r.choice((5, 6))) if i % 3 else lines[:6] + [f"own{i}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(docs, tree=tree, block=block, probe=probe).collect()}
    assert got == brute(rows)


def test_a_hot_route_of_thousands_of_look_alikes(spark):
    """Texts of twelve of forty common lines: none of a route's members links, and no cell holds them all."""
    r = random.Random(12)
    lines = lines_of(r, 40, 25)
    picks = [tuple(sorted(r.sample(range(40), 12))) for _ in range(6000)]
    rows = [(i, " ".join(lines[k] for k in p)) for i, p in enumerate(picks)]
    got = {x["doc_id"]: x["component_id"] for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    # texts of one set of lines are equal; others share at most eleven lines
    first = {}
    for i, p in enumerate(picks):
        first.setdefault(p, i)
    alone = [i for i, p in enumerate(picks) if max(len(set(p) & set(q)) for q in r.sample(picks, 50) if q != p) < 11]
    assert all(got[first[p]] == got[i] for i, p in enumerate(picks)) and sum(got[i] == i for i in alone) > 0.95 * len(alone)


def test_blocks_are_bounded_by_shingles(docs, rows, monkeypatch):
    monkeypatch.setattr(N, "WEIGHT", 300)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, tree=3).collect()} == brute(rows)
