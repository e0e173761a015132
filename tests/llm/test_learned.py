"""Quality classifier, token counts, HTML extraction, pipeline."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from newsloom.llm import dom
from newsloom.llm import html_extract as H
from newsloom.llm import quality as Q
from newsloom.llm import token_counts as T
from newsloom.llm.common import components, running, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels").withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)))
    docs = table(spark, "/root/testdata/sf0.1", "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    models = Q.train(docs, labels.where("h > 0"))
    evidence = Q.scored(docs, models, ["doc_id", "source", "lang"])
    out = Q.judged(evidence, Q.posteriors(evidence)).join(labels.where("h = 0"), "doc_id")
    rows = out.select("keep", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    right = sum(r["keep"] == r["good"] for r in rows)
    kept = [r["keep"] for r in rows if r["good"]]
    assert right >= 0.97 * len(rows) and sum(kept) >= 0.99 * len(kept), (right, len(rows), sum(kept), len(kept))


def sites_by_hand(rows):
    """site_bad of every document, read off the module's description: rows of (host, path, log-odds)."""
    p = lambda x: 1 / (1 + np.exp(-x))
    odds = lambda q: np.log(min(max(q, 1e-6), 1 - 1e-6)) - np.log(1 - min(max(q, 1e-6), 1 - 1e-6))
    values = [(h, q, p(x)) for h, q, x in rows]
    n, mu = len(values), float(np.mean([v for *_, v in values]))

    def by(key):
        out = {}
        for row in values:
            out.setdefault(key(row), []).append(row[2])
        return out

    hosts, paths = by(lambda r: r[0]), by(lambda r: r[:2])

    def size(groups, above):
        spread = sum(len(g) * (np.mean(g) - above(k)[0]) ** 2 for k, g in groups.items())
        left = n - len(groups)
        chance = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values()) / left if left else mu * (1 - mu)
        free = len(groups) - len({above(k)[2] for k in groups})
        base = n - sum(len(g) ** 2 / above(k)[1] for k, g in groups.items())
        v = max((spread - free * chance) / base, 1e-9) if base > 1e-12 else 1e-9
        return min(max(mu * (1 - mu) / v - 1, 1.0), 1e6)

    hc, c = size(hosts, lambda k: (mu, n, None)), size(paths, lambda k: (np.mean(hosts[k[0]]), len(hosts[k[0]]), k[0]))
    out = []
    for h, q, v in values:
        above = (hc * mu + sum(hosts[h]) - v) / (hc + len(hosts[h]) - 1)
        out.append(odds((c * above + sum(paths[h, q]) - v) / (c + len(paths[h, q]) - 1)) - odds(mu))
    return out


def sites(spark, rows):
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, lang string, e_bad double").withColumn("e_toxic", F.lit(-4.0))
    return [r["site_bad"] for r in Q.judged(e, Q.posteriors(e)).orderBy("i").collect()]


def test_posteriors_equal_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(f"h{i % 9}" if i % 9 else None, f"p{i % 2}" if i % 3 else None, float(r.normal((i % 9) / 3 - 2, 1))) for i in range(500)]
    assert sites(spark, rows) == pytest.approx(sites_by_hand(rows), abs=1e-6)
    lone = [(f"h{i}", "p", float(r.normal(-2, 1))) for i in range(300)]
    assert sites(spark, lone) == pytest.approx(sites_by_hand(lone), abs=1e-6)
    assert sites(spark, rows[:1]) == pytest.approx([0.0], abs=1e-6)


def test_sparse_sites_shrink_most(spark):
    r = np.random.default_rng(5)
    rows = [(h, "p", float(r.normal(m, 0.5))) for h, m, n in [("big", 3, 400), ("tiny", 3, 2), *((f"h{i}", -3 + i % 3, 40) for i in range(20))] for _ in range(n)]
    got = dict(zip([h for h, *_ in rows], sites(spark, rows), strict=True))
    assert got["big"] > got["tiny"] > got["h2"]


def test_lone_documents_move_nothing(spark):
    """Sites of one document that differ by chance alone are shrunk whole."""
    r = np.random.default_rng(6)
    assert max(map(abs, sites(spark, [(f"h{i}", "p", float(r.normal(0, 2))) for i in range(400)]))) < 0.01


def test_training_texts_are_bounded_in_bytes(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    whole = Q.train(docs, labels)[0].b
    monkeypatch.setattr(Q, "SAMPLE_BYTES", 0)
    assert Q.train(docs, labels)[0].b != whole


def test_quality_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.keep_good(docs, labels).count() == docs.count()
    assert Q.keep_good(none, labels).count() == 0
    marked = spark.createDataFrame([(i, i % 2, None if i == 4 else 0) for i in range(50)] + [(None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    kept = Q.keep_good(docs.withColumn("keep", F.lit("x")), marked)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    f = Q.features(pa.array([None, "", "a b a"]))
    assert np.isfinite(f[0]).all() and f[2].tolist()[:3] == [0, 0, 0]


# ---- tokens ------------------------------------------------------------------------------------


def slow(fields):
    """Attribution token by token, byte by byte."""
    encode, sizes = T.encoder()
    whole = "\n".join(fields).encode()
    owner, at = [], 0
    for k, f in enumerate(fields):
        owner += [k] * (len(f.encode()) + (k < len(fields) - 1))
    counts, at = [0] * len(fields), 0
    ids = encode(whole.decode())
    for i in ids:
        span = owner[at : at + sizes[i]]
        at += sizes[i]
        counts[max(sorted(set(span)), key=lambda k: (span.count(k), -k))] += 1
    assert at == len(whole)
    return len(ids), counts


def test_fields_equal_brute_force():
    r = random.Random(1)
    for _ in range(200):
        fields = ["".join(r.choice("ab é\n𝒳1 .") for _ in range(r.randint(0, 30))) for _ in range(3)]
        n, per, lines = T.count_tokens(fields)
        assert (n, per.tolist()) == slow(fields)
        assert lines.sum() == per[-1] or not fields[-1]
        assert len(lines) == (len(fields[-1].split("\n")) - fields[-1].endswith("\n") if fields[-1] else 0)


def test_round_trip():
    encode, sizes = T.encoder()
    t = "Éa bc\n\n  𝒳 12"
    assert sizes[np.array(encode(t))].sum() == len(t.encode())


def test_token_table(docs, rows, none):
    out = T.token_counts(docs.withColumn("n_tokens", F.lit("x")), ["source", "text"], ["doc_id"])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == r["tokens_source"] + r["tokens_text"] and sum(r["section_tokens"]) == r["tokens_text"] * bool(r["section_tokens"])
    assert T.token_counts(none, ["text"], ["doc_id"]).count() == 0


# ---- HTML --------------------------------------------------------------------------------------


def test_held_out_pages():
    model, r, exact = H.trained(), random.Random(1234), 0
    for _ in range(150):
        page, main = H._made_page(r)
        present = {m for _, t in dom.parse(page)[1] for m in H._MARK.findall(t)}
        exact += set(H._MARK.findall(H.extracted([page], model)[0])) == main & present
    assert exact >= 0.95 * 150


def test_blocks_references_and_white_space():
    page = "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two&nbsp;&lt;b&gt;<br>three<p>caf&eacute; <b>bold</b>word<!-- no --></p><script>x='</p>'</script><div class=comments><p>I disagree</p></div></article><footer>&copy; x</footer>"
    assert H.extracted([page], H.trained()) == ["A & B\none two <b> three\ncafé boldword"]


def test_real_pages(spark):
    pages = table(spark, SF, "pages").collect()
    got = H.extracted([p["html"] for p in pages], H.trained())
    for p, text in zip(pages, got, strict=True):
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        import html

        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("page", ['<a "' * 50_000, '<a "x>"' * 30_000, "<div>" * 50_000, "<b><p></p>" * 40_000, "<ul><li>" * 40_000, "<table><tr><td>" * 20_000, "<" * 200_000, "<a href=x>" * 40_000, "<p " + 'a="' * 60_000 + ">x"])
def test_hostile_markup_takes_seconds(page):
    import time

    began = time.time()
    H.extracted([page], H.trained())
    assert time.time() - began < 15


BARE = [
    ("<p>Only paragraph here, nothing else.</p>", "Only paragraph here, nothing else."),
    ("Plain text without any tags at all.", "Plain text without any tags at all."),
    ("<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>About</a></li></ul></nav><div class='xyz-12'><h1>Small title here</h1><p>This is a short article of one sentence.</p></div><footer>Copyright 2020</footer></body></html>",
     "Small title here\nThis is a short article of one sentence."),
    ("<body><div id=hd><a href=/>Site</a></div><div class=k9><p>First paragraph of the story, with commas.</p><p>Second paragraph of the story, a little longer than the first.</p></div><div class=sidebar><ul><li><a href=1>Other</a><li><a href=2>More</a></ul></div></body>",
     "First paragraph of the story, with commas.\nSecond paragraph of the story, a little longer than the first."),
]


@pytest.mark.parametrize(("page", "text"), BARE)
def test_pages_that_name_no_article(page, text):
    assert H.extracted([page], H.trained()) == [text]


def test_no_contradictory_choices():
    r = np.random.default_rng(0)
    for _ in range(100):
        up = [-1] + [int(r.integers(0, k)) for k in range(1, 9)]
        p = r.random(9)
        kept = H.decoded(up, p)
        assert all(not kept[k] or kept[up[k]] for k in range(1, 9))
        score = lambda ks: sum(np.log(p[k] if ks[k] else 1 - p[k]) for k in range(9))
        best = max((score(ks) for ks in np.array(np.meshgrid(*[[0, 1]] * 9)).T.reshape(-1, 9) if all(not ks[k] or ks[up[k]] for k in range(1, 9))))
        assert score(kept) == pytest.approx(best)


def test_page_edge_cases(spark):
    pages = [(1, None, "u"), (2, "", None), (3, "plain text", "u"), (4, "<p", "u"), (5, "</p></div><", "u"), (6, "<article><p>" + "word " * 200_000, "u"), (6, "<article><p>" + "word " * 200_000, "u"), (7, "<a b='" * 2000, "u"), (8, "<div>" * 3000 + "deep", "u")]
    frame = spark.createDataFrame(pages, "page_id int, html string, url string").withColumn("text", F.lit("x"))
    got = {r["page_id"]: r for r in H.extract(frame).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[6]["n_chars"] == 999_999 and len(got) == 8
    assert H.extract(frame.limit(0)).count() == 0


# ---- helpers and pipeline ----------------------------------------------------------------------


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(r.randint(400, 600), r.randint(400, 600)) for _ in range(120)] + [(700, 700)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {x["v"]: x["comp"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {v: top(v) for v in up if v not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_used_up_tables_go(spark):
    from pathlib import Path

    from newsloom.llm.common import cut, scratch, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("*"))
    with scratch(spark) as keep:
        a = cut(spark.range(5))
        b = keep(cut(a.select("id")))
    assert len(set(folder.glob("*")) - before) == 1 and b.count() == 5
    assert components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3
    assert len(set(folder.glob("*")) - before) == 2


def test_a_cluster_must_name_its_folder(spark):
    from types import SimpleNamespace as S

    from newsloom.llm.common import shared_dir

    conf = S(get=lambda *_: None)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(S(conf=conf, sparkContext=S(getConf=lambda: conf, master=master)))


@pytest.mark.parametrize("wide", [1000, 3])
def test_running_sums(spark, monkeypatch, wide):
    monkeypatch.setattr("newsloom.llm.common.WIDE", wide)
    rows = [(None if i % 3 == 0 else f"k{i % 3}", i, i % 7) for i in range(500)]
    out = running(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], [F.col("i")], {"s": F.col("v")}, per_bucket=20).collect()
    for k in {r[0] for r in rows}:
        mine = sorted((r["s"], r["v"]) for r in out if r["k"] == k)
        assert len(mine) == sum(r[0] == k for r in rows) and mine[0][0] == 0
        spans = sorted((r["s"], r["s"] + r["v"]) for r in out if r["k"] == k)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == sum(r[2] for r in rows if r[0] == k)


def test_pipeline_stages_equal_brute_force(spark):
    """Every stage over what the one before it kept: rows and texts, recomputed in Python (the classifier from its columns)."""
    import zlib

    import duckdb

    from newsloom.llm import decontaminate, mixing, sql

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows, now = lambda d: sorted(tuple(r) for r in d.select(*docs.columns).collect()), docs

    # quality: the rows whose evidence, moved by their sites', says neither poor nor toxic
    models = Q.train(now, table(spark, sf, "labels"))
    source = now.collect()
    f = Q.features(pa.array([r["text"] for r in source]))
    bad = {}
    for k, m in enumerate(models):
        logit = m.logit(*f)
        moved = sites_by_hand([(r["source"], r["lang"], float(x)) for r, x in zip(source, logit, strict=True)])
        bad[k] = [x + Q.WEIGHT * o >= 0 for x, o in zip(logit, moved, strict=True)]
    kept = C.quality_stage(spark, now, sf).cache()
    assert rows(kept) == sorted(tuple(r) for r, x, y in zip(source, bad[0], bad[1], strict=True) if not x and not y) and 0 < kept.count() < len(source)

    # near duplicates: the smallest id of each component, by SQL
    frame, now = kept.toPandas(), kept
    want = duckdb.sql(sql.NGRAM_JOIN.replace("FROM documents", "FROM frame")).df()
    kept = C.near_duplicate_stage(spark, now, sf).cache()
    assert rows(kept) == rows(now.where(F.col("doc_id").isin(want[want.doc_id == want.component_id].doc_id.tolist())))

    # decontamination: texts without their passages, word by word
    now, out = kept, []
    width, items = decontaminate.WINDOW, [decontaminate.words(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    found = {tuple(w[i : i + width]) for w in items if w for i in range(max(1, len(w) - width + 1))}
    lengths = {len(w) for w in found}
    for r in now.collect():
        w, spans = decontaminate.words(r["text"]), [m.span() for m in decontaminate._WORD.finditer(r["text"] or "")]
        hit = set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        # what stands between two hit words goes with them
        gone = {c for p in hit for c in range(spans[p][0], spans[p + 1][0] if p + 1 in hit else spans[p][1])}
        text = "".join(c for k, c in enumerate(r["text"]) if k not in gone) if hit else r["text"]
        out.append((r["doc_id"], text, r["lang"], r["source"], len(text) if hit else r["n_chars"]))
    kept = C.decontamination_stage(spark, now, sf).cache()
    assert rows(kept) == sorted(out)

    # mixing: every piece is its document's text in a block, as often as the slots take the block
    now, want = kept, []
    plan = mixing.Mix(now)
    slots = {}
    for r in plan.slot_table().collect():
        slots[r["s"], r["block"]] = slots.get((r["s"], r["block"]), 0) + 1
    texts = {r["doc_id"]: r for r in now.collect()}
    for r in plan.packed.where("size > 0").collect():
        doc = texts[r["doc_id"]]
        words = re.findall(r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", doc["text"])
        assert len(words) == r["size"] and "".join(words) == doc["text"]
        for block in range(r["start"] // 256, (r["start"] + r["size"] - 1) // 256 + 1):
            piece = "".join(words[max(0, block * 256 - r["start"]) : max(0, (block + 1) * 256 - r["start"])])
            want += [(doc["doc_id"], piece, doc["lang"], doc["source"], len(piece))] * slots.get((r["s"], block), 0)
    kept = C.mixing_stage(spark, now, sf).cache()
    assert kept.columns == docs.columns and rows(kept) == sorted(want)

    # sharding: all rows, gapless slots, near-equal bytes
    out = C.sharding_stage(spark, kept, sf).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in out) == rows(kept)
    totals, places = [0] * 16, [[] for _ in range(16)]
    for r in out:
        totals[r["shard"]] += len(r["text"].encode()) + 1
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places) and max(totals) - min(totals) < 0.05 * sum(totals) / 16
    whole = sorted((r["doc_id"], zlib.crc32(r["text"].encode()), r["shard"], r["slot"]) for r in C.run(spark, sf).collect())
    assert whole == sorted((r["doc_id"], zlib.crc32(r["text"].encode()), r["shard"], r["slot"]) for r in out)


def test_pipeline_of_nothing(spark, none):
    now = none
    for _, stage in C.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001")
    assert now.count() == 0
