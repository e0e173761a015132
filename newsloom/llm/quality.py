"""Quality classifier: document evidence shrunk toward site posteriors by hierarchical empirical Bayes.

Two logistic models, of poor quality and of toxicity, are trained on at most SAMPLE labelled rows and SAMPLE_BYTES of
their texts (those of the smallest id hashes, a documented bound; conflicting labels of one id count as the larger); their features are shares of character kinds,
repetition, and chosen words and beginnings of words of the whole text. Every document's probability is evidence.

Sites have two levels, host (`source`) and path (`source`, `lang`). Grouped sums of the evidence give
each level's mean; a beta prior shrinks a path toward its host and a host toward the global mean, the more the sparser it
is. The prior's strength comes from the variance between the level's sites by the method of moments: of the spread of the
sites' means, what their documents' own spread explains is taken off, so that sparse sites that differ by chance alone
are shrunk whole. A document's log-odds then move by WEIGHT times the log-odds of its path's posterior, from all other
documents' evidence, over the global mean.

Defined results: a null or empty text has neutral features and is judged like an empty one; null
hosts and paths form sites of their own; without labelled rows, or with one class alone, evidence is
the share of that class and nothing is rejected unless it is over one half; an empty table gives no
rows; repeated rows are judged one by one; clashing columns of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.llm.common import arrow_map, cut, table, without
from newsloom.llm.shingles import _words, mixed, shingle_sets

SAMPLE, SAMPLE_BYTES = 6000, 64_000_000
SURE = 5.5
MIN_TEXTS = 4
STEMS = (4, 5)  # bytes of the beginnings of words that are features
WEIGHT = 0.3
#: Sites are broadcast up to this many paths; above, they join by a shuffle.
MAX_PATHS = 200_000
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_KINDS = [np.array([chr(b) in group for b in range(256)]) for group in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "|\\/_", "#$%&*+=<>@^~", ".,;:", "\n")]
N_DENSE = len(_KINDS) + 5


def _beginnings(folded: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the first k bytes of all longer words: words of one stem share them."""
    begins = begins[begins + k < len(folded)]
    first = [folded[begins + i].astype(np.uint64) for i in range(k)]
    whole = np.logical_and.reduce([f != 32 for f in first]) if len(begins) else np.zeros(0, bool)
    code = sum(f << np.uint64(8 * i) for i, f in enumerate(first))[whole] if len(begins) else np.zeros(0, np.uint64)
    return mixed(np.unique(code) ^ np.uint64(k << 56))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense features, and the hashes of all texts' distinct words and beginnings with the bounds of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    dense, words, bounds = np.zeros((n, N_DENSE)), [], [0]
    for i in range(n):
        raw = np.frombuffer(texts[i].as_buffer(), np.uint8)
        size = max(len(raw), 1)
        folded = _FOLD[raw]
        begins, h = _words(folded, np.array([0, len(raw)])) if len(raw) else (np.zeros(0, int), np.zeros(0, np.uint64))
        uniq = np.unique(h)
        shares = np.bincount(raw, minlength=256) / size
        most = int((h[1:] == h[:-1]).sum()) / max(len(h) - 1, 1) if len(h) else 0.0
        dense[i] = [*[min(shares[k].sum() * 10, 3.0) for k in _KINDS], len(uniq) / max(len(h), 1), 3 * most, min(size / max(len(h), 1), 20) / 10, np.log1p(len(h)) / 10, 3.0 * (len(h) < 5)]
        uniq = np.concatenate([uniq, *(_beginnings(folded, begins, k) for k in STEMS)])
        words.append(uniq)
        bounds.append(bounds[-1] + len(uniq))
    return dense, np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(bounds)


class Model:
    """Logistic regression on dense features and on the words that differ most surely between the classes.

    A word is used when its share of texts differs by SURE standard errors; this leaves out the many
    words that a sample knows from one text and its copies.
    """

    def __init__(self, dense, keys, at, row, y, l2=1e-4, steps=500):
        """keys: the words, sorted; at and row: for each word of a text, its number and its text's."""
        self.mean, self.std = dense.mean(0), dense.std(0) + 1e-3
        self.w, self.v, self.keys = np.zeros(dense.shape[1]), np.zeros(0), np.zeros(0, np.uint64)
        n, yes = len(y), y.sum()
        rate = (yes + 1) / (n + 2)
        self.b = float(np.log(rate / (1 - rate)))
        if not 0 < yes < n:
            return
        a, b = np.bincount(at, y[row], len(keys)), np.bincount(at, 1 - y[row], len(keys))
        p = (a + b + 1) / (n + 2)
        z = (a / yes - b / (n - yes)) / np.sqrt(p * (1 - p) * (1 / yes + 1 / (n - yes)))
        sure = np.abs(z) > SURE
        self.keys = keys[sure]
        x = np.zeros((n, dense.shape[1] + len(self.keys)), np.float32)
        x[:, : dense.shape[1]] = (dense - self.mean) / self.std
        hit = sure[at]
        x[row[hit], dense.shape[1] + (np.cumsum(sure) - 1)[at[hit]]] = 1
        w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, steps + 1):
            r = (1 / (1 + np.exp(-np.clip(self.b + x @ w, -30, 30))) - y) / n
            g = np.append(x.T @ r + l2 * w, r.sum())
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            d = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            w, self.b = w - d[:-1], self.b - float(d[-1])
        self.w, self.v = w[: dense.shape[1]], w[dense.shape[1] :]

    def _found(self, words) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, words), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == words if len(self.keys) else np.zeros(len(words), bool)

    def logit(self, dense, words, bounds) -> np.ndarray:
        at, hit = self._found(words)
        sums = np.append(0, np.cumsum(np.where(hit, self.v[at] if len(self.v) else 0.0, 0.0)))
        return np.clip(self.b + ((dense - self.mean) / self.std) @ self.w + sums[bounds[1:]] - sums[bounds[:-1]], -12, 12)


def _originals(texts: pa.Array) -> np.ndarray:
    """False for texts that share one of three smallest shingles with an earlier one: a text and its
    copies would else make all of its words look sure."""
    keep, seen = np.ones(len(texts), bool), [set(), set(), set()]
    for i, s in enumerate(shingle_sets(texts)):
        if len(s):
            heads = int(s[0]), int(mixed(s).min()), int(mixed(~s).min())
            keep[i] = not any(h in known for h, known in zip(heads, seen, strict=True))
            for h, known in zip(heads, seen, strict=True):
                known.add(h)
    return keep


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, Model]:
    """Models of poor quality and of toxicity from a bounded sample of labelled rows."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    # a window over the sample alone
    rows = rows.withColumn("_sum", F.sum("_bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "_bytes").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("_sum") <= SAMPLE_BYTES).select("text", "quality", "toxic").toArrow()
    if not rows.num_rows:
        rows = pa.table({"text": [""], "quality": [1], "toxic": [0]})
    rows = rows.filter(pa.array(_originals(rows.column("text").combine_chunks())))
    dense, words, bounds = features(rows.column("text").combine_chunks())
    # words of fewer than MIN_TEXTS texts are never sure: most words go here
    keys, counts = np.unique(words, return_counts=True)
    keys = keys[counts >= MIN_TEXTS]
    at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0)).astype(np.int32)
    known = keys[at] == words if len(keys) else np.zeros(len(words), bool)
    row = np.repeat(np.arange(len(dense), dtype=np.int32), np.diff(bounds))[known]
    f = dense, keys, at[known], row
    del words, counts
    bad = (rows.column("quality").to_numpy() == 0).astype(float)
    toxic = (rows.column("toxic").to_numpy() == 1).astype(float)
    return Model(*f, bad), Model(*f, toxic)


def scored(docs: DataFrame, models: tuple[Model, Model], carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns with the evidence's log-odds, e_bad and e_toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    used = docs.select(*dict.fromkeys([*carry, text]))
    schema = T.StructType([used.schema[c] for c in carry] + [T.StructField("e_bad", T.DoubleType()), T.StructField("e_toxic", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, toxic = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                f = features(b.column(text))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(bad.logit(*f)), pa.array(toxic.logit(*f))], names=schema.names)

    return arrow_map(used, run, schema)


def _p(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


KINDS = ("bad", "toxic")


def strength(free: int, base: float, spread: float, within: float, left: int, mean: float) -> float:
    """A beta prior's size by the method of moments, from the variance between sites.

    spread: the sum over sites of size times squared distance of their mean from the level above; by chance alone, with
    no difference between sites, it is free (sites less levels above) times the documents' variance, which is within
    (squared distances from the own site's mean) over left (documents less sites), or that of a coin where no site has
    two documents. What is more, over base (documents less the sum of squared sizes over those of the level above), is
    the variance between sites. With none the prior is as strong as may be.
    """
    chance = within / left if left > 0 else mean * (1 - mean)
    v = max((spread - free * chance) / base, 1e-9) if base > 0 else 1e-9
    return min(max(mean * (1 - mean) / v - 1, 1.0), 1e6)


def posteriors(evidence: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """For each (host, path): n and hn, its and its host's documents, and for each kind the sums s_ and hs_ of their
    evidence, with the sizes c_ and hc_ of the priors and the global mean mu_ (equal in all rows)."""
    sums = lambda p, of: [F.sum(of).alias(f"s_{p}")]
    paths = evidence.groupBy(host, path).agg(F.count("*").alias("n"), *[x for k in KINDS for x in (*sums(k, _p(F.col(f"e_{k}"))), F.sum(F.pow(_p(F.col(f"e_{k}")), 2)).alias(f"q_{k}"))])
    paths = cut(paths)
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), *[x for k in KINDS for x in (F.sum(f"s_{k}").alias(f"hs_{k}"), F.sum(f"q_{k}").alias(f"hq_{k}"))])
    named = hosts.withColumnRenamed(host, "_host")
    both = cut(paths.join(named, paths[host].eqNullSafe(named["_host"])).drop("_host"))
    hosts = both.groupBy(host).agg(F.first("hn").alias("hn"), *[F.first(f"h{x}_{k}").alias(f"h{x}_{k}") for k in KINDS for x in "sq"])
    total = hosts.agg(F.count("*").alias("k"), F.sum("hn").alias("n"), F.sum(F.col("hn") * F.col("hn")).cast("double").alias("squares"), *[F.sum(f"hs_{k}").alias(k) for k in KINDS],
                      *[F.sum(F.greatest(F.col(f"hq_{k}") - F.col(f"hs_{k}") * F.col(f"hs_{k}") / F.col("hn"), F.lit(0.0))).alias(f"w_{k}") for k in KINDS]).first()
    if not total["n"]:
        return both.select(host, path, "n", "hn", *[c for k in KINDS for c in (F.lit(0.0).alias(f"s_{k}"), F.lit(0.0).alias(f"hs_{k}"), F.lit(1.0).alias(f"c_{k}"), F.lit(1.0).alias(f"hc_{k}"), F.lit(0.5).alias(f"mu_{k}"))])
    mu = {k: min(max(total[k] / total["n"], 1e-6), 1 - 1e-6) for k in KINDS}
    over = hosts.agg(*[F.sum(F.col("hn") * F.pow(F.col(f"hs_{k}") / F.col("hn") - mu[k], 2)).alias(k) for k in KINDS]).first()
    n = total["n"]
    hc = {k: strength(total["k"] - 1, n - total["squares"] / n, over[k], total[f"w_{k}"], n - total["k"], mu[k]) for k in KINDS}
    inner = both.agg(F.count("*").alias("k"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("squares"),
                     *[F.sum(F.col("n") * F.pow(F.col(f"s_{k}") / F.col("n") - F.col(f"hs_{k}") / F.col("hn"), 2)).alias(f"o_{k}") for k in KINDS],
                     *[F.sum(F.greatest(F.col(f"q_{k}") - F.col(f"s_{k}") * F.col(f"s_{k}") / F.col("n"), F.lit(0.0))).alias(f"w_{k}") for k in KINDS]).first()
    c = {k: strength(inner["k"] - total["k"], n - inner["squares"], inner[f"o_{k}"], inner[f"w_{k}"], n - inner["k"], mu[k]) for k in KINDS}
    return cut(both.select(host, path, "n", "hn", *[x for k in KINDS for x in (F.col(f"s_{k}"), F.col(f"hs_{k}"), F.lit(c[k]).alias(f"c_{k}"), F.lit(hc[k]).alias(f"hc_{k}"), F.lit(mu[k]).alias(f"mu_{k}"))]))


_SITE = ["n", "hn", *[f"{x}_{k}" for k in KINDS for x in ("s", "hs", "c", "hc", "mu")]]


def judged(evidence: DataFrame, sites: DataFrame, host: str = "source", path: str = "lang", weight: float = WEIGHT) -> DataFrame:
    """evidence with p_bad, p_toxic, site_bad, site_toxic and keep. A document's own evidence is no part of its site's."""
    sites = sites.select(F.col(host).alias("_h"), F.col(path).alias("_l"), *[F.col(c).alias(f"_{c}") for c in _SITE])
    if sites.count() <= MAX_PATHS:
        sites = F.broadcast(sites)
    out = evidence.join(sites, evidence[host].eqNullSafe(sites["_h"]) & evidence[path].eqNullSafe(sites["_l"]), "left")
    for k in KINDS:
        own = _p(F.col(f"e_{k}"))
        above = (F.col(f"_hc_{k}") * F.col(f"_mu_{k}") + F.greatest(F.col(f"_hs_{k}") - own, F.lit(0.0))) / (F.col(f"_hc_{k}") + F.col("_hn") - 1)
        here = (F.col(f"_c_{k}") * above + F.greatest(F.col(f"_s_{k}") - own, F.lit(0.0))) / (F.col(f"_c_{k}") + F.col("_n") - 1)
        out = out.withColumn(f"site_{k}", F.coalesce(_logit(here) - _logit(F.col(f"_mu_{k}")), F.lit(0.0)))
        out = out.withColumn(f"p_{k}", _p(F.col(f"e_{k}") + weight * F.col(f"site_{k}")))
    return out.withColumn("keep", (F.col("p_bad") < 0.5) & (F.col("p_toxic") < 0.5)).drop("_h", "_l", "e_bad", "e_toxic", *[f"_{c}" for c in _SITE])


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected ones. The texts are scored once and written with their evidence; they cross no shuffle."""
    docs = without(docs, "e_bad", "e_toxic", "p_bad", "p_toxic", "site_bad", "site_toxic", "keep", "_h", "_l", *[f"_{c}" for c in _SITE])
    evidence = cut(scored(docs, train(docs, labels, **options), docs.columns))
    return judged(evidence, posteriors(evidence)).where("keep").select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = cut(scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id", "source", "lang"]))
    out = judged(evidence, posteriors(evidence))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_bad", "p_toxic", "site_bad", "site_toxic")], "keep")
