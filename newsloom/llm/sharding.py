"""Sharding: size-weighted sampled splitters, exact cumulative sizes, overfull ranges subdivided.

Rows are ordered by (hash of the text, hash of the id), so equal texts stand together. A sample
drawn with probability in proportion to size gives quantile boundaries; the boundaries cut the order
into ranges of near-equal bytes, a text that fills more than one range is cut by the id's hash, and
a range that the sample misjudged is subdivided. Sums inside ranges plus the ranges' offsets give
every row its exact place in the order, and places map to shards.

Under the law of bytes, what is large against a shard is dealt first, the largest to the emptiest shard: equal texts of
together over 1 / LARGE of a shard (up to TOGETHER they stay in one shard, beyond it they may be parted), and single rows
of that size among the parted ones. There are at most LARGE of them for each shard. The others fill the shards up to one
level, with cuts that miss it by half a small text at most.

Laws: `bytes` (near equal sizes), `rows` (counts at most one apart), `key` (rendezvous hashing of
the id: one more shard takes rows only into itself).

Defined results: a null text counts as empty (size 1); an empty table gives no rows; repeated rows
each get a slot of their own; columns of the input that clash with output columns are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import cut, table, without

SHARDS = 16
#: Expected number of sampled keys (the only rows that reach the driver) and number of ranges.
SAMPLE, RANGES, FANOUT = 8192, 256, 16
#: Equal texts of up to this share of a shard's quota stay in one shard.
TOGETHER = 0.25
#: Texts of over this part of a shard are dealt one by one, by the driver.
LARGE = 64

_LIGHT = ["_k1", "_k2", "_w", "_u"]
_SINGLE = -2


def _splitters(rows: DataFrame, total: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample of keys; at most RANGES - 1."""
    rate = F.col("_w") * F.lit(SAMPLE / max(total, 1))
    u = F.pmod(F.xxhash64("_k1", "_k2", F.lit(17)), F.lit(1 << 50)) / F.lit(float(1 << 50))
    got = sorted((r[0], r[1], max(1.0, r[2])) for r in rows.where(u < rate).select("_k1", "_k2", rate.cast("double")).collect())
    whole, now, out = sum(w for *_, w in got), 0.0, []
    for k1, k2, w in got:
        if now >= whole * (len(out) + 1) / RANGES and len(out) < RANGES - 1:
            # the first cut at a text goes before all its copies; only later cuts go between them
            cut_at = (k1, k2) if out and out[-1][0] == k1 else (k1, -(1 << 63))
            if not out or cut_at > out[-1]:
                out.append(cut_at)
        now += w
    return out


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below a row's key, searched in two levels."""
    if not splitters:
        return F.lit(0)

    def literal(part):
        return F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in part])

    def below(found: Column) -> Column:
        key = F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b"))
        return F.size(F.filter(found, lambda s: s <= key))

    blocks = [splitters[i : i + FANOUT] for i in range(0, len(splitters), FANOUT)]
    heads, fine = literal([b[0] for b in blocks]), F.array(*[literal(b) for b in blocks])
    at = below(heads)
    return F.when(at == 0, 0).otherwise((at - 1) * FANOUT + below(F.element_at(fine, F.greatest(at, F.lit(1)))))


class _Deal:
    """Large texts dealt to shards: units (all rows of a text) and single rows, each with shard and first slot."""

    def __init__(self, rows: DataFrame, total: int, n_shards: int, law: str):
        self.cap = total / (LARGE * n_shards)
        self.units, self.parted, self.singles = [], [], []
        if law == "bytes" and total:
            for r in rows.groupBy("_k1").agg(F.sum("_w").alias("w"), F.count("*").alias("n")).where(F.col("w") > self.cap).collect():
                (self.units if r["w"] <= TOGETHER * total / n_shards else self.parted).append((r["_k1"], r["w"], r["n"]))
            self.units.sort()
            if self.parted:
                some = rows.where(F.col("_k1").isin([k for k, *_ in self.parted]) & (F.col("_w") > self.cap)).select("_k1", "_k2", "_w").collect()
                self.singles = sorted(tuple(r) for r in some)
        things = sorted([(-w, 0, i, n) for i, (_, w, n) in enumerate(self.units)] + [(-w, 1, i, 1) for i, (*_, w) in enumerate(self.singles)])
        load, self.taken = [(0, k) for k in range(n_shards)], [0] * n_shards
        self.placed: list[list[tuple[int, int]]] = [[(0, 0)] * len(self.units), [(0, 0)] * len(self.singles)]
        for w, kind, i, n in things:
            b, k = heapq.heappop(load)
            self.placed[kind][i] = (k, self.taken[k])
            self.taken[k] += n
            heapq.heappush(load, (b - w, k))
        loads = [b for b, _ in sorted(load, key=lambda x: x[1])]
        self.rest = total - sum(loads)
        # the level to which what is left fills the shards
        level, order = 0.0, sorted(loads)
        for m in range(1, n_shards + 1):
            level = (self.rest + sum(order[:m])) / m
            if m == n_shards or level <= order[m]:
                break
        self.ends, now = [], 0.0
        for b in loads:
            now += max(level - b, 0.0)
            self.ends.append(now)

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows with _u: the number of its unit, _SINGLE, or null for those that fill up."""
        marks = [(k, i) for i, (k, *_) in enumerate(self.units)] + [(k, _SINGLE) for k, *_ in self.parted]
        if not marks:
            return rows.withColumn("_u", F.lit(None).cast("int"))
        small = rows.sparkSession.createDataFrame(marks, "_k long, _u int")  # at most LARGE a shard
        both = rows.join(F.broadcast(small), rows["_k1"] == small["_k"], "left").drop("_k")
        return both.withColumn("_u", F.when((F.col("_u") >= 0) | (F.col("_w") > self.cap), F.col("_u")))


def _placed(rows: DataFrame, deal: _Deal, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds shard and _row: the row's place in the order of those that fill up, or its slot if it was dealt (_u)."""
    ranged = rows.withColumn("_range", F.when(F.col("_u").isNull(), _range_of(splitters)).when(F.col("_u") == _SINGLE, -(1 << 30)).otherwise(-1 - F.col("_u")))
    fill = F.col("_u").isNull()
    per = ranged.where(fill).groupBy("_range").agg(F.sum("_w").alias("bytes"), (F.min("_k1") == F.max("_k1")).alias("one"))
    mean = deal.rest / max(1, len(splitters) + 1)
    over = {r["_range"]: (int(-(-r["bytes"] // mean)), r["one"]) for r in per.where(F.col("bytes") > 2 * mean).collect()}
    sub = F.lit(0)
    for r, (n, one) in over.items():
        sub = F.when(fill & (F.col("_range") == r), F.pmod(F.xxhash64("_k2" if one else "_k1", F.lit(3)), F.lit(n)).cast("int")).otherwise(sub)
    ranged = ranged.withColumn("_sub", sub)
    # one row a range reaches this window: at most RANGES and its subdivisions
    small = ranged.where(fill).groupBy("_range", "_sub").agg(F.sum("_w").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small.select("_range", "_sub", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_on"))
    inner = Window.partitionBy("_range", "_sub").orderBy("_k1", "_k2", "_w")
    mine = ranged.withColumns({"_n": F.row_number().over(inner) - 1, "_b": F.coalesce(F.sum("_w").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    text = Window.partitionBy("_range", "_sub", "_k1")
    mine = mine.withColumns({"_gb": F.min("_b").over(text), "_gw": F.sum("_w").over(text)})
    full = mine.join(F.broadcast(offsets), ["_range", "_sub"], "left")
    middle = F.when(F.col("_gw") <= F.lit(deal.cap), F.col("_gb") + F.col("_gw") / 2).otherwise(F.col("_b") + F.col("_w") / 2)
    ends = F.array(*[F.lit(float(e)) for e in deal.ends])
    shard = F.least(F.lit(len(deal.ends) - 1), F.size(F.filter(ends, lambda e: e <= F.col("_ob") + middle)))

    def dealt(kind, at, what):
        return F.get(F.array(*[F.lit(x[what]).cast("long") for x in deal.placed[kind]]), at) if deal.placed[kind] else F.lit(None).cast("long")

    single = F.col("_u") == _SINGLE
    chosen = F.when(fill, shard).when(single, dealt(1, F.col("_n"), 0)).otherwise(dealt(0, F.col("_u"), 0)).cast("int")
    row = F.when(fill, F.col("_on") + F.col("_n")).when(single, dealt(1, F.col("_n"), 1)).otherwise(dealt(0, F.col("_u"), 1) + F.col("_n")).cast("long")
    return full.select(*rows.columns, chosen.alias("shard"), row.alias("_row"))


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, law: str = "bytes", doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, reuse: bool = True) -> DataFrame:
    """The carried columns with size, law, shard, slot and grown_shard.

    reuse: write the light rows (keys, sizes, carried columns) once; without it they are computed
    in each pass, which spares the disk where the carried columns hold the texts.
    """
    docs = without(docs, "size", "law", "shard", "slot", "grown_shard", "_k1", "_k2", "_w", "_u", "_row", "_range", "_sub", "_first")
    carry = docs.columns if carry is None else carry
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    rows = docs.select(*carry, size.alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k1"), F.xxhash64(F.col(doc_id)).alias("_k2"), (F.lit(1).cast("long") if law == "rows" else size).alias("_w"))
    if reuse:
        rows = cut(rows)
    if law == "key":
        def winner(n):
            drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(F.xxhash64("_k2", s).alias("h"), s.alias("s")))
            return F.array_max(drawn)["s"].cast("int")
        rows = rows.withColumns({"shard": winner(n_shards), "grown_shard": winner(n_shards + 1), "_part": F.pmod(F.xxhash64("_k2", F.lit(5)), F.lit(RANGES))})
        inner = Window.partitionBy("shard", "_part").orderBy("_k1", "_k2")
        before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = rows.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_on"))
        full = rows.withColumn("_n", F.row_number().over(inner) - 1).join(F.broadcast(offsets), ["shard", "_part"])
        return full.select(*carry, "size", F.lit(law).alias("law"), "shard", (F.col("_on") + F.col("_n")).alias("slot"), "grown_shard")
    total = rows.agg(F.sum("_w")).first()[0] or 0
    deal = _Deal(rows, total, n_shards, law)
    rows = deal.marked(rows)
    splitters = _splitters(rows.where("_u is null"), deal.rest)
    placed = _placed(rows, deal, splitters)
    if reuse:
        placed = light = cut(placed)
    else:
        light = _placed(rows.select(*_LIGHT), deal, splitters)
    first = light.where("_u is null").groupBy("shard").agg(F.min("_row").alias("_first"))
    taken = F.get(F.array(*[F.lit(x).cast("long") for x in deal.taken]), F.col("shard"))
    out = placed.join(F.broadcast(first), "shard", "left")
    slot = F.when(F.col("_u").isNull(), taken + F.col("_row") - F.col("_first")).otherwise(F.col("_row"))
    return out.select(*carry, "size", F.lit(law).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    out = shard_documents(docs, carry=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
