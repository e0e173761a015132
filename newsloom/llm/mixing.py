r"""Mixing sources to target weights by blocks.

The words of a source, document after document, are packed into blocks of a fixed length. Every
output shard draws how many of its slots each source fills: a source's slots are dealt to the shards by a multinomial
draw, made as binomial draws down a binary tree of shards, so that the sources' totals are met exactly, at any size, and
no draw needs more than one source. A source's slots map to its blocks through a seeded permutation of block numbers, a
new one for each pass over the source; slots and blocks then join by number.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `share` times
all sizes; a target stops at `most` times its source's size and the excess is shared anew by weight.

Any number of sources will do: they are a table, and the driver sees sums over them alone. Broadcasts stand behind a
count (SMALL); beyond it the join is a shuffle, whose hot keys adaptive execution splits.

Defined results: a null or wordless text has size 0 and takes nothing; an empty table gives no rows;
null sources form one source; repeated rows are packed and counted one by one; rows with a null id are
packed, counted and returned like all others (nulls are equal ids); clashing columns of the input are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import cut, python_path, running, table, without

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK = 256  # words
SHARD_WORDS = 1 << 20
BUCKET = 500  # documents of a source that are summed in one window
SMALL = 100_000  # sources whose row of numbers is broadcast
UNIT = 1 << 16  # slots that one call draws, about
_SPACES = r"\x20\x09-\x0D"
#: A word with the white space after it (and, for the first, before it): the pieces of a text add up to it.
_PIECE = rf"(?:\A[{_SPACES}]+)?[^{_SPACES}]+[{_SPACES}]*"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (s, size) with target: shares by weight, capped at `most` times the size, the excess reshared until none is above.

    A round closes the sources whose share is above their cap; one row of sums reaches the driver in each.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("s", F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("size") * F.lit(float(most))
    unit, closed = 0.0, -1
    while True:
        over = F.lit(unit) * w > cap
        r = sources.agg(F.sum("size"), F.sum(F.when(over, F.col("size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(w)), F.count(F.when(over, 1))).first()
        if not r[0] or not r[2] or r[3] == closed:
            break
        unit, closed = (share * r[0] - most * r[1]) / r[2], r[3]
    return sources.withColumn("target", F.when(over, cap).otherwise(F.lit(unit) * w).cast("double"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with s, their place in code-point order of source, null last; one count a task reaches the driver."""
    rows = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    per = {r[0]: r[1] for r in rows.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).count().collect()}
    before, now = [0] * (max(per, default=0) + 1), 0
    for p in sorted(per):
        before[p], now = now, now + per[p]
    place = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.shiftright("_at", 33).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("s", place).drop("_at")


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of i under a pseudorandom permutation of range(n): a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), i.astype(np.uint64)

    def once(x):
        a, b = x >> np.uint64(half), x & mask
        for r in range(6):
            f = (b + np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            a, b = b, a ^ (f & mask)
        return (a << np.uint64(half)) | b

    with np.errstate(over="ignore"):
        out = once(out)
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def shard_draw(slots: int, s: int, shards: int, seed: int, depth: int = 0, path: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(shards, counts, slots before them) of a source's multinomial draw over equal shards, for one node of the tree.

    Each node sends its slots to its two halves by a binomial draw that the node's own seed decides; depth and path name the
    node, so that a large source is drawn in many calls which agree.
    """
    lo, hi, n, before = 0, shards, slots, 0

    def left(lo, hi, n):
        mid = (lo + hi) // 2
        return mid, int(np.random.default_rng([seed, s, lo, hi]).binomial(n, (mid - lo) / (hi - lo))) if n else 0

    for d in range(depth):
        bit = path >> (depth - 1 - d) & 1
        if hi - lo == 1:  # a single shard is the left half of itself
            n = 0 if bit else n
            continue
        mid, k = left(lo, hi, n)
        lo, hi, n, before = (mid, hi, n - k, before + k) if bit else (lo, mid, k, before)
    found, todo = [], [(lo, hi, n)]
    while todo:
        lo, hi, n = todo.pop()
        if n and hi - lo == 1:
            found.append((lo, n))
        elif n:
            mid, k = left(lo, hi, n)
            todo += [(mid, hi, n - k), (lo, mid, k)]
    return np.array([a for a, _ in found], np.int64), np.array([n for _, n in found], np.int64), before


class Mix:
    """The plan of a mix: sources with targets, packed documents, slots."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, block: int = BLOCK, weights=WEIGHTS, share: float = SHARE, most: float = MOST):
        self.spark = docs.sparkSession
        self.block, self.seed = block, seed
        n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(rf"[^{_SPACES}]+")), F.lit(0)).cast("long")
        sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words.alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie")))
        found = targets(numbered(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))), weights, share, most)
        blocks = F.ceil(F.col("size") / block).cast("long")
        slots = F.least(F.floor(blocks * float(most)), F.round(F.col("target") * blocks / F.col("size"))).cast("long")
        self.sources = cut(found.select("s", "source", F.col("size").alias("source_size"), "target", blocks.alias("blocks"), F.when(F.col("size") > 0, slots).otherwise(0).cast("long").alias("slots"), F.ceil(F.col("rows") / BUCKET).cast("int").alias("buckets")))
        n, total = self.sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
        self.shards = max(1, -(-total * block // SHARD_WORDS))
        light = self.sources.select(F.col("source").alias("_source"), "s", "source_size", "target", "buckets")
        mine = sized.join(F.broadcast(light) if n <= SMALL else light, sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
        self.packed = cut(running(mine, ["s"], [F.col("doc_id"), F.col("tie")], {"start": F.col("size")}, buckets=F.col("buckets")).drop("buckets"))

    def slot_table(self) -> DataFrame:
        """(shard, s, nth, block): one row a slot of the output; nth: the slot's number among its source's."""
        shards, seed = self.shards, self.seed
        depth = F.least(F.lit(shards.bit_length() - 1), F.greatest(F.floor(F.log2(F.col("slots") / UNIT)), F.lit(0))).cast("int")
        units = self.sources.where("slots > 0").select("s", "slots", "blocks", depth.alias("depth"))
        units = units.withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, depth)") - 1)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s, slots, blocks, depth, path in zip(*(b[c].tolist() for c in ("s", "slots", "blocks", "depth", "path")), strict=True):
                    which, counts, before = shard_draw(slots, s, shards, seed, depth, path)
                    shard, nth = np.repeat(which, counts), before + np.arange(int(counts.sum()))
                    at = np.empty(len(nth), np.int64)
                    for epoch in np.unique(nth // blocks).tolist():
                        now = nth // blocks == epoch
                        at[now] = permuted(nth[now] % blocks, blocks, seed * 1_000_003 + s * 101 + epoch)
                    yield pd.DataFrame({"shard": shard, "s": np.full(len(nth), s, np.int64), "nth": nth, "block": at})

        python_path(self.spark)
        wide = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return units.repartition(wide, "s", "path").mapInPandas(run, "shard long, s long, nth long, block long")

    def uses(self) -> DataFrame:
        """(s, block, uses): how often the slots take each block that they take."""
        return self.slot_table().groupBy("s", "block").agg(F.count("*").alias("uses"))

    def pieces(self) -> DataFrame:
        """(doc_id, tie, s, start, size, block, words): the part of each document in each block."""
        end = F.col("start") + F.col("size")
        rows = self.packed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / self.block), F.floor((end - 1) / self.block))))
        return rows.withColumns({"lo": F.greatest("start", F.col("block") * self.block), "hi": F.least(end, (F.col("block") + 1) * self.block)})

    def taken(self) -> DataFrame:
        """One row a document: s, doc_id, tie, size, source_size, target, taken."""
        # the planner takes the slots for a small table: without the hint it would broadcast one row a block
        got = self.pieces().join(self.uses().hint("merge"), ["s", "block"], "left")
        key = ["s", "start", "doc_id", "tie", "size", "source_size", "target"]
        full = got.groupBy(*key).agg(F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.coalesce("uses", F.lit(0))), F.lit(0)).alias("taken"))
        none = self.packed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        cols = ["s", "doc_id", "tie", "size", "source_size", "target", "taken"]
        return full.select(*cols).unionByName(none.select(*cols))

    def texts(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(shard, slot, text): the mix itself, one block of words a slot (at most `block` pieces each), in a drawn order."""
        words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.regexp_extract_all(text, F.lit(rf"[^{_SPACES}]+"), F.lit(0)).alias("w")).dropDuplicates(["doc_id", "tie"])
        pieces = self.pieces()
        parts = pieces.join(words, pieces["doc_id"].eqNullSafe(words["doc_id"]) & (pieces["tie"] == words["tie"])).select("s", "block", "start", F.array_join(F.slice("w", (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ").alias("t"))
        whole = parts.groupBy("s", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "t"))), lambda x: x["t"]), " ").alias("text"))
        order = Window.partitionBy("shard").orderBy(F.xxhash64("s", "nth", F.lit(self.seed)), "s", "nth")
        placed = self.slot_table().withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
        return placed.hint("merge").join(whole, ["s", "block"]).select("shard", "slot", "text")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows as the mix takes them: one row for each piece of a document in a block, as often as slots take the block.

    A piece is the part of the text that lies in the block, white space included; it keeps its document's other columns.
    So sources keep their targets to within a block, and the pieces of a document that is taken once add up to its text.
    Documents without words are never taken.
    """
    plan = Mix(docs, **options)
    at = [options.get(k, k) for k in ("doc_id", "text", "source")]
    key = F.struct("doc_id", "source", "tie").alias("_key")  # structs are equal where both have a null id or source
    part = F.struct((F.col("lo") - F.col("start")).cast("int").alias("from"), (F.col("hi") - F.col("lo")).cast("int").alias("n"), F.col("uses").cast("int").alias("uses"))
    used = plan.pieces().join(plan.uses().hint("merge"), ["s", "block"]).groupBy("doc_id", "source", "tie", "start").agg(F.collect_list(part).alias("_parts")).select(key, "start", "_parts")
    docs = without(docs, "_key", "_parts", "_nth", "_p")
    keyed = docs.withColumn("_key", F.struct(F.col(at[0]).alias("doc_id"), F.col(at[2]).alias("source"), F.xxhash64(F.coalesce(F.col(at[1]), F.lit(""))).alias("tie")))
    if plan.packed.groupBy("doc_id", "s", "tie").count().where("count > 1").isEmpty():
        joined = keyed.join(used.drop("start"), "_key")
    else:  # equal rows are told apart by their number: in the packed order, and by their other columns
        starts = plan.packed.where("size > 0").select(key, "start").withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("start")))
        others = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
        rows = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(others)))
        joined = rows.join(starts.join(used, ["_key", "start"]), ["_key", "_nth"])
    words = F.regexp_extract_all(at[1], F.lit(_PIECE), F.lit(0))
    texts = F.element_at(F.transform(F.array(words), lambda w: F.transform("_parts", lambda p: F.struct(F.array_join(F.slice(w, p["from"] + 1, p["n"]), "").alias("t"), p["uses"].alias("uses")))), 1)
    each = joined.withColumn("_p", F.explode(texts)).withColumn("_nth", F.explode(F.array_repeat(F.lit(1), F.col("_p.uses"))))
    return each.select(*[F.col("_p.t").alias(c) if c == at[1] else F.col(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")
