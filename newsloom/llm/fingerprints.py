r"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every hash of a shingle (five words; a shorter text is one shingle) that lies below a fixed fraction,
1 / SCALE, of the hash space is kept, and the smallest hash always, so that a text with words has a
fingerprint. Sketches merge by union (cut at the threshold), and containment and likeness of texts
of very unequal length are estimated from the common hashes.

likeness = common hashes / hashes of the smaller sketch: the containment of the smaller text.
It is biased towards 0 where the smaller text is short: with n shingles, by up to (1 - 1 / SCALE)^n, the
probability of no hash below the threshold; the README gives measured figures.

Defined results: null and wordless texts have an empty fingerprint; two empty ones are alike (1), an
empty and another are not (0); equal texts have equal fingerprints; repeated rows get one each; an
only document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import table

WIDTH, SCALE = 5, 8
ROWS, WIDE = 2000, 1000  # documents a bucket of the order by id, buckets that are led in one window
SPLITTERS, MAX_HEADS = 1024, 200_000


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted distinct hashes of a text's shingles below the threshold, with the smallest of all."""
    words = F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)

    def shingles(h):
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - WIDTH, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))

    kept = _let(words, lambda h: F.when(F.size(h) > 0, _let(shingles(h), lambda s: F.array_distinct(F.concat(F.filter(s, lambda x: x < limit), F.array(F.array_min(s)))))))
    return F.sort_array(F.coalesce(kept, F.array().cast("array<bigint>")))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together (of their shingles; the texts' border makes none)."""
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)
    both = F.sort_array(F.array_union(a, b))
    return F.filter(both, lambda x: (x < limit) | (x == F.element_at(both, 1)))


def likeness(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def printed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def _bucketed(docs: DataFrame, doc_id: str, rows: int) -> tuple[DataFrame, int]:
    """docs with _bucket, increasing with the id: ranges between sampled quantiles, cut evenly inside."""
    wanted = max(1, -(-rows // ROWS))
    n = min(SPLITTERS, wanted)
    inner = -(-wanted // n)
    cuts = sorted(set(docs.agg(F.percentile_approx(doc_id, [k / n for k in range(n + 1)], 10_000)).first()[0] or [0]))
    lows, highs = F.array(*[F.lit(x) for x in cuts]), F.array(*[F.lit(x) for x in [*cuts[1:], min(cuts[-1] + 1, (1 << 63) - 1)]])
    r = F.greatest(F.size(F.filter(lows, lambda x: x <= F.col(doc_id))), F.lit(1))
    low, high, at = F.element_at(lows, r).cast("double"), F.element_at(highs, r).cast("double"), F.col(doc_id).cast("double")
    share = (at - low) / F.greatest(high - low, F.lit(1.0))
    part = F.least(F.greatest(F.floor(share * inner), F.lit(0)), F.lit(inner - 1)) if inner > 1 else F.lit(0)
    return docs.withColumn("_bucket", (r * inner + part).cast("long")), wanted


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", made: dict[str, Column] | None = None) -> DataFrame:
    """docs with next_<column>: the values of the next document by descending id, after the last the first.

    made: columns to add first, such as sketches; they are computed once a row, where they are needed.

    Rows are dealt to buckets of the id; each bucket also gets the first row of the bucket below, so
    that no window spans the table and each text is shuffled once. Rows without an id come first.
    """
    docs = docs.withColumn("_id", F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)))
    dealt, buckets = _bucketed(docs, "_id", docs.count())
    made = made or {}
    tie = F.xxhash64(*columns)
    dealt = dealt.withColumns({"_tie": tie, "_guest": F.lit(0)})
    heads = dealt.groupBy("_bucket").agg(F.max(F.struct("_id", "_tie")).alias("h"))
    # the bucket below the last one is the first. One row a bucket is led inside WIDE buckets; the last bucket of those
    # gets the first row of the next ones, which stand in a window of one row for WIDE * ROWS documents
    wide = F.floor(F.col("_bucket") / WIDE).alias("_wide")
    inside = heads.select("_bucket", "h", wide).withColumn("next", F.lead("h").over(Window.partitionBy("_wide").orderBy(F.desc("_bucket"))))
    down = Window.orderBy(F.desc("_wide"))
    tops = heads.groupBy(wide).agg(F.max_by("h", "_bucket").alias("t")).select("_wide", F.lead("t").over(down).alias("below"), F.first("t").over(down).alias("top"))
    ring = inside.join(tops, "_wide").select(F.col("_bucket").alias("to"), F.coalesce("next", "below", "top").alias("h"))
    ring = ring.select("to", F.col("h._id").alias("_id"), F.col("h._tie").alias("_tie"))
    light = F.broadcast(ring) if buckets <= MAX_HEADS else ring
    guests = dealt.join(light, ["_id", "_tie"]).drop("_bucket").withColumnRenamed("to", "_bucket").withColumn("_guest", F.lit(1))
    guests = guests.dropDuplicates(["_bucket"])
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_id"), F.desc("_tie"))
    both = dealt.withColumns(made).unionByName(guests.select(dealt.columns).withColumns(made))
    led = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in [*columns, *made]})
    return led.where("_guest = 0").drop("_bucket", "_guest", "_tie", "_id")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(docs, ["text"], made={"print": sketch(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    done = led.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    done = done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print", sketch(F.col("edited")).alias("edited_print"))
    return done.select("doc_id", "n_chars", "edited_sha256", printed(F.col("print")).alias("fingerprint"), printed(F.col("edited_print")).alias("edited_fingerprint"),
                       likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
