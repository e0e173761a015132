"""Helpers of the corpus operators: tables, cut lineage, distributed prefix sums and components."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.session import remove as _remove
from newsloom.session import shared_dir

WIDE = 1000  # bucket totals that are summed in one window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written by cut() in each open scratch(), innermost last.
_scratch: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors cost no recomputation.

    The table goes when the scratch() around it ends, or with the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the table behind a DataFrame that cut() returned, once it is used up."""
    _remove(df.sparkSession, df._newsloom_path)


@contextmanager
def scratch(spark: SparkSession):
    """Inside, the tables of cut() are used up at the end: all go but those given to the function that this yields,
    which pass to the scratch around, or stay to the program's end."""
    mine: list[str] = []
    kept: list[str] = []
    _scratch.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._newsloom_path)
        return df

    try:
        yield keep
    finally:
        _scratch.pop()
        for path in mine:
            if path not in kept:
                _remove(spark, path)
            elif _scratch:
                _scratch[-1].append(path)
            else:
                atexit.register(_remove, spark, path)


def python_path(spark: SparkSession) -> None:
    """Put this package's folder on the path of the Python workers."""
    environment = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[2])
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, environment.get("PYTHONPATH", "")) if x)


def give_back() -> None:
    """Return freed memory to the system: workers are kept for later tasks, and so is what they hold."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run), where workers find this package and give memory back after each task."""
    python_path(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that clash, in any case, with names that an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def _eq(a: DataFrame, b: DataFrame, on: list[str], prefix: str = "_r_") -> Column:
    out = F.lit(True)
    for k in on:
        out = out & a[k].eqNullSafe(b[prefix + k])
    return out


def running(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column], buckets: Column | None = None, per_bucket: int = 500) -> DataFrame:
    """Exclusive running sums of `sums` within `key`, without a task that holds a whole key.

    Rows are spread over hash buckets of the order's first columns; each bucket is summed in its own
    window, the bucket totals (one row a bucket and key) in windows of WIDE buckets, and the totals of those, one row
    for WIDE * per_bucket rows of df, in a last one.
    The order within a key is (bucket, order), the same at each run. Adds one column per entry.
    buckets: how many a row's key has, best in proportion to its rows; else one for per_bucket rows of df.
    """
    buckets = F.lit(max(1, -(-df.count() // per_bucket))) if buckets is None else buckets
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), buckets).cast("int"))
    before = lambda by, at: Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    wide = F.floor(F.col("_bucket") / WIDE).cast("int").alias("_wide")
    totals = df.groupBy(*key, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]).select("*", wide)
    inside = totals.select("*", *[zero(F.sum(f"_t_{n}").over(before([*key, "_wide"], ["_bucket"]))).alias(f"_o_{n}") for n in sums])
    high = totals.groupBy(*key, "_wide").agg(*[F.sum(f"_t_{n}").alias(f"_h_{n}") for n in sums])
    high = high.select(*[F.col(k).alias(f"_r_{k}") for k in [*key, "_wide"]], *[zero(F.sum(f"_h_{n}").over(before(key, ["_wide"]))).alias(f"_h_{n}") for n in sums])
    offsets = inside.join(high, _eq(inside, high, [*key, "_wide"])).select(*[inside[k].alias(f"_r_{k}") for k in [*key, "_bucket"]], *[(inside[f"_o_{n}"] + high[f"_h_{n}"]).alias(f"_o_{n}") for n in sums])
    parts = df.withColumns({f"_i_{n}": zero(F.sum(c).over(before([*key, "_bucket"], order))) for n, c in sums.items()})
    joined = parts.join(offsets, _eq(parts, offsets, [*key, "_bucket"]))
    return joined.select(*[parts[c] for c in df.columns if c != "_bucket"], *[(parts[f"_i_{n}"] + offsets[f"_o_{n}"]).alias(n) for n in sums])


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for each vertex of edges (a, b): comp is the smallest vertex that it reaches.

    Each round points every vertex at its smallest neighbour, follows those pointers, doubling, to their
    ends and contracts the graph; local minima alone remain, so the vertices at least halve. All steps
    are joins and aggregations on vertex keys; each is written to the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with scratch(spark) as done:
        pairs = cut(pairs)
        labels = None
        while not pairs.isEmpty():
            with scratch(spark) as keep:  # the tables of one round
                both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
                up = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
                moved = True
                while moved:
                    far = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
                    jumped = cut(up.join(far, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
                    moved = not jumped.where("moved").isEmpty()
                    up = jumped.select("a", "p")
                if labels is None:
                    labels = keep(cut(up.select(F.col("a").alias("v"), F.col("p").alias("comp"))))
                else:
                    labels = keep(cut(labels.join(up.select(F.col("a").alias("comp"), "p"), "comp", "left").select("v", F.coalesce("p", "comp").alias("comp"))))
                to = up.select(F.col("a").alias("a"), F.col("p").alias("pa"))
                moved = pairs.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("pa").alias("pb")), "b")
                pairs = keep(cut(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()))
        done(pairs if labels is None else labels)
    return pairs.select(F.col("a").alias("v"), F.col("b").alias("comp")) if labels is None else labels
