"""The two batch jobs: draw a sample from a pool folder, and make label packets from a sample."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from newsloom.operators import classify, packets, pool, sampling
from newsloom.session import session
from newsloom.sources import readers, writers


def run_sampling(spark, pool_dir: str, out: str, seed: int = 42) -> dict:
    """Read, check, bucket, draw and write; returns the summary."""
    relations = readers.pool_folder(spark, pool_dir)
    # the rows are kept without their texts; those of the sample are read again
    articles = classify.bucketed(pool.read_pool(*relations, seed=seed)).drop("text").persist()
    try:
        drawn = sampling.draw(articles, seed)
        texts = relations[0].select(F.col("gkg_record_id").alias("record_id"), F.coalesce("article", F.lit("")).alias("text"))
        sample = texts.join(drawn, "record_id")
        summary = writers.save_run(out, articles, sample)
        for by in ("bucket", "country", "phase"):
            print(by, {r[by]: r["n"] for r in sampling.frequency(drawn, by).collect()})
        print("season", {r["season"]: r["n"] for r in sampling.frequency(drawn, "season").orderBy("season").collect()})
    finally:
        articles.unpersist()
    return summary


def run_packets(spark, sample_path: str, out: str, instructions: str | None = None, seed: int = 42) -> None:
    dealt = packets.deal(readers.sample(spark, sample_path), seed).persist()
    try:
        writers.save_packets(out, dealt, instructions)
        packets.packet_mix(dealt).orderBy("labeler").show()
    finally:
        dealt.unpersist()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["sampling", "packets"])
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--instructions")
    a = p.parse_args(args)
    spark = session()
    if a.job == "sampling":
        run_sampling(spark, a.input, a.out, a.seed)
    else:
        run_packets(spark, a.input, a.out, a.instructions, a.seed)


if __name__ == "__main__":
    main()
