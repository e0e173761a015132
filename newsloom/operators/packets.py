"""Label packets: dealing, pilots, the rotation of checks, sheets and the assignment key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import drawn

LABELERS = ["labeler_1", "labeler_2", "labeler_3", "labeler_4"]
PILOT_SIDE = 10
# Columns of the sheets.
LABEL_COLUMNS = ["row", "round", "article_id", "link", "scan_date", "useful", "disease", "strain", "causes", "symptoms", "labeler", "notes"]
ITEM_COLUMNS = ["article_id", "kind", "number", "status", "total_or_new", "city", "state", "country", "start_date", "end_date", "words", "evidence"]
KEY_COLUMNS = ["article_id", "owner", "pilot", "checked_by", "bucket"]


def likely_useful(bucket: Column) -> Column:
    return F.substring(bucket, 1, 1).isin("P", "Z")


def _name(at: Column, labelers: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labelers]), (F.pmod(at, F.lit(len(labelers))) + 1).cast("int"))


def deal(rows: DataFrame, seed: int = 42, labelers: list[str] = LABELERS) -> DataFrame:
    """rows with owner number, packet_pos, pilot and pilot_pos.

    Dealing the buckets by falling size to the smallest packets in turn comes to the rank modulo the
    number of labelers. The input is a sample of fixed size: its one ordered window is small.
    """
    n = len(labelers)
    # a window, not a join with the counts: Spark would compute the rows, and the cascade below them, once for each side
    sized = rows.withColumn("_size", F.count("*").over(Window.partitionBy("bucket")))
    order = Window.orderBy(F.desc("_size"), "bucket", drawn(seed, "deal", "record_id"), "record_id")
    dealt = sized.withColumn("_rank", F.row_number().over(order) - 1).withColumn("owner", F.pmod("_rank", F.lit(n)).cast("int"))
    dealt = dealt.withColumns({"packet_pos": (F.floor(F.col("_rank") / n) + 1).cast("int"), "useful_side": likely_useful(F.col("bucket"))})
    inner = Window.partitionBy("owner", "bucket")
    ranked = dealt.withColumns({"_r": F.row_number().over(inner.orderBy("packet_pos")), "_n": F.count("*").over(inner)})
    turn = Window.partitionBy("owner", "useful_side").orderBy("_r", F.desc("_n"), "bucket")
    picked = ranked.withColumn("_p", F.row_number().over(turn)).withColumn("pilot", F.col("_p") <= PILOT_SIDE)
    shuffled = Window.partitionBy("owner", "pilot").orderBy(drawn(seed, "pilot", "record_id"), "record_id")
    out = picked.withColumn("pilot_pos", F.when(F.col("pilot"), F.row_number().over(shuffled)).cast("int"))
    return out.select(*rows.columns, "owner", "packet_pos", "pilot", "pilot_pos")


def sheets(dealt: DataFrame, labelers: list[str] = LABELERS) -> DataFrame:
    """Every labeler's sheet: own pilot, the next labeler's pilot to check, the rest; row numbers from one."""
    n = len(labelers)

    def place(labeler, name, part, at):
        return F.struct(labeler.cast("int").alias("labeler_no"), name.alias("round"), F.lit(part).alias("_part"), F.col(at).cast("int").alias("_at"))

    owner = F.col("owner")
    own = place(owner, F.lit("1-own"), 1, "pilot_pos")
    check = place(F.pmod(owner - 1, F.lit(n)), F.concat(F.lit("1-check-"), _name(owner, labelers)), 2, "pilot_pos")
    rest = place(owner, F.lit("2"), 3, "packet_pos")
    # one pass: each of three filtered branches would compute the packets, and the cascade below them, again
    full = dealt.select("*", F.inline(F.when(F.col("pilot"), F.array(own, check)).when(~F.col("pilot"), F.array(rest))))
    order = Window.partitionBy("labeler_no").orderBy("_part", "_at")
    return full.select(F.row_number().over(order).alias("row"), "round", F.col("record_id").alias("article_id"), F.col("url").alias("link"), "scan_date", _name(F.col("labeler_no"), labelers).alias("labeler"), *(["text"] if "text" in dealt.columns else []))


def label_sheet(sheet: DataFrame) -> DataFrame:
    """The columns of a label sheet, label columns blank; the bucket stays hidden."""
    return sheet.select(*[F.col(c) if c in sheet.columns else F.lit("").alias(c) for c in LABEL_COLUMNS])


def assignment_key(dealt: DataFrame, labelers: list[str] = LABELERS) -> DataFrame:
    """article_id, owner, pilot, checked_by (the labeler before the owner, for pilots), bucket."""
    return dealt.select(F.col("record_id").alias("article_id"), _name(F.col("owner"), labelers).alias("owner"), "pilot", F.when(F.col("pilot"), _name(F.col("owner") - 1, labelers)).otherwise("").alias("checked_by"), "bucket")


def packet_mix(dealt: DataFrame, labelers: list[str] = LABELERS) -> DataFrame:
    return dealt.groupBy(_name(F.col("owner"), labelers).alias("labeler")).agg(F.count("*").alias("n"), F.sum(likely_useful(F.col("bucket")).cast("int")).alias("useful"), F.sum(F.col("pilot").cast("int")).alias("pilots"))


def packet_text() -> Column:
    """One article of a text packet."""
    return F.concat(F.repeat(F.lit("="), 80), F.lit("\n#"), F.col("row"), F.lit("  ["), F.col("round"), F.lit("]  "), F.col("article_id"), F.lit("\nscan date: "), F.col("scan_date"), F.lit("\nlink: "), F.col("link"), F.lit("\n"), F.repeat(F.lit("-"), 80), F.lit("\n"), F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", ""), F.lit("\n\n"))
