"""Writers: projected CSV, JSON lines, the summary document, packets with sheets and texts, the key.

Corpus-sized outputs are written by the executors as folders. Packets hold a sample of fixed size:
they are written as single files by the driver, because the format asks for a byte-order mark.
"""

from __future__ import annotations

import csv
import io
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import packets, sampling

MOST = 20_000  # rows of one packet file


def csv_rows(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Header, CRLF, quotes only where needed and doubled inside, nulls empty, exactly these columns (a line feed inside a field becomes CRLF)."""
    rows.select(columns).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").option("nullValue", "").option("emptyValue", "").csv(path)


def json_lines(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One object a line in column order, nulls kept, text unescaped."""
    rows.select(columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_run(out: str, articles: DataFrame, sample: DataFrame) -> dict:
    """All articles and the sample as CSV, the sample with text as JSON lines, and the summary (returned as well)."""
    csv_rows(articles, f"{out}/all_articles_buckets", sampling.COLUMNS)
    ordered = sample.orderBy("ordinal", "pos")
    csv_rows(ordered, f"{out}/sample", sampling.COLUMNS)
    json_lines(ordered, f"{out}/sample_jsonl", [*sampling.COLUMNS, "text"])
    summary = sampling.sizes_document(articles)
    articles.sparkSession.createDataFrame([(json.dumps(summary, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/bucket_sizes")
    return summary


def _sheet_file(path: Path, columns: list[str], rows: list) -> None:
    buffer = io.StringIO()
    w = csv.DictWriter(buffer, fieldnames=columns, extrasaction="ignore")
    w.writeheader()
    w.writerows(rows)
    path.write_bytes(buffer.getvalue().encode("utf-8-sig"))


def _few(rows: DataFrame, most: int) -> list:
    """The rows on the driver, where the format asks for one file; more than `most` are refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: packets hold a sample")
    return got


def save_packets(out: str, dealt: DataFrame, instructions: str | None = None, labelers: list[str] = packets.LABELERS, most: int = MOST) -> None:
    """For each labeler a label sheet, an empty item sheet and the texts; the assignment key; the instructions.

    A sample has a fixed size; a table of more than `most` rows a file is refused before it reaches the driver.
    """
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    sheet = packets.sheets(dealt, labelers)
    for name in labelers:
        mine = sheet.where(F.col("labeler") == name).orderBy("row")
        rows = _few(packets.label_sheet(mine), most)
        _sheet_file(folder / f"{name}_labels.csv", packets.LABEL_COLUMNS, [r.asDict() for r in rows])
        _sheet_file(folder / f"{name}_items.csv", packets.ITEM_COLUMNS, [])
        texts = _few(mine.select("row", packets.packet_text().alias("t")).orderBy("row"), most)
        (folder / f"{name}_texts.txt").write_text("".join(r["t"] for r in texts), encoding="utf-8")
    key = _few(packets.assignment_key(dealt, labelers).orderBy("owner", "article_id"), most)
    with (folder / "assignment_key.csv").open("w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=packets.KEY_COLUMNS)
        w.writeheader()
        w.writerows(r.asDict() for r in key)
    if instructions:
        shutil.copy(instructions, folder)
