"""Token counts: whole documents encoded once, tokens attributed to fields and sections by their offsets.

A record is its fields joined by line feeds, in order; the last field's lines are its sections. The
record is encoded in one piece. The lengths of the tokens' bytes give their spans, which join the
fields' and sections' spans by binary search. A token inside one interval counts there. A token that
crosses a border counts where most of its bytes lie; among equals, in the earlier interval. A line
feed belongs to the interval that it ends.

So the counts of the fields add up to the record's tokens, as do those of the sections to the last
field's. Defined results: null fields are empty; an empty record of one field has no tokens; repeated
rows are counted one by one; columns of the input that clash with output columns are replaced. The
vocabulary's path must exist on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import arrow_map, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_made: dict[str, tuple] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """(encode, byte length of each token), made once in each worker."""
    if path not in _made:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _made[path] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes)
    return _made[path]


def attributed(ends: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Tokens in each interval: ends are the tokens' last offsets, borders the intervals' ends, both rising."""
    if not len(borders):
        return np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    first = np.searchsorted(borders, starts, side="right")
    last = np.searchsorted(borders, ends, side="left")
    home = np.minimum(first, len(borders) - 1)
    for i in np.flatnonzero(first < last):
        span = np.arange(first[i], min(last[i], len(borders) - 1) + 1)
        low = np.maximum(starts[i], np.append(0, borders)[span])
        home[i] = span[np.argmax(np.minimum(ends[i], borders[span]) - low)]
    return np.bincount(home, minlength=len(borders))


def count_tokens(fields: list[str], path: str = VOCABULARY) -> tuple[int, np.ndarray, np.ndarray]:
    """Tokens of a record, of each field, and of each line of the last field."""
    encode, sizes = encoder(path)
    whole = "\n".join(fields)
    ends = np.cumsum(sizes[np.array(encode(whole), np.int64)]) if whole else np.zeros(0, np.int64)
    lengths = np.array([len(f.encode("utf-8", "replace")) for f in fields], np.int64)
    lengths[:-1] += 1
    borders = np.cumsum(lengths)
    per_field = attributed(ends, borders)
    begin = int(borders[-2]) if len(borders) > 1 else 0
    body = fields[-1].encode("utf-8", "replace")
    feeds = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1
    lines = feeds if not body or body.endswith(b"\n") else np.append(feeds, len(body))
    per_line = attributed(ends, np.append(begin, begin + lines))[1:]
    # tokens that the field rule gave to earlier fields stay there: the first line takes the difference
    if len(per_line):
        per_line[0] += per_field[-1] - per_line.sum()
    return len(ends), per_field, per_line


def token_counts(docs: DataFrame, fields: list[str], carry: list[str], path: str = VOCABULARY) -> DataFrame:
    """The carried columns with n_tokens, one tokens_<field> for each field, and section_tokens (array)."""
    added = T.StructType([T.StructField("n_tokens", T.LongType()), *[T.StructField(f"tokens_{f}", T.LongType()) for f in fields], T.StructField("section_tokens", T.ArrayType(T.LongType()))])
    carry = [c for c in carry if c.lower() not in {n.lower() for n in added.names}]
    used = docs.select(*dict.fromkeys([*carry, *fields]))
    schema = T.StructType([used.schema[c] for c in carry] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                columns = [[x or "" for x in b.column(f).cast(pa.string()).to_pylist()] for f in fields]
                got = [count_tokens(list(r), path) for r in zip(*columns, strict=True)]
                arrays = [b.column(c) for c in carry] + [pa.array([n for n, _, _ in got], pa.int64())]
                arrays += [pa.array([int(f[i]) for _, f, _ in got], pa.int64()) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([s.tolist() for _, _, s in got], pa.list_(pa.int64()))], names=[*carry, *added.names])

    return arrow_map(used, run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), ["source", "lang", "text"], ["doc_id"])
    return out.select("doc_id", "n_tokens", "tokens_source", "tokens_lang", "tokens_text", F.size("section_tokens").cast("long").alias("n_sections"),
                      F.coalesce(F.array_max("section_tokens"), F.lit(0)).alias("largest_section"), F.sha2(F.array_join("section_tokens", ","), 256).alias("sections_sha256"))
