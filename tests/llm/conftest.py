import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(("th", "er", "on", "an", "re", "É", "in", "x")) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty, short and very long texts, copies, near copies, shared lines and null keys."""
    r = random.Random(5)
    out, line = [], " ".join(words(r, 60))
    base = words(r, 150)
    for i in range(40):
        out.append((i, " ".join(words(r, r.choice((3, 20, 60, 140, 300)))), "en", f"s{i % 5}"))
    for i in range(40, 55):
        near = list(base)
        for _ in range(r.randint(0, 3)):
            near[r.randrange(len(near))] = "changed" + str(r.randint(0, 99))
        out.append((i, " ".join(near), "en", "s0"))
    for i in range(55, 65):
        out.append((i, line + "\n" + " ".join(words(r, 30)), "fr", "s1"))
    out += [(65, out[3][1], "en", "s0"), (66, out[3][1].upper().lower(), "en", None), (67, None, "en", "s2"), (68, "", None, "s2"), (69, " \t\n ", "en", "s2"), (70, "Ab  cd", "en", "s3"), (71, "ab\tCD", "en", "s3")]
    out += [(72, " ".join(words(r, 9000)), "en", "s4"), (73, "a b c d e f", "en", "s4"), (73, "a b c d e f", "en", "s4"), (74, "x" * 5000, "de", "s4"), (75, "line one\r\nline two three\x1c\x85four", "de", "s4")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
