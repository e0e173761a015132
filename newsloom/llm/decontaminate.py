"""Benchmark decontamination: one automaton over normalised questions and answers.

Every item gives its windows of thirteen consecutive words (an item with fewer words, but not none,
gives one window). The windows form one Aho-Corasick automaton; each document is normalised once,
scanned once, and matches are carried back to word numbers and to code points of the original.

Defined results: a null or wordless text has no words and no hit; items without words give no
window; an empty item table leaves every document clean; repeated rows are judged one by one;
equal windows of several items count for each of them; the windows of an item without an id give hits
and spans like all others, but the item is neither in item_ids nor in n_items; item_ids have the type
of the items' ids. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.llm.common import arrow_map, cut, table

WINDOW = 13
#: Characters of all windows in one automaton (about 50 bytes of memory each); more items take more passes.
MAX_WINDOW_CHARS = 4_000_000
#: A document is contaminated from this share of hit words on: SHARE * n_hit >= n_words.
SHARE = 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_built: dict[int, tuple] = {}


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def _automaton(shared) -> tuple:
    """The automaton of a broadcast, built once in each worker."""
    import ahocorasick

    if shared.id not in _built:
        _built.clear()
        found: dict[str, list[int]] = {}
        for at, (_, mine) in enumerate(shared.value):
            for w in mine:
                found.setdefault(w.decode("latin-1"), []).append(at)
        a = ahocorasick.Automaton()
        for w, items in found.items():
            a.add_word(f" {w} ", (w.count(" ") + 1, tuple(set(items))))
        if found:
            a.make_automaton()
        _built[shared.id] = (a if found else None, [i for i, _ in shared.value])
    return _built[shared.id]


class _Ref:
    """A broadcast together with the number that names it in worker caches."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast else 0

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def value(self):
        return self.broadcast.value


def scan(text: str | None, automaton, ids: list) -> tuple[int, list[tuple[int, int]], set]:
    """Words, merged ranges of hit words, and the items that occur in one text."""
    w = words(text)
    if not w or automaton is None:
        return len(w), [], set()
    flat = b" " + b" ".join(w) + b" "
    ranges, items, gaps = [], set(), None
    for end, (width, which) in automaton.iter(flat.decode("latin-1")):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        last = int(np.searchsorted(gaps, end))
        items.update(ids[i] for i in which if ids[i] is not None)
        ranges.append((last - width, last))
    return len(w), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(items: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[list]:
    """Items with their windows, dealt to passes by the characters of the windows."""
    now, size = [], 0
    for row in items.select(item_id, item_text).toLocalIterator():
        mine = sorted(set(windows(row[1])))
        chars = sum(map(len, mine))
        if now and size + chars > limit:
            yield now
            now, size = [], 0
        if mine:
            now.append((row[0], mine))
            size += chars
    yield now


def contamination(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  carry: list[str] | None = None, keep: str = "all", scrub: bool = False, limit: int = MAX_WINDOW_CHARS) -> DataFrame:
    """The carried columns with n_words, n_hit, n_items, item_ids, items_sha256, spans and contaminated.

    spans: ranges of code points of the original text, end exclusive. keep: all, or clean rows alone.
    scrub: take the spans out of the texts of rows that are not contaminated as a whole.
    The items go to the executors in automata of a checked size; what is over takes another pass.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(id_type)), T.StructField("items_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("contaminated", T.BooleanType())])
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {n.lower() for n in added.names}]
    docs = docs.select(*dict.fromkeys([*carry, doc_text])) if doc_text in docs.columns else docs
    parts = list(_chunks(items, item_id, item_text, limit))
    got = docs
    for k, part in enumerate(parts):
        got = _pass(got, spark.sparkContext.broadcast(part), id_type, doc_text, k == 0, added if k == len(parts) - 1 else None, carry, keep, scrub)
        if k < len(parts) - 1:
            got = cut(got)
    return got


def _pass(docs: DataFrame, broadcast, id_type: T.DataType, doc_text: str, first: bool, added: T.StructType | None, carry: list[str], keep: str, scrub: bool) -> DataFrame:
    ref = _Ref(broadcast)
    ranges_type, ids_type = pa.list_(pa.int64()), pa.list_(to_arrow_type(id_type))
    state = T.StructType([T.StructField("_ranges", T.ArrayType(T.LongType())), T.StructField("_ids", T.ArrayType(id_type))])
    base = [c for c in docs.columns if c not in state.names]
    out = [c for c in base if added is None or c in carry]
    schema = T.StructType([docs.schema[c] for c in out] + list((added or state).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, ids = _automaton(ref)
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 1024):
                b = whole.slice(at, 1024)
                found = [scan(x.as_py(), automaton, ids) for x in b.column(doc_text)]
                if not first:
                    before = zip(b.column("_ranges").to_pylist(), b.column("_ids").to_pylist(), strict=True)
                    found = [(n, merged([*r, *zip(o[::2], o[1::2], strict=True)]), {*i, *j}) for (n, r, i), (o, j) in zip(found, before, strict=True)]
                arrays = [b.column(c) for c in out]
                if added is None:
                    more = [pa.array([[x for ab in r for x in ab] for _, r, _ in found], ranges_type), pa.array([sorted(i) for _, _, i in found], ids_type)]
                    yield pa.RecordBatch.from_arrays([*arrays, *more], names=[*out, *state.names])
                    continue
                hit = [sum(y - x for x, y in r) for _, r, _ in found]
                bad = [h > 0 and SHARE * h >= n for h, (n, _, _) in zip(hit, found, strict=True)]
                names = [",".join(sorted(map(str, i))) for _, _, i in found]
                spans = []
                for (_, r, _), x in zip(found, b.column(doc_text), strict=True):
                    at_word = [m.span() for m in _WORD.finditer(x.as_py())] if r else []
                    spans.append([[at_word[p][0], at_word[q - 1][1]] for p, q in r])
                more = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for _, _, i in found], pa.int64()),
                        pa.array([sorted(i) for _, _, i in found], ids_type), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(bad, pa.bool_())]
                if scrub and doc_text in out:
                    texts = b.column(doc_text).to_pylist()
                    for i, ranges in enumerate(spans):
                        if ranges and not bad[i]:
                            edges = [0, *(x for r in ranges for x in r), len(texts[i])]
                            texts[i] = "".join(texts[i][x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    arrays[out.index(doc_text)] = pa.array(texts, b.schema.field(doc_text).type)
                ready = pa.RecordBatch.from_arrays([*arrays, *more], names=[*out, *added.names])
                yield ready.filter(pa.array([not x for x in bad])) if keep == "clean" else ready

    return arrow_map(docs, run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, items, carry=["doc_id"]).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")

