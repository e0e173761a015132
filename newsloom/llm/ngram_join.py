"""N-gram Jaccard join by count-vector R-trees.

The shingles of a text are hashed into groups; the counts of the groups are a point. For two texts
the sum of the smaller counts bounds the number of common shingles from above, and for a node of an
R-tree the same sum against the node's largest coordinates bounds every text below it. A pair links
when 100 * |A and B| >= 80 * |A or B|, so only pairs with a bound of at least
ceil(80 * (|A| + |B|) / 180) go on to the exact comparison.

Distributed form:

1. Texts with one shingle set form a class, kept once (a partial aggregation, so copies cost nothing).
2. Shingles of very many documents (common lines and passages) are found by counting all shingles in
   CELLS cells; a cell is common when its count is far above the mean.
3. Classes are routed to trees by prefix: the first n - ceil(0.8 n) + 1 hashes, common ones last, at least one of which
   linked texts share, at any size. So no link is missed. Of routes with the same members one is kept, and a member
   without another of a near enough size leaves its route.
4. A tree with up to TREE members is searched with the bound; pairs that pass are reduced to a
   spanning forest. A larger tree's members all get an edge to its smallest member: no task holds it.
5. Components of those edges are candidate groups. In each the sets are made anew from the text and
   compared exactly; pairs that are already connected need no comparison. Groups over BLOCK texts or WEIGHT shingles
   are cut into blocks: leaders of the blocks' components meet in further rounds. What is outside the group's largest
   component then probes trees of the group's points (PROBE of them each): the texts of those alone that pass a bound
   with another component's are fetched and compared.

Classes are numbered, and their texts found by id and text hash: ids may repeat or be null.

Defined results: null and wordless texts have size 0 and are their own component; a text with fewer
than five words is one shingle; repeated rows and equal ids give equal results, and different texts of one id are
different documents; a component's id is its smallest one that is not null; clashing columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import arrow_map, components, cut, scratch, table, without
from newsloom.llm.shingles import mixed, shingle_sets

PART, WHOLE = 80, 100
GROUPS = 64
TREE, BLOCK, FANOUT, PROBE = 1024, 1500, 16, 4096
WEIGHT = 4_000_000  # shingles of a block's texts, 8 bytes each
MAX_IDS = 200_000  # members of candidate groups that are broadcast to find their texts
ROUNDS = 4  # of leaders, while they at least halve
CELLS, COMMON = 1 << 18, 128


def needed(a, b):
    """The least overlap of linked sets with a and b members."""
    return -(-PART * (a + b) // (WHOLE + PART))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * WHOLE < PART * max(len(x), len(y)) or not len(x):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return WHOLE * same >= PART * (len(x) + len(y) - same)


#: Sizes from which a set's point has four times the groups.
LEVELS = (512, 2048, 8192)


def n_groups(n: int) -> int:
    """Groups for a set of n: more for longer texts, nested, so that two points can be folded to the coarser. With eight
    shingles or fewer in a group the bound of unrelated texts is about 0.8, three deviations below the 0.89 of a link."""
    return GROUPS * 4 ** sum(n >= x for x in LEVELS)


def point(s: np.ndarray) -> np.ndarray:
    g = n_groups(len(s))
    return np.minimum(np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g), 65535).astype("<u2")


def folded(p: np.ndarray, g: int) -> np.ndarray:
    return p.reshape(-1, g).sum(0, dtype=np.int64) if len(p) > g else p.astype(np.int64)


def routes(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys of the trees that a set goes to, its prefix; common: which cells hold common shingles.

    Any order that all sets share will do; the rarer a prefix's shingles, the smaller the trees.
    """
    far = common[(s & np.uint64(CELLS - 1)).astype(np.int64)]
    return np.concatenate([s[~far], s[far]])[: len(s) + PART * len(s) // -WHOLE + 1].astype(np.int64, casting="unsafe") if len(s) else np.array([], np.int64)


def row_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches that are sorted by key."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        ks = [rest.column(k).to_numpy() for k in key]
        last = np.zeros(rest.num_rows, bool)
        for k in ks:
            last[:-1] |= k[1:] != k[:-1]
        ends = np.flatnonzero(last)
        if len(ends):
            yield rest.slice(0, int(ends[-1]) + 1)
            rest = rest.slice(int(ends[-1]) + 1).combine_chunks()
    if rest is not None:
        yield rest


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.array([], int)
    return starts, np.append(starts[1:], len(keys)).astype(int)


class Forest:
    """Disjoint sets over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class CountTree:
    """An R-tree over count vectors, packed in the order of set size; nodes keep the largest counts and the size range."""

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray]):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.g = min((len(p) for p in points), default=GROUPS)
        self.points = np.stack([folded(points[i], self.g) for i in self.order]) if len(points) else np.zeros((0, self.g), np.int64)
        self.levels = []
        top, lo, hi = self.points, self.sizes, self.sizes
        while len(top) > FANOUT:
            cuts = np.arange(0, len(top), FANOUT)
            top, lo, hi = np.maximum.reduceat(top, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            self.levels.append((top, lo, hi))

    def _open(self, p, n, at, points, lo, hi):
        at = at[(hi[at] * WHOLE >= PART * n) & (lo[at] * PART <= WHOLE * n)]
        return at[np.minimum(points[at], p).sum(1) >= needed(n, lo[at])]

    def near(self, size: int, p: np.ndarray) -> np.ndarray:
        """Places of the members whose bound allows a link."""
        p = folded(p, self.g)
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            at = self._open(p, size, at, *self.levels[k])
            below = len(self.levels[k - 1][0]) if k else len(self.points)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < below]
        return self.order[self._open(p, size, at, self.points, self.sizes, self.sizes)]


class Trees:
    """A tree for the sizes of each level, so that short texts don't coarsen the points of long ones, and one for the sizes
    about each border between levels, which may link across it."""

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray]):
        sizes = np.asarray(sizes)
        edges = [0, *LEVELS, 1 << 62]
        kinds = [(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
        if len(sizes):
            kinds = [k for k in kinds if k[0] <= sizes.max() and k[1] > sizes.min()]
        # linked sizes differ by a factor of 1.25 at most
        kinds += [(-(-x * PART // WHOLE), x * WHOLE // PART + 1) for x in LEVELS if len(sizes) and sizes.min() < x <= sizes.max()]
        self.trees = []
        for lo, hi in kinds:
            at = np.flatnonzero((sizes >= lo) & (sizes < hi))
            if len(at):
                self.trees.append((lo, hi, at, CountTree(sizes[at], [points[i] for i in at])))

    def near(self, size: int, p: np.ndarray) -> np.ndarray:
        """Places of the members whose bound allows a link."""
        found = [at[tree.near(size, p)] for lo, hi, at, tree in self.trees if lo <= size < hi]
        return np.unique(np.concatenate(found)) if found else np.array([], int)


def common_cells(docs: DataFrame, text: str = "text", floor: int = COMMON) -> np.ndarray:
    """Which cells hold shingles of very many documents. Each task sends one count a cell; CELLS counts reach the driver."""
    part = CELLS >> 4

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                sets = shingle_sets(whole.slice(at, 2048).column(0))
                if sets:
                    total += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([total[k * part : (k + 1) * part].astype("<u4").tobytes() for k in range(16)], pa.binary())], names=["k", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("k").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "counts"])

    parts = arrow_map(docs.select(text), run, "k int, counts binary")
    total = np.zeros(CELLS, np.int64)
    for r in arrow_map(parts.repartition(16, "k"), add, "k int, counts binary").collect():
        total[r["k"] * part : (r["k"] + 1) * part] += np.frombuffer(r["counts"], np.int64)
    mean = total.mean()
    return total > mean + 8 * mean**0.5 + floor


def _tie(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, common: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tie, n, s1, s2, keys, point): the text's hash, its set's size, 128-bit sum, routes and group counts."""
    packed = np.packbits(common).tobytes()

    def run(batches):
        common = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                rows = []
                for s in shingle_sets(b.column("text")):
                    m = mixed(s)
                    rows.append((len(s), m.sum(dtype=np.uint64).astype(np.int64), mixed(m ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64), routes(s, common), point(s).tobytes() if len(s) else b""))
                cols = list(zip(*rows, strict=True))
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(k) for k in cols[3]])).astype(np.int32)), pa.array(np.concatenate(cols[3])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), keys, pa.array(cols[4], pa.binary())], names=["doc_id", "tie", "n", "s1", "s2", "keys", "point"])

    light = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _tie(text).alias("tie"), F.col(text).alias("text"))
    return arrow_map(light, run, "doc_id long, tie long, n long, s1 long, s2 long, keys array<long>, point binary")


class Known:
    """Disjoint sets of ids, for what the trees of one task have connected so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _bounded_pairs(starts, ends, ids, sizes, points, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that share a route and pass the bound: trees of one leaf all at once, by offset, larger ones by search."""
    left, right = [], []
    width = ends - starts
    small = (width > 1) & (width <= FANOUT)
    d = 1
    while (now := small & (width > d)).any():
        a = np.concatenate([np.arange(s, e - d) for s, e in zip(starts[now], ends[now], strict=True)])
        left.append(a)
        right.append(a + d)
        d += 1
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        fits = (np.minimum(sizes[a], sizes[b]) * WHOLE >= PART * np.maximum(sizes[a], sizes[b]))
        a, b = a[fits], b[fits]
        need = needed(sizes[a], sizes[b])
        groups, ok = np.array([len(p) for p in points]), np.zeros(len(a), bool)
        for g in np.unique(groups).tolist():
            at = np.flatnonzero((groups[a] == g) & (groups[b] == g))
            rows = np.unique(np.concatenate([a[at], b[at]]))
            flat = np.stack([points[r] for r in rows]) if len(rows) else np.zeros((0, g), np.uint16)
            for k in range(0, len(at), 1 + 1_000_000 // g):
                i = at[k : k + 1 + 1_000_000 // g]
                ok[i] = np.minimum(flat[np.searchsorted(rows, a[i])], flat[np.searchsorted(rows, b[i])]).sum(1, dtype=np.int64) >= need[i]
        for i in np.flatnonzero(groups[a] != groups[b]):
            g = min(groups[a[i]], groups[b[i]])
            ok[i] = np.minimum(folded(points[a[i]], g), folded(points[b[i]], g)).sum() >= need[i]
        left, right = [a[ok]], [b[ok]]
    for s, e in zip(starts[width > FANOUT], ends[width > FANOUT], strict=True):
        mine = ids[s:e].tolist()
        apart = len({known.top(x) for x in mine}) - 1
        if not apart:  # copies share many routes: one of them connects them
            continue
        tree, got = Trees(sizes[s:e], points[s:e]), []
        for i in range(e - s):
            new = [(s + i, s + j) for j in tree.near(int(sizes[s + i]), points[s + i]).tolist() if known.join(mine[i], mine[j])]
            got += new
            apart -= len(new)
            if not apart:
                break
        left.append(np.array([x for x, _ in got], int))
        right.append(np.array([y for _, y in got], int))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.array([], int), np.array([], int))


def candidate_edges(reps: DataFrame, tree: int = TREE) -> DataFrame:
    """(a, b): a forest over the pairs that share a route and pass the bound of their count vectors."""
    # light rows alone are dealt by key, once for both sides of the join; most keys have one member
    # (the test for nulls, of which there are none, stands here because the join would put it on its own side alone, and
    # the shuffle would be made twice)
    posts = reps.select("rep", F.explode("keys").alias("key")).where("key is not null").repartition("key")
    # keys of the same members (128 bits of them) lead to the same pairs: one of those keys is enough
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    sizes = posts.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lead"), *marks).where("c > 1")
    sizes = sizes.groupBy("c", "lead", "h1", "h2").agg(F.min("key").alias("key")).select("key", "c", "lead")
    met = cut(posts.join(sizes, "key"))
    stars = met.where(F.col("c") > tree).select(F.col("lead").alias("a"), F.col("rep").alias("b")).where("a <> b")
    # who has no neighbour in the order of sizes that is near enough to link has no partner under that key
    order = Window.partitionBy("key").orderBy("n", "rep")
    fits = (F.lag("n").over(order) * WHOLE >= F.col("n") * PART) | (F.col("n") * WHOLE >= F.lead("n").over(order) * PART)
    sized = met.where(F.col("c") <= tree).select("key", "rep").join(reps.select("rep", "n"), "rep")
    full = sized.withColumn("fits", fits).where("fits").select("key", "rep", "n").join(reps.select("rep", "point"), "rep")
    dealt = full.select("key", "rep", "n", "point").repartition("key").sortWithinPartitions("key")

    def run(batches):
        known = Known()
        for t in row_groups(batches, ["key"]):
            ids, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            points = [np.frombuffer(x, "<u2") for x in t.column("point").to_pylist()]
            i, j = _bounded_pairs(*runs(t.column("key").to_numpy()), ids, n, points, known)
            a, b = ids[i], ids[j]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return arrow_map(dealt, run, "a long, b long").unionByName(stars).distinct()


def exact_forest(ids: np.ndarray, sets: list[np.ndarray], part: np.ndarray | None = None, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked: bounded by the tree, verified exactly, without pairs that are connected already.

    part: numbers of components that are known; only: members whose pairs are wanted (all if absent).
    """
    forest, out = Forest(len(ids)), []
    if part is not None:
        seen: dict[int, int] = {}
        for i, p in enumerate(part.tolist()):
            forest.join(seen.setdefault(p, i), i)
    if len(ids) == 2:
        return [(0, 1)] if forest.top(0) != forest.top(1) and linked(sets[0], sets[1]) else []
    sizes, points = np.array([len(s) for s in sets]), [point(s) for s in sets]
    tree = Trees(sizes, points)
    for i in range(len(ids)):
        if only is not None and not only[i]:
            continue
        for j in tree.near(int(sizes[i]), points[i]).tolist():
            if forest.top(i) != forest.top(j) and linked(sets[i], sets[j]):
                forest.join(i, j)
                out.append((i, j))
    return out


def _verify(dealt: DataFrame, key: list[str], tagged: bool = False) -> DataFrame:
    """(a, b): for each run of key, the smallest member and another of each component of its exact links.

    tagged rows carry part and side (1: wanted, 0: only as partner) and give the links between parts.
    """

    def run(batches):
        for t in row_groups(batches, key):
            k = np.stack([t.column(c).to_numpy() for c in key], 1)
            starts, ends = runs(np.append(0, np.cumsum((k[1:] != k[:-1]).any(1)))) if len(k) else (np.array([], int),) * 2
            rep, a, b = t.column("rep").to_numpy(), [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                one = t.slice(s, e - s)
                ids, where = np.unique(rep[s:e], return_index=True)
                if len(ids) < 2:
                    continue
                one = one.take(pa.array(where))
                sets = shingle_sets(one.column("text"))
                part = one.column("part").to_numpy() if tagged else None
                only = one.column("side").to_numpy() == 1 if tagged else None
                links = exact_forest(ids, sets, part, only)
                if not tagged:
                    forest = Forest(len(ids))
                    for i, j in links:
                        forest.join(i, j)
                    links = [(forest.top(j), j) for j in range(len(ids)) if forest.top(j) != j]
                for i, j in links:
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return arrow_map(dealt, run, "a long, b long")


def _sized(members: DataFrame, block: int) -> DataFrame:
    """members (comp, rep, n, ...) with c, their group's size, and k, the blocks it needs by number and by shingles."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    k = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("w") / WEIGHT)).alias("k")
    return members.join(sizes.select("comp", "c", k), "comp")


def exact_edges(members: DataFrame, texts: DataFrame, block: int = BLOCK, probe: int = PROBE) -> DataFrame:
    """Exact links that connect the texts of each candidate group (rep, comp, n, point, doc_id, tie); texts: (doc_id, tie, text)."""
    members = cut(_sized(members, block))
    ids = members.count()

    def with_text(rows: DataFrame) -> DataFrame:
        """Texts of the members: found by a broadcast of ids of a checked number, else by a shuffle."""
        keys = rows.select(*[c for c in rows.columns if c not in ("doc_id", "tie", "point")], F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
        return texts.join(F.broadcast(keys) if ids <= MAX_IDS else keys, texts["doc_id"].eqNullSafe(keys["_id"]) & (texts["tie"] == keys["_tie"])).drop("_id", "_tie", "doc_id", "tie")

    small = with_text(members.where("k <= 1"))
    found = cut(_verify(small.select("comp", "rep", "text").repartition("comp").sortWithinPartitions("comp"), ["comp"]))
    large = members.where("k > 1")
    if large.isEmpty():
        return found
    points = cut(large.select("comp", "rep", "n", "point"))
    large = cut(with_text(large).select("comp", "rep", "n", "c", "k", "text"))
    now, links = large.select("comp", "rep", "n", "c", "k").distinct(), []
    before = now.agg(F.count("*").alias("n"), F.max("c").alias("c"), F.max("k").alias("k")).first()
    for turn in range(ROUNDS):
        # blocks of a group's remaining leaders, dealt anew each round; who hangs on a leader drops out
        dealt = now.withColumn("k", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("k"))).join(large.select("rep", "text"), "rep")
        got = cut(_verify(dealt.select("comp", "k", "rep", "text").repartition("comp", "k").sortWithinPartitions("comp", "k"), ["comp", "k"]))
        links.append(got)
        tops = now.select("comp", "rep", "n").join(got.select(F.col("b").alias("rep")), "rep", "left_anti")
        now = cut(_sized(tops, block))
        sizes = now.agg(F.count("*").alias("n"), F.max("c").alias("c"), F.max("k").alias("k")).first()
        if sizes["c"] == 1 or before["k"] <= 1 or 2 * sizes["n"] > before["n"]:
            break
        before = sizes
    # one leader left, all are connected; else texts of different components still have to meet
    if sizes["c"] > 1:
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        links.append(_across(points, large.select("rep", "text"), edges, probe))
    for more in links:
        found = found.unionByName(more)
    return found


def _across(points: DataFrame, texts: DataFrame, edges: DataFrame, probe: int) -> DataFrame:
    """Links between components of a group: each member outside the largest one probes trees of all members' points.

    Points alone are copied, to a cell for each chunk of outsiders and block of members. Only members of a cell that pass
    the bound with another component's, a row each and never a pair, get their texts and are compared exactly.
    """
    parts = components(edges).select(F.col("v").alias("rep"), F.col("comp").alias("p"))
    named = points.join(parts, "rep", "left").select("comp", "rep", "n", "point", F.coalesce("p", "rep").alias("part"))
    sizes = named.groupBy("comp", "part").agg(F.count("*").alias("n"))
    best = sizes.groupBy("comp").agg(F.sum("n").alias("all"), F.max(F.struct("n", "part")).alias("m")).select("comp", "all", (F.col("all") - F.col("m.n")).alias("out"), F.col("m.part").alias("core"))
    named = cut(named.join(best.where("out > 0"), "comp"))
    chunks, blocks = F.ceil(F.col("out") / probe).cast("int"), F.ceil(F.col("all") / probe).cast("int")
    h = F.xxhash64("rep", F.lit(99))
    every = named.withColumns({"k": F.pmod(h, blocks), "i": F.explode(F.sequence(F.lit(0), chunks - 1)), "side": F.lit(0)})
    outer = named.where("part <> core").withColumns({"i": F.pmod(h, chunks).cast("int"), "k": F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)), "side": F.lit(1)})
    cols = ["comp", "i", "k", "rep", "part", "side"]
    both = every.select(*cols, "n", "point").unionByName(outer.select(*cols, "n", "point"))
    cells = both.repartition("comp", "i", "k").sortWithinPartitions("comp", "i", "k", "rep", F.desc("side"))

    def run(batches):
        for t in row_groups(batches, ["comp", "i", "k"]):
            place = np.stack([t.column(c).to_numpy() for c in ("comp", "i", "k")], 1)
            rep, part, side, n = (t.column(c).to_numpy() for c in ("rep", "part", "side", "n"))
            mark = np.zeros(len(rep), bool)
            for s, e in zip(*runs(np.append(0, np.cumsum((place[1:] != place[:-1]).any(1)))), strict=True):
                # an outsider that is in the block as well comes twice, first as an outsider
                at = s + np.flatnonzero(np.append(True, rep[s + 1 : e] != rep[s : e - 1]))
                vectors = [np.frombuffer(x, "<u2") for x in t.column("point").take(pa.array(at)).to_pylist()]
                tree = Trees(n[at], vectors)
                for x in np.flatnonzero(side[at] == 1):
                    near = tree.near(int(n[at[x]]), vectors[x])
                    near = near[part[at[near]] != part[at[x]]]
                    if len(near):
                        mark[at[near]] = mark[at[x]] = True
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[mark]) for c in cols], names=cols)

    met = cut(arrow_map(cells, run, "comp long, i int, k long, rep long, part long, side int"))
    dealt = met.join(texts, "rep").select(*cols, "text").repartition("comp", "i", "k").sortWithinPartitions("comp", "i", "k", "rep", F.desc("side"))
    return cut(_verify(dealt, ["comp", "i", "k"], tagged=True))


def _grouped(docs: DataFrame, doc_id: str, text: str, tree: int, block: int, probe: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all documents, and the classes: (s1, s2, n, rep, doc_id, tie, comp), the head's id and text hash."""
    with scratch(docs.sparkSession) as keep:
        signed = cut(signatures(docs, common_cells(docs, text), doc_id, text))
        light = keep(cut(signed.drop("keys", "point")))
        head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
        reps = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min_by(F.struct("keys", "point"), head).alias("x"), F.min(head).alias("h"))
        reps = cut(reps.select("s1", "s2", "n", F.monotonically_increasing_id().alias("rep"), "h.doc_id", "h.tie", "x.keys", "x.point"))
        rough = components(candidate_edges(reps, tree)).select(F.col("v").alias("rep"), "comp")
        members = cut(rough.join(reps.select("rep", "n", "point", "doc_id", "tie"), "rep"))
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _tie(text).alias("tie"), F.col(text).alias("text"))
        exact = components(exact_edges(members, texts, block, probe)).select(F.col("v").alias("rep"), "comp")
        return light, keep(cut(reps.drop("keys", "point").join(exact, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tree: int = TREE, block: int = BLOCK, probe: int = PROBE) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), one row a document.

    class_id: the smallest id with the same shingle set; component_id: the smallest id that links reach.
    """
    signed, classes = _grouped(docs, doc_id, text, tree, block, probe)
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(least, "comp").select("s1", "s2", "n", F.col("doc_id").alias("class_id"), "component_id")
    out = signed.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
    own = F.col("doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", own).alias("class_id"), F.coalesce("component_id", own).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tree: int = TREE, block: int = BLOCK, probe: int = PROBE) -> DataFrame:
    """docs with one document of each component, that of the smallest id (ids that are null come last, then the text's hash).

    Wordless documents all stay. Rows that are equal in id and text count as one document and collapse to one of them.
    """
    signed, classes = _grouped(docs, doc_id, text, tree, block, probe)
    heads = classes.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("h"))
    keep = heads.select(F.col("h.doc_id").alias("_i"), F.col("h.tie").alias("_t")).unionByName(signed.where("n = 0").select(F.col("doc_id").alias("_i"), F.col("tie").alias("_t")).distinct())
    named = without(docs, "_id", "_tie", "_i", "_t").withColumns({"_id": F.col(doc_id).cast("long"), "_tie": _tie(text)})
    kept = named.join(keep, named["_id"].eqNullSafe(keep["_i"]) & (named["_tie"] == keep["_t"]), "left_semi")
    if not signed.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_tie"])
    return kept.drop("_id", "_tie")


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
