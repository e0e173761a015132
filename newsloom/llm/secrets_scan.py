r"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base kinds, leftmost and non-overlapping for each kind; a match that fails its length is dropped:
assign (a keyword, `:` or `=`, then a value of 6+ characters), access (`AKIA[A-Z0-9]+` of 20+), hex
(`[0-9a-f]+` of 24+). A span runs from the match's start to its end, in code points, end exclusive.

The method adds spans of kind `markov`: tokens `[A-Za-z0-9+/_=-]` of 20+ characters with a letter and
a digit, whose mean log-likelihood ratio between two first-order character models, of random strings
and of ordinary identifiers, is at least THRESHOLD. Both models are counted from labelled samples
(DataFrames of (token, random)); default_samples() makes 4 * SAMPLE_RANDOM random strings, and joins common words and
the words of SAMPLE_DOCS documents as identifiers are. Spans that touch a base span are
dropped: base spans stay. Random strings of letters alone and those under 20 characters are never scored
and so not found outside an assign match; the README gives recall by length and alphabet.

Everything runs as DataFrame expressions; the driver gets one row for each pair of characters. The work grows with a
text's matches as n ** 1.5 at most (places and overlaps are running values, summed in blocks of the square root).

Defined results: a null text is empty and has no span; repeated rows are scanned one by one; without
samples both models are flat and add nothing; clashing columns of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import table, without

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
THRESHOLD = 0.6  # nats a character pair
SAMPLE_RANDOM, SAMPLE_DOCS = 2000, 400
#: Characters of tokens lie between these code points.
_LOW, _WIDE = 43, 80
#: Weight of the single characters' frequencies in the pairs' ones.
BACKOFF = 30.0
# Common words of identifiers, next to the corpus's own words in the ordinary samples.
COMMON = """account action active address after agent amount array average balance before block body border branch buffer build button cache
center change channel check child class client color column command comment config connection content context control copy count country
create current customer data database date default delete delivery depth description device display document domain double download
element email empty enable entry error event example export factory field file filter first format frame function global group handler
header height history home host image import index input insert instance integer item job key label language last layer layout left
length level library limit line link list load local lock log login manager map market mask match max memory menu message method
min mode model module month mouse name network node note number object offset option order output owner package page parent
parse path pattern payment percent phone player point port position power prefix price print process product profile project
property protocol public query queue random range rate read record region remote render report request reset resource response
result return right role root row sample save scale schema scope screen script search section select sender sequence server service session
set shape share signal size source space stack start state static status step stop storage stream string style submit summary support
switch symbol system table target task template test text theme thread time title token tool total trace track transaction transfer tree
trigger type unit update upload user valid value vector version video view visible volume week weight width window word worker wrap
write year zone"""
SPAN = "array<struct<start:int,kind:int,stop:int>>"
FOUND = "array<struct<start:int,kind:int,stop:int,v:string>>"


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, join, zero: int = 0) -> Column:
    """For each of an array's whole numbers, join() of those before it, from zero on; join must be associative.

    An array that grows value by value is copied at each step. So the values are cut into blocks, as many as the square
    root of their number: the blocks are joined alone, their values are run through, and each block starts from its own.
    """
    none = F.array().cast("array<int>")

    def run(part, start):
        return F.aggregate(part, F.struct(start.alias("now"), none.alias("got")), lambda acc, x: F.struct(join(acc["now"], x).alias("now"), F.concat(acc["got"], F.array(acc["now"])).alias("got")), lambda acc: acc["got"])

    def cut(all_):
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / w).cast("int")), lambda k: F.slice(all_, k * w + 1, w)))

    def whole(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), join))
        return F.flatten(F.zip_with(blocks, _let(totals, lambda t: run(t, F.lit(zero))), run))

    return _let(values, lambda all_: F.when(F.size(all_) == 0, none).otherwise(_let(cut(all_), whole)))


def _spans(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """Places of a pattern's matches that are ok, with the matches (v).

    The text between matches and the matches alternate, so their lengths add up to places.
    """
    none = F.array().cast(FOUND)

    def places(found):
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"), (g + F.length(m)).alias("by")))

        def placed(steps):
            at = _running(F.transform(steps, lambda x: x["by"]), lambda now, x: now + x)
            spans = F.zip_with(steps, at, lambda x, now: F.struct((now + x["g"]).alias("start"), F.lit(kind).alias("kind"), (now + x["by"]).alias("stop"), x["m"].alias("v")))
            return spans if ok is None else F.filter(spans, lambda x: ok(x["v"]))

        return _let(steps, placed)

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)).otherwise(none)


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that touch no base span: both in one order by start, the largest end of a base span before a token and
    the smallest start of one after it tell."""
    last = (1 << 31) - 1
    event = lambda x, token: F.struct(x["start"].alias("start"), F.lit(token).alias("token"), x["stop"].alias("stop"), (x["v"] if token else F.lit("")).alias("v"), F.lit(KINDS.index("markov")).alias("kind"))
    merged = F.array_sort(F.concat(F.transform(base, lambda x: event(x, 0)), F.transform(tokens, lambda x: event(x, 1))))

    def told(all_):
        before = _running(F.transform(all_, lambda x: F.when(x["token"] == 0, x["stop"]).otherwise(0)), lambda now, x: F.greatest(now, x))
        after = F.reverse(_running(F.transform(F.reverse(all_), lambda x: F.when(x["token"] == 0, x["start"]).otherwise(last)), lambda now, x: F.least(now, x), last))
        edges = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        free = F.zip_with(all_, edges, lambda x, e: F.when((x["token"] == 1) & (e["a"] <= x["start"]) & (e["b"] >= x["stop"]), F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["v"].alias("v"))))
        return F.filter(free, lambda x: x.isNotNull())

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(merged, told))


def default_samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(token, random): strings of hashes, and words of a bounded set of documents joined as identifiers are."""
    spark = docs.sparkSession
    key = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(key)), "=+$", "")
    made = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(b64, F.substring(key, 1, 40), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 32)), F.translate(b64, "+/", "-_"))).alias("token"))
    # the ids are chosen first, so that no task gathers texts of all others
    ids = docs.select(F.col(doc_id).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    some = docs.join(F.broadcast(ids), F.col(doc_id) == F.col("_id")).select(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[^A-Za-z]+"), lambda w: F.length(w) > 1).alias("w"))
    n = F.size("w")

    def joined(by, f=lambda x: x):
        starts = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.transform(F.slice("w", i, 3), f), by))

    plain = some.where(n > 2).select(F.explode(F.concat(F.col("w"), joined("_"), joined("-"), joined("/"), joined("", F.initcap), F.transform(joined("_"), F.upper))).alias("token"))
    dates = spark.range(SAMPLE_RANDOM).select(F.concat(F.lit("build-"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), F.lit("-v"), F.col("id")).alias("token"))
    known = F.array(*[F.lit(w) for w in COMMON.split()])
    at = [F.pmod(F.xxhash64("id", F.lit(k)), F.size(known)).cast("int") for k in range(3)]
    three = spark.range(4 * SAMPLE_RANDOM).select("id", F.array(*[F.get(known, a) for a in at]).alias("w"))
    made_up = three.select(F.explode(F.array(F.array_join("w", "_"), F.array_join("w", "-"), F.array_join("w", "/"), F.array_join(F.transform("w", F.initcap), ""), F.upper(F.array_join("w", "_")), F.concat(F.array_join("w", "_"), F.lit("_"), F.pmod("id", F.lit(200))), F.concat(F.array_join(F.transform("w", F.initcap), ""), F.pmod("id", F.lit(30))))).alias("token"))
    return made.withColumn("random", F.lit(True)).unionByName(plain.unionByName(dates).unionByName(made_up).withColumn("random", F.lit(False)))


def _code(c: Column) -> Column:
    return F.ascii(c) - _LOW


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of token characters, smoothed by single characters' frequencies."""
    i = F.explode(F.sequence(F.lit(1), F.length("token") - 1))
    pairs = samples.where(F.length("token") > 1).where(~F.col("token").rlike("[^A-Za-z0-9+/_=-]")).select("random", "token", i.alias("i"))
    pairs = pairs.select("random", _code(F.substring("token", F.col("i"), F.lit(1))).alias("a"), _code(F.substring("token", F.col("i") + 1, F.lit(1))).alias("b"))
    from math import log

    counts = {True: {}, False: {}}
    for r in pairs.groupBy("random", "a", "b").count().collect():
        counts[r["random"]][r["a"], r["b"]] = r["count"]
    symbols = sum(chr(_LOW + x).isalnum() or chr(_LOW + x) in "+/_=-" for x in range(_WIDE))
    rows = {k: [sum(c.get((a, b), 0) for b in range(_WIDE)) for a in range(_WIDE)] for k, c in counts.items()}
    ones = {k: [(sum(c.get((a, b), 0) for a in range(_WIDE)) + 1) / (sum(c.values()) + symbols) for b in range(_WIDE)] for k, c in counts.items()}

    def p(k, a, b):
        return (counts[k].get((a, b), 0) + BACKOFF * ones[k][b]) / (rows[k][a] + BACKOFF)

    return [log(p(True, a, b) / p(False, a, b)) for a in range(_WIDE) for b in range(_WIDE)]


def _ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    def mean(codes):
        n = F.size(codes) - 1
        pairs = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.element_at(model, a * _WIDE + b + 1))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / n

    return _let(F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), _code), mean)


def scan_secrets(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with secrets (array of start, stop, kind, method spans included) and base (base spans alone)."""
    docs = without(docs, "secrets", "base", "_t")
    t = F.col("_t")
    table_ = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    base = F.array_sort(F.concat(_plain(_spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6)), _plain(_spans(t, ACCESS, 1)), _plain(_spans(t, HEX, 2))))
    likely = _spans(t, TOKEN, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    odd = _plain(F.filter(_let(likely, lambda x: _apart(x, F.col("base"))), lambda x: _ratio(x["v"], table_) >= threshold))
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("base", base)
    extra = F.when(t.rlike("[0-9]") & t.rlike(TOKEN), odd).otherwise(F.array().cast(SPAN))
    out = out.withColumn("secrets", F.array_sort(F.concat(F.col("base"), extra)))
    return out.drop("_t")


def named(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, train(default_samples(docs))).select("doc_id", "base", "secrets")
    return found.select("doc_id", *[count_of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(named("base"), 256).alias("base_sha256"), named("secrets").alias("spans"))
