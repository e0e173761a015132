"""Text scalars: white space, digits, sentences, hash order, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import lexicon as L


def plain(text: Column) -> Column:
    """Whether a text is ASCII alone, for which cheaper classes of characters do."""
    return F.octet_length(text) == F.length(text)


def normalised(text: Column) -> Column:
    """All runs of white space as one space, trimmed. Single spaces, most of the runs, are left as they are."""
    def runs(odd: str, white: str) -> str:
        return f"{odd}{white}*| {white}+"

    ascii_runs = runs(r"[\x09-\x0d\x1c-\x1f]", r"[\x09-\x0d\x1c-\x20]")
    all_runs = "(?U)" + runs(f"[{L.SPACE}&&[^ ]]", f"[{L.SPACE}]")
    return F.trim(F.when(plain(text), F.regexp_replace(text, ascii_runs, " ")).otherwise(F.regexp_replace(text, all_runs, " ")))


def digits(text: Column) -> Column:
    """Characters that count as digits; the wide class is tried on what is not ASCII alone."""
    others = F.regexp_count(F.regexp_replace(text, r"[\x00-\x7f]+", ""), F.lit(f"[{L.DIGIT}]"))
    return (F.regexp_count(text, F.lit("[0-9]")) + F.when(plain(text), 0).otherwise(others)).cast("int")


def year_number(year: Column) -> Column:
    """The number of a year written in decimal digits of any script."""
    return F.translate(year, L.DECIMALS, "0123456789" * (len(L.DECIMALS) // 10)).cast("int")


def has(text: Column, name: str) -> Column:
    return text.rlike(L.java(name))


def has_low(text: Column, low: Column, ascii_alone: Column, name: str) -> Column:
    """has(text, name), with the cheaper pattern where the text is ASCII alone; low is its lower case."""
    return F.when(ascii_alone, low.rlike(L.low_search(name))).otherwise(has(text, name))


#: Characters that match an ASCII letter when case is ignored, but whose lower case is another one.
ODD_CASE = "ſKİı"


def maybe(low: Column, name: str) -> Column:
    """Whether a pattern of alternatives can match at all: low, the text in lower case, holds the beginning of one of
    them or a character of odd case. Whole words are searched in one pass, where words begin. Of others each beginning is
    searched as plain text by Java's patterns, which skip along the text and are a tenth as dear as `contains` for each;
    low should be a column, not an expression, which each would compute again."""
    odd = ~plain(low) & low.rlike(f"[{ODD_CASE}\u0307]")
    if L.whole_words(name):
        return odd | low.rlike(L.word_beginnings(name))
    starts = L.beginnings(name)
    least = [x for x in starts if not any(y in x for y in starts if y != x)]
    return reduce(lambda a, x: a | low.rlike(rf"\Q{x}\E"), least, odd)


def flu_in(sentence: Column) -> Column:
    """has(sentence, "FLU"), behind letters that all of its alternatives hold and no other character folds to."""
    return sentence.rlike("[fF][lL][uU]|[hH][1357][nN][1-9]") & has(sentence, "FLU")


def occurrences(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(L.java(name))).cast("int")


def sentences(text: Column) -> Column:
    """The sentences of a text that hold more than white space."""
    return F.filter(F.split(text, f"(?U){L.SENTENCE}", -1), lambda s: F.ascii(s).between(33, 126) | s.rlike(f"(?U)[^{L.SPACE}]"))


def drawn(seed: int, step: str, *key: Column | str) -> Column:
    """A pseudorandom order that depends on the seed, the step and the key alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(step), *key))


def phase(day: Column, onset: Column, late_from: int = -5) -> Column:
    """early, late or post, by whole weeks from onset, rounded down."""
    weeks = F.floor(F.datediff(day, onset) / 7)
    return F.when(weeks >= 0, "post").when(weeks >= late_from, "late").otherwise("early")


def last_weekday(day: Column, name: str) -> Column:
    """The most recent such weekday strictly before a day."""
    return F.next_day(F.date_sub(day, 8), name)


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)
