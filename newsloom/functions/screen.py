"""One look at each whole text by Arrow's linear-time searches (RE2), in the Python workers.

Java's patterns try every alternative at every character; RE2 reads a text once whatever it looks for. What it says is
exact, or null where Java has to look itself. Every text is read whole, and the sentences that can count for anything are handed on whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import lexicon as L

RESULT = "n_norm int, spam boolean, digits int, dated int, near string"
#: Bytes of text that are looked at together: it bounds a worker's memory.
PIECE = 8_000_000

# White space in RE2's classes: of ASCII texts, and all that L.SPACE means to Java, each without the space itself.
_ODD = {True: r"\x09-\x0d\x1c-\x1f", False: r"\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"}


def _looked_at():
    """The function of the workers. It is nested and holds no name of this package, so that it is sent whole: workers need not find the package."""
    odd_case = "[\u017f\u212a\u0130\u0131]"  # they match s, k and i when case is ignored
    any_digit = r"[0-9\x{80}-\x{10ffff}]"
    inner = lambda name: getattr(L, name).removeprefix(r"\b(?:").removesuffix(r")\b")
    flu, topics = rf"\b(?:{L.FLU_WORDS})\b", rf"\b(?:{inner('ANIMAL_TERMS')}|{inner('OTHER_DIS')})\b"
    spam, dated = L.SPAM, L.DATE_HEAD
    # what holds all that Java can find in texts that are not ASCII alone: a digit may be any character there
    wide_spam, wide_dated = "|".join(map(re.escape, L.beginnings("SPAM"))), L.DATE_HEAD.removesuffix(r"\b").replace(r"\d", any_digit)
    spaces, piece = _ODD, PIECE

    def pieces(text):
        import numpy as np
        import pyarrow.compute as pc

        total = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + piece, "right")))
            yield text.slice(at, end - at)
            at = end

    def near_flu(text, white):
        """The sentences near a flu term, or with a topic, in their order, one a line. One with a term keeps those beside it, so no other
        comes to stand beside a term. Beside letters that are not ASCII, RE2 sees a border of words where Java may see none: of such
        texts too much is kept, never too little. A sentence may lose white space in front, with which no pattern begins."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lines = pc.split_pattern(pc.replace_substring_regex(text, pattern=rf"([.!?])[{white}]+|\n+", replacement="\\1\n"), pattern="\n")
        row, flat = pc.list_parent_indices(lines).to_numpy(), lines.flatten()
        filled = pc.match_substring_regex(flat, pattern=f"[^{white}]")
        row, flat = row[filled.to_numpy(zero_copy_only=False)], flat.filter(filled)
        found = lambda p: pc.match_substring_regex(flat, pattern=p, ignore_case=True).to_numpy(zero_copy_only=False)
        here, same = found(flu), row[1:] == row[:-1]
        kept = here | found(topics)
        kept[1:] |= here[:-1] & same
        kept[:-1] |= here[1:] & same
        ends = np.cumsum(np.bincount(row[kept], minlength=len(text)))
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat.filter(pa.array(kept)))
        return pc.binary_join(near, "\n")

    def looked(text, plain):
        import pyarrow as pa
        import pyarrow.compute as pc

        odd, none = spaces[plain], lambda kind: pa.nulls(len(text), kind)
        norm = pc.ascii_trim(pc.replace_substring_regex(text, pattern=f"[{odd}][{odd} ]*| [{odd} ]+", replacement=" "), characters=" ")
        match = lambda p: pc.match_substring_regex(norm, pattern=p, ignore_case=True)
        near = near_flu(text, odd + " ")
        if plain:
            count = lambda p: pc.cast(pc.count_substring_regex(norm, pattern=p, ignore_case=True), pa.int32())
            return [pc.cast(pc.binary_length(norm), pa.int32()), match(spam), count("[0-9]"), count(dated), near]
        strange = pc.match_substring_regex(text, pattern=odd_case)
        unless = lambda found, value: pc.if_else(pc.or_(found, strange), pa.scalar(None, value.type), value)
        return [pc.cast(pc.utf8_length(norm), pa.int32()), unless(match(wide_spam), pa.scalar(False)), none(pa.int32()), unless(match(wide_dated), pa.scalar(0, pa.int32())), pc.if_else(strange, text, near)]

    def screen(text):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, out = ["n_norm", "spam", "digits", "dated", "near"], []
        for part in pieces(pc.cast(text, pa.string())):
            ascii_alone = pc.string_is_ascii(part)
            halves, places = [], []
            for plain in (True, False):
                mask = pc.equal(ascii_alone, plain)
                mine = part.filter(mask)
                if len(mine):
                    halves.append(pa.StructArray.from_arrays(looked(mine, plain), names))
                    places.append(pc.indices_nonzero(mask))
            both = pa.concat_arrays(halves)
            out.append(both.take(pc.sort_indices(pa.concat_arrays(places))) if len(halves) > 1 else both)
        return pa.concat_arrays(out) if out else pa.StructArray.from_arrays([pa.array([], k) for k in (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string())], names)

    return screen


def screened(text: Column) -> Column:
    """struct(n_norm, spam, digits, dated, near) of a text that is not null: the length without runs of white space, whether it is
    spam, its digits and dated headlines, null where Java's patterns must tell; and near, the sentences that hold or stand beside a flu
    term or name an animal or another disease, for which the cascade's sums are those of the text."""
    return F.arrow_udf(_looked_at(), RESULT)(text)
