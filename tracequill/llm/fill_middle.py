"""Fill-in-middle: texts cut at two units into prefix, middle and suffix, and put together anew.

A unit is a run of ASCII letters or one other character. One Aho-Corasick automaton runs over the text folded to
a few symbols and reports sparse events only: the characters at which the class changes and the sentinels. A gap between
events holds one unit (letters) or as many as it has characters (all others), so the number of units is arithmetic
over the gaps, and the character at which a unit ends is looked up by rank among the events.

The automaton is the only Python: it gives the number of units, whether a sentinel occurs, and the two places. Texts are
cut, put together and restored by SQL functions.

Cases: a null text is an empty one (form plain, 0 units, an empty output); a null doc_id draws as the empty string;
equal rows draw equally, as only doc_id decides; a text that holds a sentinel is plain, so a sentinel of an output is
always one that was put there; an empty table gives no rows; other columns stay, those named like a new one
are replaced.
"""

from __future__ import annotations

import functools
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parameters: the seed of the draws, and the shares in percent of texts that are cut and of those with the suffix first.
SEED = "1"
RATE, SUFFIX_FIRST = 90, 20
#: Characters that the automaton is given at a time.
PART = 1 << 20

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BEGIN, _END, _SENTINEL = 0, 1, 2
_CUT = pa.struct([("n", pa.int64()), ("sentinel", pa.bool_()), ("first", pa.int64()), ("second", pa.int64())])


def _fold() -> bytes:
    """A symbol for each ASCII character: a letter is 'a', any other '.', but those of sentinels are themselves."""
    kept = set("".join((PREFIX, SUFFIX, MIDDLE)))
    return bytes(ord(c) if (c := chr(i)) in kept else ord("a") if c in _LETTERS else ord(".") for i in range(256))


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """The automaton of class changes and sentinels; a pattern's value is the kind of its event."""
    symbols = sorted(set(map(chr, _fold())))
    out = ahocorasick.Automaton()
    for one, two in itertools.product(symbols, symbols):
        if (one in _LETTERS) != (two in _LETTERS):
            out.add_word(one + two, _BEGIN if two in _LETTERS else _END)
    for word in (PREFIX, SUFFIX, MIDDLE):
        out.add_word(word, _SENTINEL)
    out.make_automaton()
    return out


_TABLE = _fold()


def events(text: str) -> tuple[np.ndarray, bool, bool]:
    """Where the class changes (the index of the first character of the new class), whether the text begins with a letter, and
    whether it holds a sentinel.

    A code point beyond ASCII counts as one character that is no letter, so indices are those of code points.
    """
    folded = text.encode("ascii", "replace").translate(_TABLE).decode("ascii")
    found, sentinel, walk = [], False, None
    for begin in range(0, len(folded), PART):
        part = folded[begin : begin + PART]
        if walk is None:
            walk = automaton().iter(part)
        else:
            walk.set(part)  # goes on in the state, and with the index, that it has
        hits = np.fromiter((end << 2 | kind for end, kind in walk), np.int64)
        sentinel = sentinel or bool((hits & 3 == _SENTINEL).any())
        found.append(hits[hits & 3 != _SENTINEL] >> 2)
    return np.concatenate([*found, np.zeros(0, np.int64)]), folded[:1].isalpha(), sentinel


class Units:
    """The units of a text by its events."""

    def __init__(self, text: str):
        self.changes, letters, self.sentinel = events(text)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.changes])
        gaps = np.diff(np.append(self.starts, len(text)))
        self.letters = (np.arange(len(gaps)) % 2 == 0) == letters
        #: units before each gap, and at last of all
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(self.letters, np.minimum(gaps, 1), gaps))])
        self.length = len(text)

    @property
    def n(self) -> int:
        return int(self.before[-1])

    def end(self, units: int) -> int:
        """The number of characters of the first so many units."""
        if units >= self.n:
            return self.length
        gap = int(np.searchsorted(self.before, units, "right")) - 1
        return int(self.starts[gap] + (units - self.before[gap]) * (not self.letters[gap]))


def _cut(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(texts, one.to_pylist(), two.to_pylist(), strict=True):
        units = Units(text.as_py() or "")
        low, high = sorted((a % (units.n + 1), b % (units.n + 1)))
        out.append((units.n, units.sentinel, units.end(low), units.end(high)))
    columns = zip(*out, strict=True) if out else ([],) * len(_CUT)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT, strict=True)], fields=list(_CUT))


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed, colon and decimal doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The rows with n, form (plain, psm or spm), prefix_chars, middle_chars and output, which stand last."""
    text, (h1, h2, h3, h4) = F.coalesce("text", F.lit("")), draws(F.col("doc_id"), seed)
    cut = F.arrow_udf(_cut, "struct<n: long, sentinel: boolean, first: long, second: long>")
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(f"__in.`{c}`").alias(c) for c in docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__in"), text.alias("__text"), cut(text, h1, h2).alias("__cut"), h3.alias("__h3"), h4.alias("__h4"))
    plain = (F.col("__text") == "") | F.col("__cut.sentinel") | (F.col("__h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("__form", form)
    first, second = F.col("__cut.first").cast("int"), F.col("__cut.second").cast("int")
    prefix = F.substring("__text", F.lit(1), first)
    middle = F.substring("__text", first + 1, second - first)
    suffix = F.substring("__text", second + 1, F.length("__text"))
    output = (
        F.when(F.col("__form") == "plain", F.col("__text"))
        .when(F.col("__form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    changed = F.col("__form") != "plain"
    return rows.select(
        *kept, F.col("__cut.n").alias("n"), F.col("__form").alias("form"), F.when(changed, F.col("__cut.first")).alias("prefix_chars"), F.when(changed, F.col("__cut.second") - F.col("__cut.first")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""
    after = lambda mark: F.substring_index(output, mark, -1)  # noqa: E731  the texts hold no sentinel, so each occurs once
    between = lambda one, two: F.substring_index(F.substring_index(output, two, 1), one, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the sha256 of output and of the text restored from it."""
    rows = transform(docs.select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))
