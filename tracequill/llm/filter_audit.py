"""Filter interaction audit: what each filter removes at each place of every order of the filters.

SQL functions give each document the set of filters that it fails, as a bit mask, and its part; documents are counted in cells (part,
mask), at most 2 ** 5 a part. All orders of the filters are then visited by swaps of neighbours, each order once: a swap
changes the two steps that it exchanges and no other, and those are counted anew from the cells. What a filter removes is
summed along the walk, which makes its Shapley sum. The walk goes over all parts of a batch at once.

Cases: a null text is an empty one; a null part is the empty string; a document without a label, or with labels that are null, is
neither good nor toxic; of several labels of a document one that says so is enough; rows with the same doc_id are documents of
their own, and none of them has a smaller id than the other; a null doc_id is smaller than none and has none smaller; no
documents give no rows; other columns don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters in the order of their bits.
FILTERS = "ABCDE"
#: Fixed values of the failure conditions.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: The only white space, as a class.
SPACE = r"\x20\x09-\x0D"

COUNTS = ("n", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def adjacent_swaps(n: int) -> Iterator[int]:
    """The places i whose swaps with i + 1 lead, one after another, through all orders of n things, each once."""
    if n < 2:
        return
    down, up, inner = range(n - 2, -1, -1), range(n - 1), adjacent_swaps(n - 1)
    for turn in itertools.count():
        yield from down if turn % 2 == 0 else up  # the last thing moves through the order of the others
        i = next(inner, None)
        if i is None:
            return
        yield i + (turn % 2 == 0)  # it stands before the others, or behind them, when they make their own swap


def text_failures(text: Column) -> Column:
    """The bits of the filters that a text decides by itself (A to D)."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and the mask of failed filters of every row; E by the smallest id that has the text, table-wide.

    Texts meet by their sha256: first the smallest id of a text is aggregated, then rows join it, so a text that many
    rows have is a row for each task before the shuffle, and its rows can be split in the join.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    least = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    late = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return rows.join(least, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(late, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask and the numbers of documents, of good and of toxic ones."""
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks(docs, part).join(marked, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


class Walk:
    """The counts of one order of the filters after another, for many parts at once.

    ``counts`` has an axis each for parts, masks and COUNTS.
    """

    def __init__(self, counts: np.ndarray, filters: str = FILTERS):
        self.filters, self.order = filters, list(range(len(filters)))
        mask = np.arange(1 << len(filters))
        self.counts, self.mask = counts, mask
        self.fails = np.stack([counts[:, (mask >> f & 1) == 1].sum(axis=1)[:, 0] for f in self.order], axis=1)
        self.unique = np.stack([counts[:, 1 << f, 0] for f in self.order], axis=1)
        self.lost = np.zeros((len(counts), len(filters), len(COUNTS)), np.int64)
        for step in range(len(filters)):
            self._count(step)

    def _count(self, step: int) -> None:
        """Count a step from the cells that fail its filter and none before it."""
        before = sum(1 << f for f in self.order[:step])
        hit = ((self.mask >> self.order[step] & 1) == 1) & (self.mask & before == 0)
        self.lost[:, step] = self.counts[:, hit].sum(axis=1)

    def swap(self, i: int) -> None:
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self._count(i)
        self._count(i + 1)


def audit(counts: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """The orders, and by part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    walk, swaps = Walk(counts, filters), adjacent_swaps(len(filters))
    total, shapley = counts[:, :, 0].sum(axis=1), np.zeros((len(counts), len(filters)), np.int64)
    names, rows, orders = [], [], []
    while True:
        order, removed = list(walk.order), walk.lost[:, :, 0].copy()
        shapley[:, order] += removed
        names.append("".join(filters[f] for f in order))
        orders.append(order)
        rows.append(np.stack([total[:, None] - removed.cumsum(axis=1), removed, walk.fails[:, order] - removed, walk.unique[:, order], walk.lost[:, :, 1], walk.lost[:, :, 2]], axis=2))
        i = next(swaps, None)
        if i is None:
            break
        walk.swap(i)
    sums = np.stack([shapley[:, order] for order in orders], axis=1)
    return names, np.concatenate([np.stack(rows, axis=1), sums[..., None]], axis=3)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]
    for batch in batches:
        parts, found = batch.column("part").to_pylist(), batch.column("cells").to_pylist()
        for begin in range(0, len(parts), 1000):
            some = parts[begin : begin + 1000]
            counts = np.zeros((len(some), 1 << len(FILTERS), len(COUNTS)), np.int64)
            for p, cells_of in enumerate(found[begin : begin + 1000]):
                for cell in cells_of:
                    counts[p, cell["mask"]] = [cell[c] for c in COUNTS]
            names, values = audit(counts)
            steps, flat = len(FILTERS), values.reshape(-1, values.shape[-1])
            columns = [np.repeat(np.array(some, object), len(names) * steps), np.tile(np.repeat(np.array(names, object), steps), len(some)), np.tile(np.arange(1, steps + 1), len(some) * len(names)), *flat.T]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], schema=pa.schema(schema))


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order and step."""
    by_part = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return by_part.mapInArrow(_audits, SCHEMA)
