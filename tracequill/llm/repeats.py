"""Suffix-array dedup: bytes that a string of LENGTH bytes covers which also starts elsewhere are removed.

Exact copies are made one text first (all their bytes go). Texts are then dealt by content: every window of LENGTH bytes has an
anchor, the last of its GRAM-byte strings with the least hash; equal windows have equal anchors at equal offsets. A run of
windows with one anchor is a context: the bytes that they cover. Only contexts whose anchor occurs again are moved, to the bucket
of their anchor.

A bucket has an enhanced suffix array for each offset: the contexts' suffixes at this offset before the anchor in order, with
the longest common prefixes of neighbours. That of the next offset comes from it by one stable sort by the next byte to the
left. Runs of prefixes of LENGTH or more whose left bytes differ somewhere (or begin a context) are stack-scanned
for common-prefix intervals; an interval whose left extension is diverse is a maximal repeat within its contexts, with all its
occurrences. Those of all offsets cover exactly the bytes of windows that occur twice.

An anchor of more than MOST occurrences is no bucket of its own: its contexts are made distinct where they are cut, and if
more than MOST are left, they are cut again into blocks of fewer windows (BLOCKS), dealt by the bytes that all windows of
a block share. The last blocks are single windows, which are distinct, so no bucket grows with the input.

Cases: a null text is an empty one; a text under LENGTH bytes has no window and stays whole; rows with equal texts, also those with
one doc_id, are copies of each other; the bytes that are left need not be UTF-8, so they are binary; an empty table gives no rows;
other columns stay, those named like a new one are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

LENGTH = 200
#: Bytes of an anchor, a power of two, and the largest offset of a window before its anchor.
GRAM = 32
REACH = LENGTH - GRAM
#: Most contexts of a bucket, and the windows of a block each time that a bucket is too large.
MOST = 2048
BLOCKS = (16, 4, 1)
#: Bytes that are hashed at a time, and contexts that are sorted at a time, for a bounded memory.
SEGMENT = 1 << 18
ROWS = 8192

KEYS = ("k1", "k2")
_LOW = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_hashes() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest()) for i in range(256)], np.uint64)


_BYTES = _byte_hashes()


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the GRAM bytes at each place, and the place of the anchor of the window at each place."""
    h, width = _BYTES[data], 1
    while width < GRAM:
        h = h[:-width] * _ODD + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    least, width = (h | _LOW) - np.arange(len(h), dtype=np.uint64), 1  # of equal hashes the last place is the least
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if (rest := REACH + 1 - width) > 0:
        least = np.minimum(least[:-rest], least[rest:])
    return h, (_LOW - (least & _LOW)).astype(np.int64)


def _segments(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows begin to end, and their bytes begin to end: rows together, or parts of one, which overlap by less than a window."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        if to > row + 1 or offsets[to] - offsets[row] <= SEGMENT:
            yield row, to, int(offsets[row]), int(offsets[to])
        else:
            for at in range(int(offsets[row]), int(offsets[to]) - LENGTH + 1, SEGMENT - LENGTH + 1):
                yield row, to, at, min(at + SEGMENT, int(offsets[to]))
        row = to


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings or binary without nulls."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


RUNS = "gram long, k1 long, k2 int, first int, off int, starts int, times int"


def _periods(data: np.ndarray, gram: np.ndarray, row: np.ndarray, change: np.ndarray, off: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs stand for themselves, and for how many: runs that follow one of the same bytes at once (one character again
    and again, or any other period) are counted with it."""
    like = (gram[1:] == gram[:-1]) & (row[1:] == row[:-1]) & (off[1:] == off[:-1]) & (starts[1:] == starts[:-1]) & (change[1:] == change[:-1] + starts[:-1])
    for i in np.flatnonzero(like).tolist():
        a, b, n = int(change[i]), int(change[i + 1]), int(starts[i]) + LENGTH - 1
        like[i] = np.array_equal(data[a : a + n], data[b : b + n])
    own = np.flatnonzero(np.concatenate([[True], ~like]))
    return own, np.diff(np.append(own, len(gram)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of windows with one anchor: its hash, the first window, the anchor's distance from it, the number of windows, and
    how often the run's bytes follow each other, a run apart."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data = _flat(batch.column("text"))
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for row, to, begin, end in _segments(offsets):
            h, at = anchors(data[begin:end])
            edges = np.clip(offsets[row : to + 1], begin, end) - begin
            label = at.copy()
            for edge in edges[1:-1]:  # windows over two texts are none
                label[edge - LENGTH + 1 : edge] = -1
            change = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            ends = np.append(change[1:], len(label))
            real = label[change] >= 0
            change, ends = change[real], ends[real]
            of = np.searchsorted(edges, change, "right") - 1
            place, rows = at[change], row + of
            own, times = _periods(data[begin:end], h[place], rows, change, place - change, ends - change)
            change, ends, place, rows = change[own], ends[own], place[own], rows[own]
            first = change + begin - offsets[rows]
            columns = (h[place].view(np.int64), k1[rows], k2[rows], first.astype(np.int32), (place - change).astype(np.int32), (ends - change).astype(np.int32), times.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "k1", "k2", "first", "off", "starts", "times"])


def _fingerprint(gram: int, context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16, key=(gram & (1 << 64) - 1).to_bytes(8)).digest()


def _contexts(fingerprints: bool) -> Callable:
    """Cut the contexts of texts' runs; with fingerprints, the bytes of equal ones stand once in a batch, else null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _flat(batch.column("text"))
            lists, runs = batch.column("runs"), batch.column("runs").flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            gram, first, off, starts, times = (runs.field(c).to_numpy() for c in ("gram", "first", "off", "starts", "times"))
            for begin in range(0, len(gram), ROWS):
                some = slice(begin, begin + ROWS)
                size = starts[some].astype(np.int64) + LENGTH - 1
                ends = np.cumsum(size)
                cut_out = data[np.repeat(offsets[row[some]] + first[some] - (ends - size), size) + np.arange(ends[-1])]
                context = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(cut_out)])
                columns = {"gram": gram[some], "off": off[some], "k1": k1[row[some]], "k2": k2[row[some]], "first": first[some], "stride": starts[some], "times": times[some]}
                if fingerprints:
                    seen: set[bytes] = set()
                    bytes_of = context.to_pylist()
                    ids = [_fingerprint(g, c) for g, c in zip(gram[some].tolist(), bytes_of, strict=True)]
                    columns["id"] = pa.array(ids, pa.binary())
                    context = pa.array([None if x in seen else seen.add(x) or c for x, c in zip(ids, bytes_of, strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(columns | {"context": context})

    return cut


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (depth, first, last) of suffixes of which lcp[i] is the prefix that i and i + 1 share; inner ones first."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > depth:
            above, left = stack.pop()
            yield above, left, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def maximal_repeats(bucket: np.ndarray, off: np.ndarray, weight: np.ndarray, contexts: pa.Array, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, begins and lengths of the occurrences of maximal repeats of LENGTH bytes or more, and the repeats' numbers.

    ``bucket`` doesn't decrease; a context of weight 2 or more occurs twice. Of the repeats that begin at one place of a
    context the longest is given, or ``every`` one.
    """
    n, width = len(bucket), REACH + LENGTH
    offsets, data = _flat(contexts)
    sizes = np.diff(offsets)
    table = np.zeros(n * width, np.uint8)
    table[np.repeat(np.arange(n) * width + REACH - off - (offsets[:-1] - offsets[0]), sizes) + np.arange(sizes.sum())] = data[offsets[0] : offsets[-1]]
    table = table.reshape(n, width)
    right = sizes - off
    order = np.argsort(right, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(table[:, REACH:]).view(f"S{LENGTH}").ravel()[order], kind="stable")]
    order = order[np.argsort(bucket[order], kind="stable")]
    order = np.repeat(order, np.minimum(weight[order], 2))
    same = table[order[1:], REACH:] != table[order[:-1], REACH:]
    lcp = np.where(same.any(axis=1), same.argmax(axis=1), LENGTH)
    lcp = np.minimum(lcp, np.minimum(right[order[1:]], right[order[:-1]])) * (bucket[order[1:]] == bucket[order[:-1]])
    lcp = np.concatenate([[0], lcp])
    rows, begins, depths, numbers, number = [], [], [], [], 0

    def emit(members: np.ndarray, at: int, depth: np.ndarray, of: np.ndarray) -> None:
        rows.append(members)
        begins.append(off[members] - at)
        depths.append(depth)
        numbers.append(of)

    for at in range(REACH + 1):
        left = np.where(off[order] > at, table[order, REACH - at - 1].astype(np.int64), -1) if at < REACH else np.full(len(order), -1)
        hit = np.flatnonzero(lcp >= LENGTH)
        if len(hit):
            diverse = (left[hit] != left[hit - 1]) | (left[hit] < 0) | (left[hit - 1] < 0)
            begin = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
            size = np.diff(np.append(begin, len(hit)))
            some = np.add.reduceat(diverse.astype(np.int64), begin) > 0
            pairs = hit[begin[some & (size == 1)]]
            ids = number + np.arange(len(pairs))
            number += len(pairs)
            emit(np.concatenate([order[pairs - 1], order[pairs]]), at, np.concatenate([lcp[pairs], lcp[pairs]]), np.concatenate([ids, ids]))
            for b, m in zip(begin[some & (size > 1)], size[some & (size > 1)], strict=True):
                members, differs, deepest = order[hit[b] - 1 : hit[b] + m], np.concatenate([[0], np.cumsum(diverse[b : b + m])]), np.zeros(m + 1, np.int64)
                for depth, first, last in lcp_intervals(lcp[hit[b] : hit[b] + m].tolist()):
                    if differs[last] == differs[first]:
                        continue
                    if every:
                        emit(members[first : last + 1], at, np.full(last + 1 - first, depth), np.full(last + 1 - first, number))
                        number += 1
                    else:
                        inside = deepest[first : last + 1]
                        inside[inside == 0] = depth
                emit(members[deepest > 0], at, deepest[deepest > 0], np.full((deepest > 0).sum(), number))
                number += not every
        stay = np.flatnonzero(left >= 0)
        if not len(stay):
            break
        key = bucket[order[stay]] * 256 + left[stay]
        moved = np.argsort(key, kind="stable")
        key, place = key[moved], stay[moved]
        lcp, order = _next_lcp(lcp, key, place), order[place]
    if not rows:
        return (np.zeros(0, np.int64),) * 4
    return np.concatenate(rows), np.concatenate(begins), np.concatenate(depths), np.concatenate(numbers)


def _next_lcp(lcp: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Prefixes that neighbours share after the sort by the byte to the left: one more than the least between their old places."""
    out = np.zeros(len(key), np.int64)
    joined = np.flatnonzero(key[1:] == key[:-1]) + 1
    low, high = place[joined - 1] + 1, place[joined] + 1
    out[joined] = lcp[low] + 1
    if len(far := np.flatnonzero(high > low + 1)):
        between = np.stack([low[far], high[far]], axis=1).ravel()
        out[joined[far]] = np.minimum.reduceat(np.append(lcp, 0), between)[::2] + 1
    return out


def _merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans that touch, by owner."""
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    far = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(owner * far + end)
    new = np.flatnonzero(np.concatenate([[True], owner[1:] * far + begin[1:] > reach[:-1]])) if len(owner) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(owner)) - 1 if len(new) else new
    return owner[new], begin[new], reach[last] - owner[new] * far


def _scan(owners: tuple[str, ...], every: bool = False) -> Callable:
    """Scan buckets, whose rows follow each other; owners stay, with the begin and the length of each span in the owner's bytes."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        gram = batch.column("gram").to_numpy()
        bucket = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
        times = batch.column("times").to_numpy().astype(np.int64) if "times" in batch.schema.names else np.ones(len(gram), np.int64)
        weight = batch.column("weight").to_numpy() if "weight" in batch.schema.names else times
        contexts, stride = batch.column("context"), batch.column("stride").to_numpy().astype(np.int64) if "stride" in batch.schema.names else np.zeros(len(gram), np.int64)
        rows, begin, depth, number = maximal_repeats(bucket, batch.column("off").to_numpy(), weight, contexts, every)
        columns = {}
        if every:
            again = np.unique(np.stack([number, rows, begin]), axis=1, return_index=True)[1] if len(rows) else rows  # a context of weight 2 stands once
            rows, begin, depth = rows[again], begin[again], depth[again]
            names = np.array([hashlib.blake2b(contexts[r].as_py()[b : b + d], digest_size=16).digest() for r, b, d in zip(rows.tolist(), begin.tolist(), depth.tolist(), strict=True)], object)
            turn = np.concatenate([np.arange(k) for k in times[rows].tolist()]) if len(rows) else rows  # at every turn of a period
            names, begin, depth, rows = (np.repeat(x, times[rows]) for x in (names, begin, depth, rows))
            begin = begin + turn * stride[rows]
            columns["group"] = pa.array(names.tolist(), pa.binary())
        else:
            rows, begin, end = _merged(rows, begin, begin + depth)
            depth = end - begin + (times[rows] - 1) * stride[rows]  # what occurs again at once is covered whole
        first = batch.column("first").to_numpy()[rows].astype(np.int64) if "first" in batch.schema.names else 0
        kept = {c: batch.column(c).take(pa.array(rows)) for c in owners}
        yield pa.RecordBatch.from_pydict(kept | columns | {"begin": pa.array((begin + first).astype(np.int32)), "length": pa.array(depth.astype(np.int32))})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(begin, ROWS))
                if sum(b.num_rows for b in held) < ROWS:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                gram = whole.column("gram").to_numpy()
                to = len(gram) - int(np.argmax(gram[::-1] != gram[-1])) if gram[0] != gram[-1] else 0  # the last bucket may go on
                if to:
                    yield from of(whole.slice(0, to))
                held = [whole.slice(to)]
        if any(b.num_rows for b in held):
            yield from of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return scan


def _bucket_scan(contexts: DataFrame, owners: tuple[str, ...], every: bool) -> DataFrame:
    kinds = dict(contexts.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in owners], *["group binary"] * every, "begin int", "length int"])
    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_scan(owners, every), schema)


def _blocks(size: int) -> Callable:
    """Cut contexts into blocks of ``size`` windows; a block's bucket is decided by the bytes that all its windows share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            out: list[list] = [[] for _ in range(7)]
            for gram, off, parent, weight, context in zip(*[batch.column(c).to_pylist() for c in ("gram", "off", "id", "weight", "context")], strict=True):
                least = off - (len(context) - LENGTH)
                for block in range(least // size, off // size + 1):
                    low, high = max(least, block * size), min(off, block * size + size - 1)
                    core = context[off - block * size : off - block * size - size + 1 + LENGTH]
                    part = context[off - high : off - low + LENGTH]
                    to = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=(gram & (1 << 64) - 1).to_bytes(8), salt=block.to_bytes(2)).digest(), signed=True)
                    name = _fingerprint(to, part)
                    for values, value in zip(out, (to, high, name, weight, None if name in seen else part, parent, off - high), strict=True):
                        values.append(value)
                    seen.add(name)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["gram", "off", "id", "weight", "context", "parent", "shift"])

    return cut


BLOCK_ROWS = "gram long, off int, id binary, weight long, context binary, parent binary, shift int"


def _distinct(rows: DataFrame, weight: Column) -> DataFrame:
    """Equal contexts as one, of the sum of their weights."""
    found = rows.groupBy("id").agg(F.first("gram").alias("gram"), F.first("off").alias("off"), weight.alias("weight"), F.max("context").alias("context"))
    return materialize(found, "repeat-distinct")


def _hot_spans(distinct: DataFrame, every: bool, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """id, begin and length of the spans of distinct contexts, whose buckets may have any size."""
    large = distinct.groupBy("gram").count().filter(F.col("count") > MOST).select("gram")
    if not blocks or large.isEmpty():
        return _bucket_scan(distinct, ("id",), every)
    small = _bucket_scan(distinct.join(large, "gram", "left_anti"), ("id",), every)
    cut = materialize(distinct.join(large, "gram", "left_semi").select("gram", "off", "id", "weight", "context").mapInArrow(_blocks(blocks[0]), BLOCK_ROWS), "repeat-blocks")
    found = _hot_spans(_distinct(cut, F.sum("weight")), every, blocks[1:])
    links = cut.select(F.col("id").alias("part"), "parent", "shift")
    above = found.withColumnRenamed("id", "part").join(links, "part").withColumn("begin", F.col("begin") + F.col("shift")).drop("part", "shift").withColumnRenamed("parent", "id")
    return small.unionByName(above)


def _text_keys(text: Column) -> list[Column]:
    """96 bits of hashes that name a text."""
    return [F.xxhash64(text).alias("k1"), (F.crc32(text.cast("binary")) - (1 << 31)).cast("int").alias("k2")]


def _texts(docs: DataFrame) -> DataFrame:
    """Every text of LENGTH bytes or more once, with the number of its copies, stored in buckets by its key.

    Later joins of this table by its key move the other side only.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*_text_keys(text), text.alias("text")).filter(F.octet_length("text") >= LENGTH).groupBy(*KEYS).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"repeat_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.option("path", shared_path(spark, "repeat-texts")).option("compression", "zstd").bucketBy(buckets, *KEYS).saveAsTable(name)
    stored = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone: the files are in a folder of ours, and the frame knows them and their buckets
    return stored


def _spans(texts: DataFrame, every: bool = False) -> DataFrame:
    """k1, k2, begin and length of the repeats' occurrences in distinct texts."""
    runs = texts.select(*KEYS, "text").mapInArrow(_runs, RUNS)
    counts = materialize(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("turns")).filter("turns > 1"), "repeat-grams")

    def contexts(grams: DataFrame, fingerprints: bool) -> DataFrame:
        by_text = runs.join(grams.select("gram"), "gram").groupBy(*KEYS).agg(F.collect_list(F.struct("gram", "first", "off", "starts", "times")).alias("runs"))
        schema = "gram long, off int, k1 long, k2 int, first int, stride int, times int, " + "id binary, " * fingerprints + "context binary"
        return texts.select(*KEYS, "text").join(by_text.hint("shuffle_hash"), [*KEYS]).mapInArrow(_contexts(fingerprints), schema)

    spans = _bucket_scan(contexts(counts.filter(F.col("n") <= MOST), False), KEYS, every)
    hot = counts.filter(F.col("n") > MOST)
    if hot.isEmpty():
        return spans
    cut = materialize(contexts(hot, True), "repeat-hot")
    found = _hot_spans(_distinct(cut, F.sum("times")), every)
    placed = cut.select("id", *KEYS, "first", "stride", "times").join(found, "id")
    if every:
        placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("begin", F.col("begin") + F.col("first") + F.col("turn") * F.col("stride")).drop("turn")
    else:
        placed = placed.withColumn("begin", F.col("begin") + F.col("first")).withColumn("length", F.col("length") + (F.col("times") - 1) * F.col("stride"))
    return spans.unionByName(placed.drop("id", "first", "stride", "times"))


REMOVED = "k1 long, k2 int, n_removed long, n_spans long, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, copies, spans in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("spans"), strict=True):
            data = text.as_buffer()
            if copies > 1:
                begin, end = np.zeros(1, np.int64), np.full(1, data.size)
            else:
                first = spans.values.field("begin").to_numpy().astype(np.int64)
                _, begin, end = _merged(np.zeros(len(first), np.int64), first, first + spans.values.field("length").to_numpy())
            gaps = zip([0, *end.tolist()], [*begin.tolist(), data.size], strict=True)
            for values, value in zip(out, (int((end - begin).sum()), len(begin), b"".join(data[a:b].to_pybytes() for a, b in gaps)), strict=True):
                values.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["k1", "k2", "n_removed", "n_spans", "kept"])


def removals(docs: DataFrame) -> DataFrame:
    """k1, k2, n_removed, n_spans and kept of every distinct text of which bytes are removed."""
    texts = _texts(docs)
    by_text = _spans(texts).groupBy(*KEYS).agg(F.collect_list(F.struct("begin", "length")).alias("spans"))
    rows = texts.join(by_text.hint("shuffle_hash"), [*KEYS], "left").filter((F.col("copies") > 1) | F.col("spans").isNotNull())
    return rows.mapInArrow(_removed, REMOVED)


def remove(docs: DataFrame) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and kept (the bytes that are left, binary), which stand last."""
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__in"), text.cast("binary").alias("__text"), *_text_keys(text))
    found = rows.join(removals(docs), [*KEYS], "left")
    kept = [F.col(f"__in.`{c}`").alias(c) for c in docs.columns if c.lower() not in new]
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select(*kept, F.octet_length("__text").cast("long").alias("n_bytes"), number("n_removed"), number("n_spans"), F.coalesce("kept", "__text").alias("kept"))


def groups(docs: DataFrame) -> DataFrame:
    """The maximal repeats with all their occurrences: group, length, doc_id and begin (in bytes).

    Repeats reach as far as the contexts of their anchor; a longer one is a chain of such groups. Copies of a text are a group too.
    """
    texts = _texts(docs)
    whole = texts.filter("copies > 1").select(*KEYS, F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("group"), F.lit(0).alias("begin"), F.octet_length("text").alias("length"))
    found = _spans(texts, every=True).unionByName(whole)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *_text_keys(text)).join(found, [*KEYS]).select("group", "length", "doc_id", "begin")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of what is left, of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *_text_keys(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("__whole"))
    found = removals(docs).select(*KEYS, "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(found, [*KEYS], "left").select("doc_id", "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept_sha256", "__whole").alias("kept_sha256"))
