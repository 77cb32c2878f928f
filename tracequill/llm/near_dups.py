"""Near-duplicate detection by BagMinHash signatures, bands and exact multiset overlap.

A text is the multiset of its word 5-grams (of all its words, if it has fewer). The weight of a
gram, its count, is discretised into the levels 0, 1, 2, 4, 8, ...; every interval of levels has a
Poisson process of its own, keyed by the gram and the interval, whose points carry a register, a
time and a level. A gram's count takes part in the intervals below it, and of the interval that it
cuts in the points whose level lies below it, so the earliest time of each register is equal for
two texts with the probability of their weighted Jaccard similarity. Points are drawn in order
of time and only until no later one can be the earliest of a register.

Equal texts are one class from the start. The signatures of distinct texts are cut into BANDS
bands of ROWS registers; texts with an equal band are a group. First every text is compared by exact weighted
Jaccard similarity with one other, that among the least ids of its groups with which it shares the most groups. Then, in
groups of up to SMALL texts, any two that aren't in one class yet are compared, unless one is too short to be similar enough. Each larger group that holds
more than one class gets a hub, the text with the most links so far, and every text is compared with that hub of
another class with which it shares the most groups. At last all pairs of different classes in such a group
are compared, block by block, all overlaps of two blocks by one product of matrices. Links
of THRESHOLD or more make classes, so classes are those of comparing all pairs with an equal band.
Both rounds take one comparison a text; the last step is linear where most texts of a group are of
one class, and else it grows with the square of the group over BLOCK.

The hashes of words and grams have 64 bits. Two texts with a similarity of 0.8 share no band
with a probability of about (1 - 0.8 ** ROWS) ** BANDS, 7e-6.

Cases: null, empty and wordless texts are classes of their own; repeated rows and equal texts
are one class; a class without any id has a null class_id; an empty table gives no rows; other
columns don't matter to classes() and are kept by deduplicate(), which of rows that agree in id and
text keeps the one whose other columns have the least hash. Ids of texts only tell them apart, so
classes don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_RE, discard, kept, materialize, slices

GRAM = 5
THRESHOLD = 0.8
ROWS = 8
BANDS = 64
REGISTERS = ROWS * BANDS
TICK = 2.0**-32
#: In groups of up to so many texts all pairs of different classes are compared at once.
SMALL = 8
#: With so few pairs a row of the large groups, no hub is drawn; all are compared in blocks.
FEW = 2
#: Texts of a block, and distinct grams that are looked at together.
BLOCK = 256
COLUMNS = 8192
#: Graphs of up to so many edges are labelled by one task.
ONE_TASK = 200_000
REMEMBERED = 400_000
#: Texts signed together have about so many characters, so that their registers stay in cache.
SIGNED_CHARS = 1_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """A mix of 64 bits in which every input bit bears on every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and up to 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


class Grams:
    """Hashed word grams of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams in ascending order, and their counts."""
        words = WORD_RE.findall(text or "")
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self.known[words[i]] = xxhash.xxh64_intdigest(words[i].encode("utf-8", "surrogatepass"))
        h = np.array(found, np.uint64)
        n = max(1, len(h) - GRAM + 1)
        gram = np.full(n, len(h) if len(h) < GRAM else GRAM, np.uint64)
        for k in range(min(GRAM, len(h))):
            gram = scramble(gram * _A + h[k : k + n])
        return np.unique(gram, return_counts=True)


def signatures(grams: list[np.ndarray], counts: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """For each multiset the earliest time in each of its registers (a power of two); inf if it is empty."""
    best = np.full(len(grams) * registers, np.inf)
    gram, weight = np.concatenate([np.zeros(0, np.uint64), *grams]), np.concatenate([np.zeros(0, np.int64), *counts])
    base = np.repeat(np.arange(len(grams), dtype=np.int64) * registers, [len(g) for g in grams])
    # Intervals of levels [0, 1), [1, 2), [2, 4), ...: lower end and width; cut: the weight, where it lies inside.
    parts, level = [(gram, base, np.zeros(len(gram)), np.ones(len(gram)), weight)], 1
    while (over := np.nonzero(weight > level)[0]).size:
        gram, base, weight = gram[over], base[over], weight[over]
        ends = np.full(len(over), float(level))
        parts.append((gram, base, ends, ends, weight))
        level *= 2
    gram, base, low, width, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    state = scramble(gram + _A * (low.astype(np.uint64) + np.uint64(1)))
    whole = weight >= low + width
    simple = (low == 0) & whole
    by_doc = best.reshape(-1, registers)
    latest = np.full(len(by_doc), np.inf)
    for chosen, plain in ((simple, True), (~simple, False)):
        s, d = state[chosen], base[chosen]
        lo, wi, we = (x[chosen] for x in (low, width, weight))
        t = np.zeros(len(s))
        while len(s):
            # Several points of each process at a time where there are few processes.
            n = max(1, min(64, 8192 // len(s)))
            s = s[:, None] + _A * np.arange(1, n + 1, dtype=np.uint64)
            a = scramble(s)
            # Multiples of TICK add up exactly, so times don't depend on what else is in the batch.
            gaps = -np.log(unit(a)) / TICK
            t = t[:, None] + (np.ceil(gaps if plain else gaps / wi[:, None]) * TICK).cumsum(axis=1)
            doc = d // registers
            drawn = t < latest[doc][:, None]
            if not plain:
                drawn &= lo[:, None] + wi[:, None] * unit(scramble(a ^ _C)) <= we[:, None]
            at = d[:, None] + (a & np.uint64(registers - 1)).astype(np.int64)
            np.minimum.at(best, at[drawn], t[drawn])
            if len(doc) > len(by_doc):
                latest = by_doc.max(axis=1)
            else:
                some = np.unique(doc)
                latest[some] = by_doc[some].max(axis=1)
            live = np.nonzero(t[:, -1] < latest[doc])[0]
            s, t, d = s[live, -1], t[live, -1], d[live]
            if not plain:
                lo, wi, we = lo[live], wi[live], we[live]
    return best.reshape(-1, registers)


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("near duplicates")
    grams = Grams()
    salt = scramble(np.arange(1, BANDS + 1, dtype=np.uint64) * _A)
    for batch in slices(batches, most=SIGNED_CHARS):
        multisets = [grams.of(t) for t in batch.column("text").to_pylist()]
        rows = signatures([m[0] for m in multisets], [m[1] for m in multisets]).view(np.uint64).reshape(-1, BANDS, ROWS)
        band = np.repeat(salt[None, :], len(rows), axis=0)
        for k in range(ROWS):
            band = scramble(band * _A + rows[:, :, k])
        weights = [int(m[1].sum()) for m in multisets]
        full = np.array(weights) > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[full].reshape(-1).view(np.int64)))
        keep = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(weights, pa.int64()), bands], [*[c for c in batch.schema.names if c != "text"], "weight", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at], b[1][bt]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    last: tuple[str | None, tuple] = (None, ())
    for batch in slices(slices(batches, "a_text"), "b_text"):
        out = []
        for x, y in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True):
            if last[0] != x:
                last = (x, grams.of(x))
            out.append(similarity(last[1], grams.of(y)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of pairs of ids; the leader a's text meets the others in the last join."""
    b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    both = b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(_verifier, "a long, b long, similarity double")


def components(edges: DataFrame, name: str) -> DataFrame:
    """id, label for every end of the edges (a, b): the least id that it is linked with.

    Each round every id takes the least label of its neighbours, and then its label's label; each
    round's labels are written to the shared folder.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = edges_written = materialize(both, f"{name}-edges")
    small = both.limit(ONE_TASK + 1).count() <= ONE_TASK
    if small:  # needs no dealing: one task holds all
        both = both.coalesce(1)
    labels = before = None
    while True:
        if labels is None:
            step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.col("a").alias("label"), F.least("a", "m").alias("next"))
        else:
            near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("m"))
            step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "m").alias("next"))
            jump = labels.select(F.col("id").alias("j"), F.col("label").alias("far"))
            step = step.join(jump, F.col("next") == F.col("j"), "left").select("id", "label", F.least("next", F.coalesce("far", "next")).alias("next"))
        step = materialize(step, f"{name}-labels")
        discard(before)
        if step.filter("label <> next").isEmpty():
            discard(edges_written)
            return step.select("id", "label")
        before, labels = step, step.select("id", F.col("next").alias("label"))
        labels = labels.coalesce(1) if small else labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after links: classes that a link joins become one."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"l_{end}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = joined.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).filter("a <> b")
    found = components(joined, "near-classes").withColumnRenamed("id", "f_id").withColumnRenamed("label", "f_label")
    kept = labels.join(found, F.col("label") == F.col("f_id"), "left").select("id", F.coalesce("f_label", "label").alias("label"))
    new = found.join(labels.select("id"), F.col("f_id") == F.col("id"), "left_anti")
    return materialize(kept.unionAll(new.select("f_id", "f_label")), "near-labels")


def _close(pairs: DataFrame, texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All verified pairs, and those of THRESHOLD or more."""
    seen = materialize(_verified(pairs, texts), name)
    return seen.select("a", "b"), seen.filter(F.col("similarity") >= THRESHOLD).select("a", "b")


def _nearest(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each id with that of its hubs (id, hub: a row for each group) that it meets most often."""
    met = met.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("c"))
    met = met.groupBy("id").agg(F.max(F.struct("c", (-F.col("hub")).alias("minus"))).alias("best")).select("id", (-F.col("best.minus")).alias("hub"))
    return met.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def _links(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links (a, b) found among members (band, id, weight, n: members of the band, hub: the least of them), and labels (id, label)."""
    held = materialize(members.groupBy("id").agg(F.collect_list(F.struct("band", "n")).alias("bands"), F.first("weight").alias("weight")), "near-held-bands")
    seen, links = _close(_nearest(members.filter("id <> hub").select("id", "hub")), texts, "near-first")
    labels = components(links, "near-classes")
    small = _rows(held, labels, links).filter(F.col("n") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    # Two texts share no more grams than the shorter one has, so far shorter ones can't be similar enough.
    near = F.least("x.weight", "y.weight") >= THRESHOLD * F.greatest("x.weight", "y.weight") - 1e-6
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & near)
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    compared, new = _close(pairs.join(seen, ["a", "b"], "left_anti"), texts, "near-small")
    if not new.isEmpty():
        links, labels = links.unionAll(new), _merged(labels, new)
    seen = seen.unionAll(compared)
    rows, hubs, left = _drawn(held, labels, links)
    if left.rows is not None and left.pairs > FEW * left.rows:
        met = rows.join(hubs.select("band", (-F.col("hub.minus")).alias("hub"), F.col("hub.label").alias("hub_label")), "band").filter("label <> hub_label")
        _, new = _close(_nearest(met.select("id", "hub")).join(seen, ["a", "b"], "left_anti"), texts, "near-hubs")
        if not new.isEmpty():
            links, labels = links.unionAll(new), _merged(labels, new)
            rows, hubs, left = _drawn(held, labels, links)
    if left.rows is None:  # each group is of one class
        return links, labels
    new = materialize(_rest(rows.join(hubs.select("band"), "band", "left_semi"), texts), "near-rest")
    return (links, labels) if new.isEmpty() else (links.unionAll(new), _merged(labels, new))


def _rows(held: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """band, n, id, weight, label, degree (the number of its links) of the groups of held (id, bands, weight)."""
    ends = links.select(F.explode(F.array("a", "b")).alias("e_id")).groupBy("e_id").agg(F.count(F.lit(1)).alias("degree"))
    known = labels.select(F.col("id").alias("m_id"), "label").join(ends, F.col("m_id") == F.col("e_id"), "left")
    known = held.join(known, F.col("id") == F.col("m_id"), "left").select("id", "bands", "weight", F.coalesce("label", "id").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return materialize(known.select("id", "weight", "label", "degree", F.explode("bands").alias("b")).select("b.band", "b.n", "id", "weight", "label", "degree"), "near-rows")


def _drawn(held: DataFrame, labels: DataFrame, links: DataFrame):
    """rows of the large groups, those of their bands that hold more than one class with their hubs, and how many rows and pairs these have."""
    rows = _rows(held, labels, links).filter(F.col("n") > SMALL)
    best = F.max(F.struct("degree", (-F.col("id")).alias("minus"), "label"))
    by_class = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"), best.alias("hub"))
    hubs = by_class.groupBy("band").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("main"), F.max("hub").alias("hub"), F.count(F.lit(1)).alias("classes"))
    hubs = materialize(hubs.filter("classes > 1"), "near-hubs-drawn")
    return rows, hubs, hubs.agg(F.sum("size").alias("rows"), F.sum(F.expr("(size - main.c) * size")).alias("pairs")).first()


def _rest(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between all texts of different classes that share a band in rows (band, id, label).

    Groups that share texts are dealt together to blocks, those of their largest class to blocks of its own.
    """
    rows = materialize(rows.select("band", "id", "label"), "near-left")
    least = rows.groupBy("band").agg(F.min("id").alias("a"))
    together = components(rows.join(least, "band").filter("a <> id").select("a", F.col("id").alias("b")), "near-together")
    ends = rows.select("id", "label").distinct().join(together.withColumnRenamed("label", "part"), "id")
    sizes = ends.groupBy("part", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("part").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("size"))
    ends = ends.join(sizes, "part").withColumn("is_main", F.col("label") == F.col("main.label"))
    blocks = F.ceil(F.when(F.col("is_main"), F.col("main.c")).otherwise(F.col("size") - F.col("main.c")) / BLOCK)
    block = F.xxhash64("part", "is_main", F.pmod(F.xxhash64("id"), blocks))
    ends = materialize(ends.select("id", "label", block.alias("block")), "near-blocks")
    held = rows.select("band", "id").join(ends, "id").groupBy("band", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = held.alias("x"), held.alias("y")
    differ = F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.block") <= F.col("y.block")) & differ)
    pairs = materialize(pairs.select(F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct(), "near-block-pairs")
    sides = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    sent = sides.join(ends.join(texts, "id"), "block")
    return sent.groupBy("p", "q").applyInArrow(_block_links, "a long, b long")


def overlaps(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many grams any of xs has in common with any of ys, repeated ones as often as both have them."""
    sides = []
    for side in (xs, ys):
        gram, count = np.concatenate([g for g, _ in side]), np.concatenate([c for _, c in side])
        owner = np.repeat(np.repeat(np.arange(len(side)), [len(g) for g, _ in side]), count)
        again = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        token = np.repeat(gram, count)
        sides.append((owner, np.where(again > 0, scramble(token + _B * again.astype(np.uint64)), token)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(xs), len(ys)), np.float64)
    for k in range(0, len(both), COLUMNS):
        part, dense = both[k : k + COLUMNS], []
        for side, (owner, token) in zip((xs, ys), sides, strict=True):
            at = np.minimum(np.searchsorted(part, token), len(part) - 1)
            found = part[at] == token
            dense.append(np.zeros((len(side), len(part)), np.float32))
            dense[-1][owner[found], at[found]] = 1
        out += dense[0] @ dense[1].T
    return out


def _block_links(table: pa.Table) -> pa.Table:
    grams, side = Grams(), {}
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    block = table.column("block").to_numpy()
    for name in {p, q}:
        rows = table.filter(pa.array(block == name))
        side[name] = rows.column("id").to_numpy(), rows.column("label").to_numpy(), [grams.of(t) for t in rows.column("text").to_pylist()]
    (x_id, x_label, xs), (y_id, y_label, ys) = side[p], side[q]
    both = overlaps(xs, ys)
    weight = np.array([c.sum() for _, c in xs], np.float64)[:, None] + np.array([c.sum() for _, c in ys], np.float64)[None, :]
    i, j = np.nonzero((both / np.maximum(1, weight - both) >= THRESHOLD) & (x_label[:, None] != y_label[None, :]))
    if p == q:
        i, j = i[i < j], j[i < j]
    return pa.table({"a": pa.array(np.minimum(x_id[i], y_id[j]), pa.int64()), "b": pa.array(np.maximum(x_id[i], y_id[j]), pa.int64())})


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with words, and text_key, which is equal for equal texts only."""
    return docs.filter(F.col("text").rlike(WORD)).withColumn("text_key", F.unhex(F.sha2("text", 256)))


def _groups(docs: DataFrame) -> DataFrame:
    """text_key, least (its least doc_id), copies, links, label: a row for each text with words."""
    signed = _keyed(docs.select("doc_id", "text")).select("doc_id", "text_key", "text")
    signed = materialize(signed.mapInArrow(_signer, "doc_id long, text_key binary, weight long, bands array<long>"), "near-signed")
    reps = signed.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "near-texts")
    banded = reps.select("id", "weight", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).filter("n > 1")
    members = materialize(banded.join(shared, "band").select("band", "id", "weight", "n", "hub"), "near-members")
    held = reps.join(members.select(F.col("id").alias("m")).distinct(), F.col("id") == F.col("m"), "left_semi")
    held = held.select("id", F.col("text_key").alias("h_key"), "least")
    texts = _keyed(docs.select("doc_id", "text")).join(held, (F.col("text_key") == F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("least")))
    texts = materialize(texts.select("id", "text").dropDuplicates(["id"]), "near-held")
    links, labels = _links(members, texts)
    ends = links.select(F.explode(F.array("a", "b")).alias("e_id")).groupBy("e_id").agg(F.count(F.lit(1)).alias("links"))
    found = reps.select("id", "text_key", "least", "copies").join(labels.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left")
    found = found.join(ends, F.col("id") == F.col("e_id"), "left")
    return found.select("text_key", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "id").alias("label"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copies, links: a row for each row of docs.

    class_id is the least doc_id of the class, copies the number of rows with the same text, links
    the number of other texts that the text was found to be similar to by comparison.
    """
    groups = materialize(_groups(docs), "near-groups")
    least = groups.groupBy(F.col("label").alias("l")).agg(F.min("least").alias("class_id"))
    groups = groups.join(least, F.col("label") == F.col("l")).select(F.col("text_key").alias("g_key"), "class_id", "copies", "links")
    worded = _keyed(docs.select("doc_id", "text")).select("doc_id", "text_key").join(groups, F.col("text_key") == F.col("g_key"))
    bare = docs.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return worded.select("doc_id", "class_id", "copies", "links").unionAll(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long"), F.lit(0).cast("long")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class with its columns: that of the least id, and all rows without words."""
    groups = _groups(docs)
    kept = groups.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "text_key")).alias("k"))
    kept = kept.select(F.col("k.least").alias("__least"), F.col("k.text_key").alias("__text_key"))
    keyed = docs.filter(F.col("text").rlike(WORD)).withColumn("__key", F.unhex(F.sha2("text", 256)))
    worded = keyed.join(kept, (F.col("__key") == F.col("__text_key")) & F.col("doc_id").eqNullSafe(F.col("__least")))
    rest = F.sha2(F.to_json(F.struct(*[c for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"}), 256)
    worded = worded.groupBy("__text_key").agg(F.min_by(F.struct(*docs.columns), rest).alias("__row")).select("__row.*")
    bare = docs.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return worded.select(*docs.columns).unionAll(bare)
