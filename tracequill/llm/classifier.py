"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's words are its runs of letters in lower case, its runs of digits (all alike) and each other
visible character by itself. Its n-grams are the single words, pairs and triples, in which a pair of equal words, and the
equal ends of a triple, are written as a repeat mark, whatever the word; each is hashed into 2 ** BITS
weights of its kind, and a text's value of an n-gram is its share of the text's words, times GAIN. With shapes=True (off by
default) the shapes of white-space words (letter, digit and mark runs) and their pairs are features too.
Training goes over a bounded sample of the labelled rows, SAMPLE on average, chosen by a hash of their id, in EPOCHS passes in a
fixed order. A sampled text gives SAMPLE_WORDS at most, in windows spread over it, so the sample is bounded in bytes; every text is scored whole.

Cases: a null or empty text has no n-grams, so its score is that of the bias alone; null labels
are no labels; where a document has several labels the lowest counts; without labels all scores
are 0.5; equal texts get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WORD_RE, remainder, slices

BITS = 18
SAMPLE = 5000
EPOCHS = 3
GAIN = 20.0
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.1
REMEMBERED = 300_000
#: Words of a sampled text that are learned from at most, and of a window.
SAMPLE_WORDS = 20_000
WINDOW = 1_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_SIZE = 1 << BITS
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)
_KINDS = 3


def shape(word: str) -> str:
    word = re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return re.sub(r"\d+", "0", word)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _REPEAT) ^ (b + _ODD)
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


class Features:
    """Hashed n-grams of whole texts; remembers the hashes of words."""

    def __init__(self, shapes: bool = False) -> None:
        self.kinds = _KINDS + 2 * shapes
        self._shapes = shapes
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def words(self, text: str | None) -> list[str]:
        return TOKEN.findall(text.lower()) if text else []

    def _hashes(self, flat: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known, self.hashes = {}, self.hashes[:0]
        if new := list(set(flat) - self.known.keys()):
            self.known.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new)), strict=True))
            made = [xxhash.xxh64_intdigest(b"0" if w.isdigit() else w.encode("utf-8", "surrogatepass")) for w in new]
            self.hashes = np.concatenate([self.hashes, np.array(made, np.uint64)])
        return self.hashes[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]

    def of(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the n-grams that end at each word, one for each kind, and where each text's words begin."""
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        flat = [w for ws in words for w in ws]
        if not flat:
            return np.zeros((0, _KINDS), np.int64), bounds
        word = self._hashes(flat)
        place = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
        back = lambda n: np.where(place >= n, np.concatenate([np.zeros(n, np.uint64), word])[: len(word)], np.uint64(0))
        one, two = back(1), back(2)
        again, across = (one == word) & (place >= 1), (two == word) & (place >= 2)
        pair = np.where(again, _REPEAT, _mix(one, word))
        triple = np.where(across, _mix(np.full(len(word), _REPEAT), np.where(again, _REPEAT, one)), _mix(_mix(two, one), pair))
        grams = np.stack([word, pair, triple], axis=1)
        return (grams & np.uint64(_SIZE - 1)).astype(np.int64) + np.arange(_KINDS) * _SIZE, bounds

    def shapes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same for shapes and pairs of shapes of white-space words."""
        words = [[shape(w) for w in WORD_RE.findall(t or "")] for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        flat = [w for ws in words for w in ws]
        form = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1) for w in flat], np.uint64)
        place = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
        before = np.where(place >= 1, np.concatenate([np.zeros(1, np.uint64), form])[: len(form)], np.uint64(0))
        grams = np.stack([form, _mix(before, form)], axis=1) if flat else np.zeros((0, 2), np.uint64)
        return (grams & np.uint64(_SIZE - 1)).astype(np.int64) + (np.arange(2) + _KINDS) * _SIZE, bounds

    def sparse(self, texts: list[str | None], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index and value of each text's n-grams; with most, of so many of its words at most."""
        words = [_spread(self.words(t), most) for t in texts]
        parts = [self.of(words)] + ([self.shapes(texts)] if self._shapes else [])
        for i in range(len(texts)):
            index, value = [], []
            for grams, bounds in parts:
                at, times = np.unique(grams[bounds[i] : bounds[i + 1]], return_counts=True)
                index.append(at)
                value.append(times * (GAIN / max(1, bounds[i + 1] - bounds[i])))
            yield np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)


def _spread(words: list[str], most: int | None) -> list[str]:
    """words, or windows at equal distances that make up ``most`` of them."""
    if most is None or len(words) <= most:
        return words
    n = most // WINDOW
    starts = [k * (len(words) - WINDOW) // (n - 1) for k in range(n)]
    return [w for s in starts for w in words[s : s + WINDOW]]


def _sparse(shapes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shapes)
        for batch in slices(batches):
            made = list(features.sparse(batch.column("text").to_pylist(), SAMPLE_WORDS))
            yield pa.RecordBatch.from_arrays([batch.column("order"), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32())), batch.column("label")], ["order", "index", "value", "label"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, kinds: int = _KINDS) -> np.ndarray:
    """Weights of the n-grams and, last, the bias."""
    size = _SIZE * kinds + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        strong = np.abs(z[at]) > L1
        return np.where(strong, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for index, value, label in rows:
            at, x = np.append(index, size - 1), np.append(value, 1.0)
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shapes: bool = False) -> np.ndarray:
    """Weights fitted on labels.quality of documents whose remainder is not 1."""
    known = labels.filter((remainder(3) != 1) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    total = known.count()
    order = F.xxhash64(F.lit("quality"), "doc_id")
    drawn = known.withColumn("order", order).filter(F.pmod("order", F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30)))
    # The sample's bound is small, so its ids go to every task and the texts stay where they are.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))
    rows = rows.select("order", "text", "label").mapInArrow(_sparse(shapes), "order long, index array<int>, value array<float>, label int")
    seen = []
    for row in rows.toArrow().to_batches():
        values = [row.column(c) for c in ("order", "index", "value", "label")]
        seen += [(values[0][i].as_py(), values[1][i].values.to_numpy(), values[2][i].values.to_numpy(), values[3][i].as_py()) for i in range(row.num_rows)]
    seen.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return ftrl([r[1:] for r in seen], kinds=_KINDS + 2 * shapes)


def _scorer(shared, shapes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(shapes), shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            sums = np.full(batch.num_rows, float(weights[-1]))
            for grams, bounds in [features.of([features.words(t) for t in texts])] + ([features.shapes(texts)] if shapes else []):
                lengths = np.diff(bounds)
                if full := np.nonzero(lengths)[0].tolist():
                    each = weights[grams].astype(np.float64).sum(axis=1)
                    sums[full] += np.add.reduceat(each, bounds[full]) * GAIN / lengths[full]
            score = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            keep = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.round(score, 9))], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs (text and other columns) with score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    run = _scorer(shared, len(weights) > _SIZE * _KINDS + 1)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
