"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by the forward
algorithm; that of a text the product over its words. Piece probabilities are fitted by
expectation maximisation (forward and backward) on the words of a bounded sample of labelled
texts, SAMPLE documents of each language at most on average, chosen by a hash of their id; each
language is fitted by a task of its own. Words are maximal runs of letters (Unicode's category L) in
lower case, so marks, digits and case don't matter. Words of any length are scored whole: those of over
LONG letters with the last positions' sums alone, scaled as they go. Only for fitting are such runs cut into parts.

Cases: a text that is null or has no letter is 'und' with score 0; ties go to the language
that comes first by code point; a corpus without labelled text knows no language, so all is
'und'; equal texts get equal results; an empty table gives no rows. The model has a number for each piece and
language; with more than LANGUAGES labels train() fails, as that many models are a parameter for its caller to raise.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, remainder, slices
from .vocabulary import MARK, Trie, default_piece_model, pieces

SAMPLE = 400
#: More labels than this are refused (a language's table has 256 KB).
LANGUAGES = 1_000
ROUNDS = 3
SMOOTHING = 0.05
#: Probability of a character that is in no piece, in any language.
UNKNOWN = 1e-7
#: Longer runs of letters are scored position by position; SEGMENT of their pieces are looked up together.
LONG = 48
SEGMENT = 8192
#: Factor for each character that keeps products of probabilities near 1.
LIFT = np.exp(2.5)
#: Scores of words that are remembered: so many numbers, a word's for each language.
REMEMBERED = 800_000
UNDETERMINED = "und"
CHUNK = 4096


#: Runs of what Python takes for a word's characters, without digits; other numerals are still among them.
ALNUM = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, that is of Unicode's category L, in lower case."""
    found = ALNUM.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():
        found = [p for w in found for p in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return found


@dataclass
class Model:
    """names: the pieces; probabilities: a row for each piece, the unknown one and a zero row."""

    names: list[str]
    languages: list[str]
    probabilities: np.ndarray


def _trie(names: list[str]) -> Trie:
    tries = kept("language").setdefault("tries", {})
    key = hash(tuple(names))
    if key not in tries:
        tries.clear()
        tries[key] = Trie(names)
    return tries[key]


def _edges(trie: Trie, words: list[str], unknown: int):
    ids, lengths = trie.edges([MARK + w for w in words])
    inside = np.arange(ids.shape[2])[None, :] < lengths[:, None]
    ids[0] = np.where((ids[0] < 0) & inside, unknown, ids[0])
    return ids, lengths


def _lifted(ids: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    return [table * LIFT ** (k + 1) for k in range(len(ids))]


def _forward(ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    n, most = ids.shape[1:]
    alpha = np.zeros((most + 1, n, tables[0].shape[1]))
    alpha[0] = 1.0
    for p in range(1, most + 1):
        for k in range(1, min(p, len(ids)) + 1):
            piece = ids[k - 1, :, p - k]
            if (at := np.nonzero(piece >= 0)[0]).size:
                alpha[p, at] += alpha[p - k, at] * tables[k - 1][piece[at]]
    return alpha


def long_score(trie: Trie, word: str, table: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length in each language."""
    text, unknown = MARK + word, len(table) - 2
    # ahead[k]: the sum over segmentations that end k characters on, times exp(-scale).
    ahead, scale = np.zeros((trie.longest + 1, table.shape[1])), np.zeros(table.shape[1])
    ahead[0] = 1.0
    for begin in range(0, len(text), SEGMENT):
        ids, _ = trie.edges([text[begin : begin + SEGMENT + trie.longest - 1]])
        here = min(SEGMENT, len(text) - begin)
        ids = ids[:, 0, :here].T.astype(np.int64)
        ids[ids[:, 0] < 0, 0] = unknown
        for row in ids:
            k = np.nonzero(row >= 0)[0]
            ahead[k + 1] += ahead[0] * table[row[k]]
            most = np.maximum(ahead[1:].max(axis=0), 1e-300)
            ahead[:-1] = ahead[1:] / most
            ahead[-1] = 0.0
            scale += np.log(most)
    return np.log(np.maximum(ahead[0], 1e-300)) + scale


def word_scores(trie: Trie, words: list[str], table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for i in [i for i, w in enumerate(words) if len(w) > LONG]:
        out[i] = long_score(trie, words[i], table)
    order = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
    for b in range(0, len(order), CHUNK):
        part = order[b : b + CHUNK]
        ids, lengths = _edges(trie, [words[i] for i in part], len(table) - 2)
        alpha = _forward(ids, _lifted(ids, table))
        last = alpha[lengths, np.arange(len(part))]
        out[part] = np.log(np.maximum(last, 1e-300)) - (lengths * np.log(LIFT))[:, None]
    return out


def fit_table(trie: Trie, n_pieces: int, counts: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """One language's piece probabilities, with those of the unknown character and of no piece."""
    words = sorted(counts, key=lambda w: (len(w), w))
    times = np.array([counts[w] for w in words], float)
    chunks = [(_edges(trie, words[b : b + CHUNK], n_pieces), times[b : b + CHUNK]) for b in range(0, len(words), CHUNK)]
    expected = np.zeros(n_pieces + 1)
    for (ids, _), t in chunks:
        for k in range(len(ids)):
            row, start = np.nonzero(ids[k] >= 0)
            np.add.at(expected, ids[k, row, start], t[row])
    for r in range(rounds + 1):
        smooth = expected[:n_pieces] + SMOOTHING
        table = np.concatenate([smooth / smooth.sum() * (1 - UNKNOWN), [UNKNOWN, 0.0]])[:, None]
        if r == rounds:
            return table[:, 0]
        expected = np.zeros(n_pieces + 1)
        for (ids, lengths), t in chunks:
            tables = _lifted(ids, table)
            alpha = _forward(ids, tables)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[lengths, np.arange(len(lengths))] = 1.0
            for p in range(ids.shape[2] - 1, -1, -1):
                for k in range(1, min(ids.shape[2] - p, len(ids)) + 1):
                    piece = ids[k - 1, :, p]
                    if (at := np.nonzero(piece >= 0)[0]).size:
                        beta[p, at] += beta[p + k, at] * tables[k - 1][piece[at], 0]
            scale = t / np.maximum(beta[0], 1e-300)
            for k in range(len(ids)):
                row, start = np.nonzero(ids[k] >= 0)
                piece = ids[k, row, start]
                np.add.at(expected, piece, alpha[start, row] * tables[k][piece, 0] * beta[start + k + 1, row] * scale[row])
    raise AssertionError


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen.update((lang, w[i : i + LONG]) for w in letter_words(text) for i in range(0, len(w), LONG))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def _fitted(names: list[str]):
    def run(key: tuple, words: pa.Table) -> pa.Table:
        counts = dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist(), strict=True))
        table = fit_table(_trie(names), len(names), counts)
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([table], pa.list_(pa.float64()))], ["lang", "probabilities"])

    return run


def train(docs: DataFrame, model: str | None = None, sample: int = SAMPLE) -> Model:
    """Fit on text and lang of the rows whose remainder is not 2, a bounded sample of them."""
    names = [name for name, _ in pieces(model or default_piece_model())]
    known = docs.filter((remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", "lang", "text")
    draw = F.pmod(F.xxhash64(F.lit("lid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = known.groupBy(F.col("lang").alias("s_lang")).agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    share = share.limit(LANGUAGES + 1).collect()
    if len(share) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # A row for each of LANGUAGES at most: they go to the texts, which stay where they are.
    share = docs.sparkSession.createDataFrame([tuple(r) for r in share], "s_lang string, share double")
    drawn = known.withColumn("draw", draw).join(F.broadcast(share), F.col("lang") == F.col("s_lang")).filter("draw < share")
    counted = drawn.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = counted.groupBy("lang").applyInArrow(_fitted(names), "lang string, probabilities array<double>").toArrow()
    by_lang = dict(zip(fitted.column("lang").to_pylist(), fitted.column("probabilities").combine_chunks() if fitted.num_rows else [], strict=True))
    languages = sorted(by_lang)
    tables = [by_lang[lang].values.to_numpy() for lang in languages]
    return Model(names, languages, np.stack(tables, axis=1) if tables else np.zeros((len(names) + 2, 0)))


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.trie = model, _trie(model.names)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [letter_words(t) for t in texts]
        flat = [w for ws in words for w in ws]
        if not flat or not self.model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if len(self.known) * len(self.model.languages) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        if new := sorted(set(flat) - self.known.keys()):
            self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, word_scores(self.trie, new, self.model.probabilities)])
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in words])])
        full = np.nonzero(np.diff(bounds))[0]
        total = np.add.reduceat(self.scores[at], bounds[full], axis=0)
        best = np.argmax(np.round(total, 6), axis=1)
        top = total[np.arange(len(full)), best][:, None]
        share = np.round(1.0 / np.exp(np.minimum(total - top, 0)).sum(axis=1), 9)
        names, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for i, k, p in zip(full.tolist(), best.tolist(), share.tolist(), strict=True):
            names[i], sure[i] = self.model.languages[k], p
        return names, sure


def _predictor(shared, key: int, names_out: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = kept("language").setdefault("scorers", {})
        if key not in scorers:
            scorers.clear()
            scorers[key] = _Scorer(shared.value)
        scorer = scorers[key]
        for batch in slices(batches):
            names, sure = scorer.texts(batch.column("text").to_pylist())
            keep = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names, *names_out])

    return run


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (a doc_id or other columns, and text) with the language and its share, under names that docs hasn't."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    key = zlib.crc32(model.probabilities.tobytes() + repr(model.languages).encode())
    return docs.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model), key, names), schema)
