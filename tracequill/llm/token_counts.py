"""Token counts by a linear longest-match automaton.

The count of a word is that of the pieces which a greedy longest match from the left takes of
it, the word being marked at its start. The trie of the vocabulary has, for every node, a
failure link (the node of what is left after the longest matches of the node's text are taken)
and the number of tokens so taken, so one pass over the characters counts without going back
and without building pieces. A character that is no piece counts as the bytes of its UTF-8 form.

Cases: a null or empty text has no words and no tokens; words of any length are counted in one
linear pass; equal rows get equal counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_RE, slices
from .vocabulary import MARK, default_piece_model, pieces

#: Words whose counts a worker remembers; all are forgotten when there are more.
REMEMBERED = 400_000


class Automaton:
    """counts(word) for a vocabulary of pieces."""

    def __init__(self, names: list[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        cost: list[int] = [0]
        for name in names:
            node = 0
            for ch in name:
                node = self._step(node, ch, cost)
            if name:
                cost[node] = 1
        for ch in sorted({ch for name in names for ch in name}):
            node = self._step(0, ch, cost)
            cost[node] = cost[node] or len(ch.encode("utf-8", "surrogatepass"))
        self.fail = [0] * len(cost)
        self.popped = [0] * len(cost)
        waiting = deque([0])
        while waiting:
            parent = waiting.popleft()
            for ch, node in self.child[parent].items():
                waiting.append(node)
                if cost[node]:
                    self.popped[node] = cost[node]
                    continue
                at, taken = self.fail[parent], self.popped[parent]
                while ch not in self.child[at]:
                    at, taken = self.fail[at], taken + self.popped[at]
                self.fail[node], self.popped[node] = self.child[at][ch], taken

    def _step(self, node: int, ch: str, cost: list[int]) -> int:
        there = self.child[node].setdefault(ch, len(cost))
        if there == len(cost):
            self.child.append({})
            cost.append(0)
        return there

    def count(self, word: str) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = tokens = 0
        for ch in MARK + word:
            there = child[node].get(ch)
            while there is None and node:
                tokens += popped[node]
                node = fail[node]
                there = child[node].get(ch)
            if there is None:
                tokens += len(ch.encode("utf-8", "surrogatepass"))
                there = 0
            node = there
        while node:
            tokens += popped[node]
            node = fail[node]
        return tokens


_built: dict[int, tuple[Automaton, dict[str, int]]] = {}


def _worker(names: list[str]) -> tuple[Automaton, dict[str, int]]:
    key = hash(tuple(names))
    if key not in _built:
        _built.clear()
        _built[key] = (Automaton(names), {})
    return _built[key]


def _counter(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _worker(names)
        for batch in slices(batches):
            words_out, tokens_out = [], []
            for text in batch.column("text").to_pylist():
                words = WORD_RE.findall(text or "")
                counts = list(map(known.get, words))
                if None in counts:
                    if len(known) > REMEMBERED:
                        known.clear()
                    for i, n in enumerate(counts):
                        if n is None:
                            word = words[i]
                            n = known.get(word)
                            if n is None:
                                n = automaton.count(word)
                                if len(word) <= 64:
                                    known[word] = n
                            counts[i] = n
                words_out.append(len(words))
                tokens_out.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words_out, pa.int64()), pa.array(tokens_out, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every row; the vocabulary is that of the piece model."""
    names = [name for name, _ in pieces(model or default_piece_model())]
    return docs.select("doc_id", "text").mapInArrow(_counter(names), "doc_id long, n_words long, n_tokens long")
