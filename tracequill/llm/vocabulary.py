"""The fixed public piece table and its trie, for operators that segment words."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

MARK = "▁"


def default_piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def pieces(path: str | os.PathLike) -> tuple[tuple[str, float], ...]:
    """(piece, score) of every normal piece in order of its id; the empty string for others.

    Control, unknown and byte pieces take no part in matching, nor do runs of marks, which
    have no score of their own.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=str(path))
    found = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        other = model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or (len(name) > 1 and not name.strip(MARK))
        found.append(("", 0.0) if other else (name, model.get_score(i)))
    return tuple(found)


class Trie:
    """The pieces as a trie whose children are found for whole arrays at once."""

    def __init__(self, names: list[str]) -> None:
        classes: dict[str, int] = {}
        children: dict[tuple[int, int], int] = {}
        ends = [-1]
        for piece, name in enumerate(names):
            node = 0
            for ch in name:
                c = classes.setdefault(ch, len(classes) + 1)
                node = children.setdefault((node, c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            if name:
                ends[node] = piece
        self.width = len(classes) + 1
        self.longest = max(map(len, names), default=1)
        top = max(map(ord, classes), default=0) + 2
        self._class = np.zeros(top, np.int64)
        for ch, c in classes.items():
            self._class[ord(ch)] = c
        keys = np.array([n * self.width + c for n, c in children], np.int64)
        order = np.argsort(keys)
        self._keys, self._child = keys[order], np.array(list(children.values()), np.int64)[order]
        self._ends = np.array(ends, np.int64)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """The class of each code point; 0 for those in no piece."""
        return self._class[np.minimum(codes, len(self._class) - 1)]

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and lengths: ids[k - 1, i, s] is the piece of k characters at s of word i, or -1."""
        lengths = np.array([len(w) for w in words], np.int64)
        most = int(lengths.max(initial=1))
        codes = np.frombuffer("".join(w.ljust(most, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), most)
        cls = self.classes(codes)
        cls[np.arange(most)[None, :] >= lengths[:, None]] = 0
        ids = np.full((min(self.longest, most), len(words), most), -1, np.int32)
        row, start = np.nonzero(cls)
        node = np.zeros(len(row), np.int64)
        for k in range(len(ids)):
            c = cls[row, np.minimum(start + k, most - 1)]
            live = (c > 0) & (start + k < most)
            row, start, key = row[live], start[live], node[live] * self.width + c[live]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            live = self._keys[at] == key
            row, start, node = row[live], start[live], self._child[at[live]]
            if not len(row):
                break
            ids[k, row, start] = self._ends[node]
        return ids, lengths
