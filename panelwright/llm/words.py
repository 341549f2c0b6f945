"""Words of texts as rows of a per-worker table, so that what depends on a word alone is computed once a word."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A word: a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a uint64 over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordTable(dict):
    """Maps a word to its row; `columns` hold what `describe` computes for new words, in blocks.

    The table belongs to one worker. `trim()` forgets it when it holds more than `cap` words, which bounds memory
    and changes no result.
    """

    def __init__(self, describe: Callable[[list], np.ndarray], cap: int = 200_000) -> None:
        super().__init__()
        self.describe, self.cap, self.new, self.rows, self.used = describe, cap, [], None, 0

    def __missing__(self, word) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def at(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))

    def filled(self) -> np.ndarray:
        """The described rows, with those of new words added."""
        if self.new:
            block = self.describe(self.new)
            need = self.used + len(block)
            if self.rows is None:
                self.rows = np.empty((max(1024, need), *block.shape[1:]), block.dtype)
            elif need > len(self.rows):
                grown = np.empty((2 * need, *block.shape[1:]), block.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : need] = block
            self.used, self.new = need, []
        return self.rows if self.rows is not None else self.describe([])

    def trim(self) -> None:
        if len(self) > self.cap:
            self.clear()
            self.new, self.used = [], 0


def code_points(words: list[str], most_cells: int = 1 << 20):
    """Yield (positions, matrix of code points padded by 0 and framed by 2 and 3) by classes of word length, in bounded blocks."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = 6
    done = 0
    while done < len(words):
        low, width = (0 if width == 6 else width), width * 2
        if width > 1 << 12:
            for i in np.flatnonzero(lengths > low):  # a very long word by itself
                row = np.frombuffer(("\x02" + words[i] + "\x03").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                yield np.array([i]), row[None, :].astype(np.uint64)
            return
        at = np.flatnonzero((lengths > low) & (lengths <= width) if low else lengths <= width)
        done += len(at)
        step = max(1, most_cells // (width + 2))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            framed = np.array(["\x02" + words[i] + "\x03" for i in part], dtype=f"U{width + 2}")
            yield part, framed.view(np.uint32).reshape(len(part), width + 2).astype(np.uint64)


def gram_hashes(points: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row of code_points(), and where they exist."""
    if points.shape[1] < n:
        return np.zeros((len(points), 0), np.uint64), np.zeros((len(points), 0), bool)
    width = points.shape[1] - n + 1
    h = np.full((len(points), width), salt * 0x9E3779B9 + n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ points[:, k : k + width]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return mix(h), points[:, n - 1 :] != 0


def word_hashes(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), salt * 0x9E3779B9 + 77, dtype=np.uint64)
    for k in range(points.shape[1]):
        h = np.where(points[:, k] != 0, mix((h ^ points[:, k]) * np.uint64(0x100000001B3)), h)
    return mix(h)
