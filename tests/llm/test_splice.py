"""Chunks are spliced only where both sides agree; where no boundary is common, they are widened."""

from __future__ import annotations

import random
import re
from types import SimpleNamespace

import pytest

from panelwright.llm.token_count import spliced_count


class Grouped:
    """Tokens of `n` words counted from where the encoded text begins: two chunks agree only if they begin in step."""

    def __init__(self, n: int) -> None:
        self.n = n

    def encode(self, text: str, add_special_tokens: bool = True):
        words = [m.span() for m in re.finditer(r"\s*\S+|\s+$", text)]
        return SimpleNamespace(offsets=[(words[i][0], words[min(i + self.n, len(words)) - 1][1]) for i in range(0, len(words), self.n)])


class Shifting:
    """Tokens of one character whose offsets no other chunk shares: the length of the encoded text decides."""

    def encode(self, text: str, add_special_tokens: bool = True):
        first = 1 + len(text) % 7
        return SimpleNamespace(offsets=[(0, first)] + [(i, min(i + 7, len(text))) for i in range(first, len(text), 7)])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_disagreeing_chunks_are_widened(n):
    rng = random.Random(n)
    for _ in range(40):
        text = " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(50, 400)))
        assert spliced_count(Grouped(n), text, 200, 40) == len(Grouped(n).encode(text).offsets)


def test_no_stable_space_at_all():
    for text in ("x" * 5000, "x  y" * 900, "a\nb" * 900):
        assert spliced_count(Shifting(), text, 256, 32) == len(Shifting().encode(text).offsets)
