"""Exact tokenization of whole texts by units between stable spaces, each encoded once a worker.

A space (U+0020) between two characters that aren't white space is a stable boundary of both vocabularies' splitting
rules: no rule's match can hold it in its interior, look past it to the left, or depend on what stands before it; no
special token holds a space; and no normal form joins a character to a space. So the ids of a text are the ids of its
units in order, and a unit is encoded by the library the first time a worker meets it. Under the byte-level rule a line
feed, or a pair of them, between two characters that aren't white space is split from both sides as well, so there a
line's first word is a unit with its line feed. Texts with other white space, or with a special token's string, are
encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units that a worker keeps; bytes of texts that it encodes at a time.
CAP, SLICE = 500_000, 8 << 20


def library(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


def _refuse_unless(name: str, tokenizer, normalizer: list[str], splitter: list[str], pattern: str | None) -> None:
    """Units are proven for one splitting rule each; another vocabulary with the same rule will do, any other will not."""
    spec = json.loads(tokenizer.to_str())
    kinds = lambda part, inner: [] if part is None else [p["type"] for p in part[inner]] if part["type"] == "Sequence" else [part["type"]]
    before = spec["pre_tokenizer"] or {}
    found = next((p["pattern"].get("Regex") for p in before.get("pretokenizers", []) if p["type"] == "Split"), None)
    byte_level = next((p for p in before.get("pretokenizers", [before]) if p.get("type") == "ByteLevel"), {})
    same = spec["model"]["type"] == "BPE" and kinds(spec["normalizer"], "normalizers") == normalizer and kinds(spec["pre_tokenizer"], "pretokenizers") == splitter
    if not same or found != pattern or byte_level.get("add_prefix_space") or byte_level.get("use_regex") is not (pattern is None) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
        raise ValueError(f"{name}: units between spaces aren't proven stable for this vocabulary's splitting rule")


def _units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of texts without nulls, the place of each unit in them, and where each text's units begin (and end)."""
    lists = pc.split_pattern(texts, " ")
    found = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


#: Marks that may close a word, and the code point after the Latin letters that count as plain.
_MARKS, _LATIN_END = ".,!?;:|%$*#&", "\u0250"


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {i: chr(i if i in plain else next(others)) for i in range(256)}


class _Table(dict):
    """Units to rows, and rows to ids.

    A string stands after a space, or begins with its own line feed; bytes stand after neither. Letters, closing marks
    and a leading line feed are rows of their own, which those of the whole unit are put together from.
    """

    def __init__(self, tokenizer, dtype: np.dtype, cap: int) -> None:
        super().__init__()
        self.tokenizer, self.dtype, self.cap = tokenizer, dtype, cap
        self.characters = _byte_characters()
        self.forget()

    def __missing__(self, unit: str | bytes) -> int:
        self[unit] = at = len(self)
        self.new.append(unit)
        return at

    def forget(self) -> None:
        """Keep the units that more than one call met since the last time, or none if they are most of them."""
        units = list(self)
        rows = np.flatnonzero(self.met[: len(units)] > 1) if units else np.zeros(0, np.int64)
        if 2 * len(rows) > self.cap:
            rows = rows[:0]
        self.clear()
        self.update(zip([units[i] for i in rows.tolist()], range(len(rows)), strict=True))
        self.new: list[str | bytes] = []
        if len(rows):
            starts, lengths = self.starts[rows], self.lengths[rows]
            self.flat = self.flat[_spans(starts, lengths)]
            self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        else:
            self.flat, self.lengths, self.starts = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(len(rows), np.int32)

    def _learn(self) -> None:
        base = len(self) - len(self.new)
        tokenize = self.tokenizer.model.tokenize
        simple, lists, odd, whole, parts = [], [], [], [], []
        for at, unit in enumerate(self.new, base):  # which grows by parts
            bare = type(unit) is bytes
            body = unit.decode() if bare else unit
            feed = not bare and body[:1] == "\n"
            if feed:
                body = body[1:]
            word = body.rstrip(_MARKS)
            letters = word.isalpha() and (word.isascii() or max(word) < _LATIN_END)
            if letters and len(word) == len(body) and not feed:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
                simple.append(at)
                lists.append([t.id for t in tokenize(spelled if bare else "Ġ" + spelled)])
            elif letters or feed:
                own = [self[b"\n"]] if feed else []
                if letters:
                    own.append(self[word.encode() if bare or feed else word])
                    body = body[len(word) :]
                if body:
                    own.append(self[body.encode()])
                whole.append(at)
                parts.append(own + [-1] * (3 - len(own)))
            else:
                odd.append((at, body if bare else " " + body))
        if odd:
            simple += [at for at, _ in odd]
            lists += [e.ids for e in self.tokenizer.encode_batch_fast([text for _, text in odd], add_special_tokens=False)]
        room = np.zeros(len(self) - base, np.int64)
        self.starts, self.lengths, self.met = np.append(self.starts, room), np.append(self.lengths, room), np.append(self.met, room.astype(np.int32))
        self._store(np.array(simple, np.int64), np.fromiter(chain.from_iterable(lists), self.dtype), np.fromiter(map(len, lists), np.int64, len(lists)))
        if whole:
            made = np.array(parts)
            held = made >= 0
            lengths = np.where(held, self.lengths[made], 0)
            self._store(np.array(whole), self.flat[_spans(self.starts[made[held]], lengths[held])], lengths.sum(1))
        self.new = []

    def _store(self, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts[at], self.lengths[at] = len(self.flat) + np.cumsum(lengths) - lengths, lengths
        self.flat = np.append(self.flat, ids)

    def at(self, units: list[str]) -> np.ndarray:
        """The rows of distinct units."""
        if len(self) > self.cap:
            self.forget()
        rows = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        if self.new:
            self._learn()
        self.met[rows] += 1
        return rows


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of spans, end to end."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


#: White space other than spaces and line feeds: Unicode's, which the library's splitting rule goes by, and the separators
#: U+001C to U+001F; runs of white space other than a pair of line feeds.
_RARE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = ("  ", " \n", "\n ", "\n\n\n")


class ByteEncoder:
    """Ids of whole texts under a byte-level vocabulary whose splitting rule gives a space to the word after it."""

    def __init__(self, name: str, cap: int = CAP, end_id: int = 0) -> None:
        self.tokenizer, self.end_id = library(name), end_id
        _refuse_unless(name, self.tokenizer, [], ["ByteLevel"], None)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 and end_id < 1 << 16 else "<u4")
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = _Table(self.tokenizer, self.dtype, cap)

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with the end id, and how many each has. A null text is empty."""
        texts = pc.fill_null(texts, "")
        wide = pc.match_substring_regex(texts, _RARE)
        for run in (*_RUNS, *self.special):
            wide = pc.or_(wide, pc.match_substring(texts, run))
        for end in " \n":
            wide = pc.or_(wide, pc.or_(pc.starts_with(texts, end), pc.ends_with(texts, end)))
        # every text gets a line feed in front, so that no first unit is special; its id's place shifts to the end id
        plain = pc.replace_substring(pc.binary_join_element_wise("\n", texts.filter(pc.invert(wide)), ""), "\n", " \n")
        units, at, offsets = _units(pc.utf8_slice_codeunits(plain, 1))
        rows = self.table.at(units)[at]
        n = self.table.lengths[rows]
        flat = self.table.flat[_spans(self.table.starts[rows], n)]
        ends = np.append(0, np.cumsum(n))[offsets]
        lengths = np.diff(ends)
        flat = np.append(flat[1:], flat[:1])
        flat[ends[1:] - 1] = self.end_id
        if not (slow := np.flatnonzero(wide.to_numpy(zero_copy_only=False))).size:
            return flat, lengths
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(slow)).to_pylist(), add_special_tokens=False)]
        order = np.argsort(np.append(np.setdiff1d(np.arange(len(texts)), slow), slow), kind="stable")
        flat = np.append(flat, np.fromiter(chain.from_iterable(chain(ids, (self.end_id,)) for ids in lists), self.dtype))
        lengths = np.append(lengths, [len(ids) + 1 for ids in lists])
        return flat[_spans((np.cumsum(lengths) - lengths)[order], lengths[order])], lengths[order]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        flat, lengths = self.stream(pa.array(texts, pa.string()))
        return [flat[b - n : b - 1] for n, b in zip(lengths.tolist(), np.cumsum(lengths).tolist(), strict=True)]


#: The splitting rule that UnitCounter is proven for (a fixed value of the public vocabulary).
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run of Latin letters with closing marks that this rule splits from it.
_LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|%$*#&]*)")


class UnitCounter:
    """Numbers of tokens of whole texts under a vocabulary that drops white space and lowers case."""

    def __init__(self, name: str, cap: int = CAP) -> None:
        self.tokenizer, self.cap = library(name), cap
        _refuse_unless(name, self.tokenizer, ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], _WORD_SPLIT)
        self.known: dict[str, int] = {}

    def _learn(self, units: list[str]) -> None:
        known, plain, split = self.known, [], []
        for unit in units:
            if (m := _LETTERS_MARKS.fullmatch(unit)) and m[2]:
                split.append((unit, m[1], m[2]))
            else:
                plain.append(unit)
        plain += {part for _, *both in split for part in both}.difference(known, plain)
        known.update(zip(plain, map(len, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)), strict=True))
        for unit, stem, mark in split:
            known[unit] = known[stem] + known[mark]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text. A null text is empty."""
        units, at, offsets = _units(pc.fill_null(texts, ""))
        if len(self.known) > self.cap:
            self.known.clear()
        found = list(map(self.known.get, units))
        if None in found:
            self._learn([u for u, n in zip(units, found, strict=True) if n is None])
            found = list(map(self.known.get, units))
        return np.diff(np.append(0, np.cumsum(np.array(found, np.int64)[at]))[offsets])



_KEPT: dict[tuple, object] = {}


def kept(kind, *args):
    """One encoder a worker and vocabulary, kept between tasks; another one takes its place, so a worker holds one cache."""
    if (kind, *args) not in _KEPT:
        _KEPT.clear()
        _KEPT[(kind, *args)] = kind(*args)
    return _KEPT[(kind, *args)]
