"""SentencePiece BPE encoding and decoding by suffix-array matching and relaxation of piece edges.

The batch's units (a run of spaces and what follows it, up to the next) are laid end to end and indexed by a suffix
array; a binary search for every piece of the vocabulary gives the ranges where it occurs, hence all edges; edges are
sorted by where they end and relaxed in that order. A path to a place ends in exactly one piece under BPE: an edge
extends the path at its start if greedy merging keeps its piece and the path's last piece apart. That is decided by
undoing the two pieces' merges, latest first, and looking for an earlier merge across their border.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import slices, tidied

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Bits of a place in the sieve that most questions for a merge of two pieces end at.
SIEVE = 21


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)


@dataclass
class Vocabulary:
    """Pieces that merging can make, with their merge ranks, last merges, and the ranks of merges of two pieces."""

    text: list[str]
    raw: list[bytes]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_key: np.ndarray
    pair_rank: np.ndarray
    byte_ids: np.ndarray
    usable: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << SIEVE, bool)  # false where no key of a pair falls
        self.sieve[_slot(self.pair_key)] = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import os

        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path if os.sep in path else public_tokenizers.path(path))
        n = model.vocab_size()
        text = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        ids = {text[i]: i for i in range(n) if plain[i]}
        order = {s: k for k, s in enumerate(sorted({-model.get_score(i) for i in range(n)}))}
        rank = np.array([order[-model.get_score(i)] for i in range(n)], np.int64)
        left, right, usable = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = int(rank[i])
            if len(piece) == 1:
                usable[i] = True
            elif (made := cls._merged(piece, ids, rank)) is not None:
                usable[i], left[i], right[i] = True, *made
        keys = np.array(sorted(pairs), np.int64)
        byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(text[i][1:-1], 16)] = i
        raw = [bytes([int(t[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else t.encode() for i, t in enumerate(text)]
        made = cls(text, raw, rank, left, right, keys, np.array([pairs[k] for k in keys], np.int64), byte_ids, usable)
        rng = np.random.default_rng(1)
        words = [t.replace(SPACE, " ") for i, t in enumerate(text) if plain[i]]
        probes = ["", " ", "  a", "Ａ\u00a0é e\u0301 ﬁ\t\n x ", "日本\U0001f600", *("".join(rng.choice(words, 8)) for _ in range(200))] if words else [""]
        if (byte_ids < 0).any() or [x.tolist() for x in Codec(made).encode(probes)] != model.encode(probes):
            raise ValueError(f"{path}: not a BPE model with byte pieces that leaves texts as they are")
        return made

    @staticmethod
    def _merged(piece: str, ids: dict[str, int], rank: np.ndarray) -> tuple[int, int] | None:
        """The two pieces of the last merge that makes `piece` from its characters, or None if merging ends elsewhere."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(((rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids), default=None)
            if best is None:
                return None
            k = best[1]
            if len(parts) == 2:
                return ids[parts[0]], ids[parts[1]]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a with b, or a number above all ranks."""
        key = a * (len(self.text) + 1) + b
        out = np.full(len(key), np.iinfo(np.int64).max)
        may = np.flatnonzero(self.sieve[_slot(key)])
        at = np.minimum(np.searchsorted(self.pair_key, key[may]), len(self.pair_key) - 1)
        real = self.pair_key[at] == key[may]
        out[may[real]] = self.pair_rank[at[real]]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a and b, side by side, as they are. Equal to len(text) is a character without a piece."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        strange = (a >= len(self.text)) | (b >= len(self.text))
        at, a, b, limit = at[~strange], a[~strange].copy(), b[~strange].copy(), limit[~strange]
        while len(at):
            crossed = self.merge_ranks(a, b) < limit
            out[at[crossed]] = False
            whole_a, whole_b = self.left[a] < 0, self.left[b] < 0
            on = ~crossed & ~(whole_a & whole_b)
            at, a, b, limit, whole_a, whole_b = at[on], a[on], b[on], limit[on], whole_a[on], whole_b[on]
            # undo the later of the two last merges; of equal ranks the right one came later
            undo_a = ~whole_a & (whole_b | (self.rank[a] > self.rank[b]))
            limit = np.where(undo_a, self.rank[a], self.rank[b] + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of `codes` ordered by their next `depth` codes: as many as fit into an integer at once, then by prefix doubling."""
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    rank = np.cumsum(seen)[codes]  # from 1; 0 is what lies beyond the end
    bits = int(seen.sum()).bit_length()
    width = min(depth, 62 // bits)
    key = rank.copy()
    for k in range(1, width):
        key <<= bits
        key[: max(0, len(key) - k)] |= rank[k:]
    while width < depth:
        _, rank = np.unique(key, return_inverse=True)
        later = np.zeros(len(rank), np.int64)
        later[: max(0, len(rank) - width)] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + later
        width *= 2
    return np.argsort(key)


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece (a row of codes) the range of `order` whose suffixes begin with it, by binary search code by code."""
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order))
    padded = np.append(codes, np.zeros(pieces.shape[1] + 1, codes.dtype))
    for k in range(pieces.shape[1]):
        on = np.flatnonzero((lengths > k) & (low < high))
        if not len(on):
            break
        want = pieces[on, k]
        ends = []
        for after in (False, True):
            a, b = low[on].copy(), high[on].copy()
            while (a < b).any():
                mid = (a + b) // 2
                got = padded[order[np.minimum(mid, len(order) - 1)] + k]
                less = ((got <= want) if after else (got < want)) & (a < b)
                a, b = np.where(less, mid + 1, a), np.where(less | (a >= b), b, mid)
            ends.append(a)
        low[on], high[on] = ends
    return low, high


#: Characters of a unit from which it is cut where no piece can reach across.
LONG = 64


class Codec:
    """Encodes and decodes whole texts; keeps the ids of units that this worker has met.

    A unit is a string, with a space mark before it; bytes are the rest of a long unit, cut between two characters that
    no piece holds side by side, so that no merge crosses the cut.
    """

    def __init__(self, vocabulary: Vocabulary, cap: int = 400_000) -> None:
        self.v, self.cap, self.known = vocabulary, cap, {}
        ids = np.flatnonzero(vocabulary.usable)
        ids = ids[np.argsort([len(vocabulary.text[i]) for i in ids], kind="stable")]
        self.ids, self.lengths = ids, np.array([len(vocabulary.text[i]) for i in ids])
        self.codes = np.zeros((len(ids), int(self.lengths.max())), np.uint32)
        for row, i in enumerate(ids):
            self.codes[row, : self.lengths[row]] = np.frombuffer(vocabulary.text[i].encode("utf-32-le"), np.uint32)
        side = (self.codes[:, :-1].astype(np.uint64) << np.uint64(32) | self.codes[:, 1:])[np.arange(self.codes.shape[1] - 1) < self.lengths[:, None] - 1]
        self.sides = np.unique(side)

    def cut(self, unit: str) -> list[str | bytes]:
        """A long unit's parts."""
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        free = np.flatnonzero(~np.isin(codes[:-1] << np.uint64(32) | codes[1:], self.sides)) + 1
        ends = [0, *free.tolist(), len(unit)]
        parts = [unit[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [parts[0], *(p.encode("utf-8", "surrogatepass") for p in parts[1:])]

    def learn(self, units: list[str | bytes]) -> None:
        """Ids of new units, in one suffix array."""
        texts = [SPACE + u if type(u) is str else u.decode("utf-8", "surrogatepass") for u in units]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        # code points end to end, each unit closed by 0; a zero character itself has no piece and breaks edges too
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        order = suffix_array(codes, self.codes.shape[1])
        low, high = occurrences(codes, order, self.codes, self.lengths)
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        begin = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        end, token = begin + self.lengths[piece], self.ids[piece]
        # characters without a piece make an edge of their own
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        lone = np.ones(len(codes), bool)
        lone[begin[self.lengths[piece] == 1]] = False
        lone[starts + sizes] = False
        extra = np.flatnonzero(lone)
        begin, end, token = np.concatenate([begin, extra]), np.concatenate([end, extra + 1]), np.concatenate([token, np.full(len(extra), len(self.v.text))])
        place = end - starts[owner[begin]]  # where an edge ends in its unit
        sort = np.argsort(place.astype(np.uint16) if int(sizes.max()) < 1 << 16 else place, kind="stable")
        begin, end, token, place = begin[sort], end[sort], token[sort], place[sort]
        bounds = np.searchsorted(place, np.arange(1, int(sizes.max()) + 2))
        last = np.full(len(codes) + 1, -1, np.int64)  # the path's last piece at a place; -2 where a unit starts
        back = np.zeros(len(codes) + 1, np.int64)
        last[starts] = -2
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            before = last[begin[a:b]]
            good = before == -2
            ask = np.flatnonzero(before >= 0)
            good[ask] = self.v.apart(before[ask], token[a:b][ask])
            at = a + np.flatnonzero(good)
            if len(at):
                last[end[at]], back[end[at]] = token[at], begin[at]
        at, on = starts + sizes, np.arange(len(texts))
        steps = []  # from the units' ends back
        while len(on):
            steps.append((on, last[at], at))
            at = back[at]
            more = at > starts[on]
            at, on = at[more], on[more]
        owner, token, end = (np.concatenate(c)[::-1] for c in zip(*steps, strict=True))
        owner, token = self._spelled(owner, token, codes[end - 1])
        dtype = self.dtype
        flat = token[np.argsort(owner, kind="stable")].astype(dtype).tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(texts))) * np.dtype(dtype).itemsize).tolist()
        self.known.update(zip(units, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _spelled(self, owner: np.ndarray, token: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece (tokens equal to the vocabulary's size) replaced by the byte pieces of their codes."""
        lone = np.flatnonzero(token == len(self.v.text))
        if not len(lone):
            return owner, token
        kinds, kind = np.unique(code[lone], return_inverse=True)
        spelled = [self.v.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in kinds.tolist()]
        table = np.array([np.pad(x, (0, 4 - len(x))) for x in spelled])
        times = np.ones(len(token), np.int64)
        times[lone] = np.array([len(x) for x in spelled])[kind]
        at = np.repeat(np.arange(len(token)), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        row = np.full(len(token), -1, np.int64)
        row[lone] = kind
        return owner[at], np.where(row[at] >= 0, table[row[at], nth], token[at])

    @property
    def dtype(self) -> type:
        return np.uint16 if len(self.v.text) <= 1 << 16 else np.uint32

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.cap:
            self.known.clear()
        lists = [self._units(t) for t in texts]
        new = set().union(*lists)
        if cuts := {u: self.cut(u) for u in new if len(u) > LONG}:
            lists = [units if cuts.keys().isdisjoint(units) else [part for u in units for part in cuts.get(u, (u,))] for units in lists]
            new = new.difference(cuts).union(*cuts.values())
        budget, part = 2 << 20, []
        size = 0
        for unit in sorted(new.difference(self.known), key=len):
            part.append(unit)
            size += len(unit) + 2
            if size > budget:
                self.learn(part)
                part, size = [], 0
        if part:
            self.learn(part)
        dtype = self.dtype
        return [np.frombuffer(b"".join(map(self.known.__getitem__, units)), dtype) for units in lists]

    @staticmethod
    def _units(text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and text[0] != " " and SPACE not in text:
            return text.split(" ")
        return [u[1:] for u in _UNITS.findall(SPACE + text.replace(" ", SPACE))]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[int, Codec] = {}


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian uint32 ids), decoded_equal for every row of `docs` (doc_id, text).

    Ids are those of the library without begin or end. decoded_equal tells whether decoding gives the text back, which
    it does unless the text holds the space mark itself or isn't valid Unicode. A null text is empty: no pieces, equal.
    Rows of null or repeated doc_id are answered each; other columns are ignored; an empty table gives no rows. One pass
    without a shuffle; the model's tables (of the vocabulary's size) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(shared.value)
        codec = _CODECS[key]
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = codec.encode(texts)
            columns = [[len(i) for i in ids], [zlib.crc32(i.astype("<u4").tobytes()) for i in ids], [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])], ["doc_id", "n_pieces", "ids_crc32", "decoded_equal"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(tidied(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_equal boolean")
