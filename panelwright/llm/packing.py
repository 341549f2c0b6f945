"""Best-fit packing of token sequences, improved by a swap-based local search."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import slices, tidied, written
from .units import CAP, SLICE, ByteEncoder, kept

#: Pieces that one task packs; more are dealt to more tasks. At most about one sequence a group is lost to that.
GROUP = 60_000


class Bins:
    """Bins of pieces by length. Free places are indexed by a bit mask, so the best fit is one bit scan.

    `reach` indexes each piece of an underfull bin by its length and the bin's free places together: the most that can
    stand in the piece's stead.
    """

    def __init__(self, size: int) -> None:
        self.size, self.held, self.free = size, [], []
        self.by_free, self.mask = defaultdict(set), 0
        self.reach, self.reach_mask = defaultdict(set), 0

    def _index(self, k: int) -> None:
        f = self.free[k]
        self.by_free[f].add(k)
        self.mask |= 1 << f

    def _unindex(self, k: int) -> None:
        f = self.free[k]
        self.by_free[f].discard(k)
        if not self.by_free[f]:
            self.mask &= ~(1 << f)

    def _index_pieces(self, k: int) -> None:
        if f := self.free[k]:
            for x in self.held[k]:
                self.reach[x + f].add((k, x))
                self.reach_mask |= 1 << x + f

    def _unindex_pieces(self, k: int) -> None:
        if f := self.free[k]:
            for x in self.held[k]:
                self.reach[x + f].discard((k, x))
                if not self.reach[x + f]:
                    self.reach_mask &= ~(1 << x + f)

    def best(self, length: int) -> int | None:
        """A bin of the least free room that holds `length`."""
        if high := self.mask >> length:
            return min(self.by_free[length + (high & -high).bit_length() - 1])
        return None

    def partner(self, length: int, most_free: int, but: int) -> tuple[int, int] | None:
        """A bin and a piece of it, shorter than `length`, which `length` can replace with the least room left over."""
        high, at = self.reach_mask >> length, length
        while high:
            step = (high & -high).bit_length() - 1
            at, high = at + step, high >> step + 1
            if fits := [(k, x) for k, x in self.reach[at] if x < length and k != but and self.free[k] <= most_free]:
                return min(fits)
            at += 1
        return None

    def add(self, length: int) -> None:
        k = self.best(length)
        if k is None:
            self.held.append([])
            self.free.append(self.size)
            k = len(self.held) - 1
        else:
            self._unindex(k)
        self.held[k].append(length)
        self.free[k] -= length
        self._index(k)

    def change(self, k: int, out: tuple[int, ...], into: tuple[int, ...]) -> None:
        self._unindex(k)
        self._unindex_pieces(k)
        for x in out:
            self.held[k].remove(x)
        self.held[k] += into
        self.free[k] += sum(out) - sum(into)
        self._index(k)
        self._index_pieces(k)


def _step(bins: Bins, d: int) -> bool:
    """Move a piece, or exchange one or two pieces, of bin `d` for a shorter one of a bin at least as full; whether it was done."""
    held, free = sorted(bins.held[d], reverse=True), bins.free[d]
    for a in held:
        bins._unindex(d)
        k = bins.best(a)
        bins._index(d)
        if k is not None and bins.held[k] and bins.free[k] - a < free:
            bins.change(d, (a,), ())
            bins.change(k, (), (a,))
            return True
    for out in dict.fromkeys([(a,) for a in held] + [(held[i], held[j]) for i in range(len(held)) for j in range(i + 1, len(held))]):
        if sum(out) <= bins.size and (found := bins.partner(sum(out), free, d)):
            k, x = found
            bins.change(d, out, (x,))
            bins.change(k, (x,), out)
            return True
    return False


def local_search(bins: Bins) -> None:
    """Empty underfull bins: move pieces out of them, or exchange one or two for one, where squared fill grows.

    Every underfull bin is a donor, the emptiest first: a piece is moved to the bin that it fits best; else one piece, or
    two together, are exchanged for a shorter piece of a bin at least as full, which so gains what the donor loses. Each
    step increases the sum of squared fills, so the search ends: when a pass over all underfull bins changes nothing.
    """
    for k in range(len(bins.held)):
        bins._index_pieces(k)
    improved = True
    while improved:
        improved = False
        for d in sorted((k for k in range(len(bins.held)) if bins.held[k] and bins.free[k]), key=lambda k: -bins.free[k]):
            while bins.held[d] and bins.free[d] and _step(bins, d):
                improved = True


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece (all of 1..size): full ones alone, the others best-fit decreasing, then local search."""
    bin_of, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths >= size)
    bin_of[full] = np.arange(len(full))
    rest = np.flatnonzero(lengths < size)
    rest = rest[np.argsort(-lengths[rest], kind="stable")]
    bins = Bins(size)
    for n in lengths[rest].tolist():
        bins.add(n)
    local_search(bins)
    waiting = defaultdict(list)  # equal lengths are interchangeable
    for i in reversed(rest.tolist()):
        waiting[int(lengths[i])].append(i)
    at = len(full)
    for held in bins.held:
        if held:
            place = 0
            for n in held:
                i = waiting[n].pop()
                bin_of[i], offset[i] = at, place
                place += n
            at += 1
    return bin_of, offset


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, cap: int = CAP, most_bytes: int = SLICE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and the end id, cut only if over `size`.

    A worker keeps `cap` units and encodes `most_bytes` of texts at a time.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(ByteEncoder, vocabulary, cap, end_id)
        for part in slices(batches, "text", most_bytes):
            flat, lengths = encoder.stream(part.column("text"))
            n_pieces = -(-lengths // size)
            doc = np.repeat(np.arange(len(lengths)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = (lengths - (n_pieces - 1) * size)[doc]
            length = np.where(piece == 0, first, size)
            start = np.where(piece == 0, 0, first + (piece - 1) * size)
            ends = np.cumsum(length)
            wide = flat.astype("<u4")
            raw = memoryview(wide).cast("B") if len(wide) else b""
            crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), length.tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(doc)), *(pa.array(c, t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crcs, pa.int64())))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(wide.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(tidied(cut), schema)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, group: int = GROUP, with_ids: bool = False, cap: int = CAP, most_bytes: int = SLICE) -> DataFrame:
    """Pack every document into sequences of at most `size` tokens; per piece its sequence_id and offset there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). A null text is empty: its end id is
    packed. A null doc_id stays null; rows of equal doc_id are packed each; an empty table gives no rows; other columns
    are ignored. Pieces are written to the shared folder, dealt evenly to groups of about `group` pieces by a hash of
    document and piece (so a huge document is spread over groups) and packed group by group. Each group ends with at
    most a few bins that aren't full, which is what dealing costs: under 1 in 1,000 sequences at the default.
    """
    cut = written(pieces(docs, vocabulary, size, end_id, with_ids, cap, most_bytes), "pieces")
    n_groups = max(1, -(-cut.count() // group))
    keyed = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bin_of, offset = pack_lengths(rows["length"].to_numpy(np.int64), size)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bin_of, offset=offset).drop(columns="pack_group")

    return keyed.groupBy("pack_group").applyInPandas(place, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in cut.schema] + ["sequence_id long", "offset long"]))
