"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised at stable common boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .runtime import slices, tidied
from .units import SLICE, UnitCounter, kept

#: Characters of a chunk of a huge text, and of the overlap of two chunks at first.
CHUNK, OVERLAP = 1 << 15, 1 << 9

#: A space between two characters that aren't white space: proven stable (see units.py).
_STABLE = re.compile(r"(?<=\S) (?=\S)")


def _common(left: list, left_starts: list, right: list, right_starts: list, place: int) -> bool:
    """Whether both chunks have a token boundary at the space `place`, with the same tokens before and after it."""
    i, j = bisect_left(left_starts, place), bisect_left(right_starts, place)
    if not (0 < i < len(left) and 0 < j < len(right)) or left[i - 1 : i + 1] != right[j - 1 : j + 1]:
        return False
    return left[i - 1][1] <= place <= left[i][0] <= place + 1


def spliced_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of `text`, from overlapping chunks encoded with offsets.

    Two neighbouring chunks are spliced at a stable space inside their overlap where both, encoded, have a token boundary
    between the same two tokens: tokens that begin before it come from the left chunk, the others from the right one.
    Where they don't agree, the overlap is widened, twice as far each time; where all of the left chunk is no help, that
    is widened too, at last to the text's end, so that nothing is cut at a doubtful place.
    """

    def encoded(a: int, b: int) -> list[tuple[int, int]]:
        return [(x + a, y + a) for x, y in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    total, start, cut = 0, 0, 0  # tokens that begin before `cut` are counted; `start` is where the left chunk begins
    end = min(len(text), chunk)
    left = encoded(start, end)
    while end < len(text):
        starts, reach, place = [a for a, _ in left], overlap, None
        while place is None:
            low = max(cut + 1, end - reach)
            # the right chunk begins at a stable space before the overlap, so that both chunks cover its surroundings
            back = [m.start() for m in _STABLE.finditer(text, max(start + 1, low - reach), low)]
            begin = back[len(back) // 2] if back else low
            until = min(len(text), max(begin + chunk, end + overlap))
            right = encoded(begin, until)
            right_starts = [a for a, _ in right]
            place = next((m.start() for m in _STABLE.finditer(text, low, end - 1) if _common(left, starts, right, right_starts, m.start())), None)
            if place is None and low == cut + 1:
                break
            reach *= 2
        if place is None:
            end = min(len(text), start + 2 * (end - start))
            left = encoded(start, end)
            continue
        total += sum(cut <= a < place for a, _ in left)
        start, cut, end, left = begin, place, until, right
    return total + sum(b > a and a >= cut or a == b and a > cut for a, b in left) if cut else len(left)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `docs` (doc_id, text; other columns are ignored).

    Counts are those of the library for the whole text, special strings in it handled as by default. Texts of at most
    `chunk` characters are counted whole, from units that a worker encodes once; longer ones by overlapping chunks, see
    spliced_count(). A null or empty text counts as 0 bytes and tokens; a null doc_id stays null; repeated rows are
    answered each; an empty table gives no rows. No shuffle: one pass, memory bounded by a slice of rows and one text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(UnitCounter, vocabulary)
        for part in slices(batches, "text", SLICE):
            texts = pc.fill_null(part.column("text"), "")
            huge = pc.greater(pc.utf8_length(texts), chunk)
            counts = counter.counts(pc.if_else(huge, "", texts))
            for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)).tolist():
                counts[i] = spliced_count(counter.tokenizer, texts[i].as_py(), chunk, overlap)
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(part.column("text")), pa.int64()), 0)
            n_tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, n_tokens, pc.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(tidied(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
