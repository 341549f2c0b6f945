"""Chunks of whole paragraphs: packed up to a size, oversized ones cut by sentences, words, and only then within a word."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

_BLANK_LINES = re.compile(r"\n\s*\n+")
_AFTER_SENTENCE = re.compile(r"(?<=[.!?]) ")


def filled(parts: Iterable[str], glue: str, most: int) -> Iterator[str]:
    """Parts of at most `most` characters, joined in order for as long as they fit."""
    held, size = [], 0
    for part in parts:
        if held and size + len(glue) + len(part) > most:
            yield glue.join(held)
            held, size = [], 0
        size += len(part) + (len(glue) if held else 0)
        held.append(part)
    if held:
        yield glue.join(held)


def _units(text: str, most: int) -> Iterator[str]:
    for paragraph in _BLANK_LINES.split(text.replace("\r\n", "\n").replace("\r", "\n").strip()):
        whole = " ".join(paragraph.split())
        for sentence in [whole] if len(whole) <= most else _AFTER_SENTENCE.split(whole):
            if len(sentence) <= most:
                yield from [sentence] if sentence else []
                continue
            for giant, words in groupby(sentence.split(" "), lambda w: len(w) > most):
                yield from (w[k : k + most] for w in words for k in range(0, len(w), most)) if giant else filled(words, " ", most)


def packed(text: str, most: int) -> list[str]:
    """Chunks of at most `most` characters; units in one chunk stand a blank line apart."""
    return list(filled(_units(text, most), "\n\n", most))


def packed_paragraphs(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, chunk (from 0), text for every row of `docs` (doc_id, text); a null or blank text has no chunks.

    One pass without a shuffle; a batch's chunks are at most as long as its texts.
    """
    if most < 64:
        raise ValueError("a chunk needs room for 64 characters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, c) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, c in enumerate(packed(t or "", most))]
            ids, places, chunks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(chunks, pa.string())], ["doc_id", "chunk", "text"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, chunk long, text string")
