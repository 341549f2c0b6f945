"""Packed paragraphs: bounded, in order, nothing lost, and no chunk that could have held the next unit."""

from __future__ import annotations

import random

import pytest

from panelwright.operators.chunks import packed, packed_paragraphs


def test_fixtures():
    p, q = "a" * 40, "b" * 30
    assert packed(f"{p}\r\n\r\n{q}\n\n\n{q}", 72) == [f"{p}\n\n{q}", q]
    assert packed(f"one\ntwo  three\n \n{p}", 64) == [f"one two three\n\n{p}"]
    long = "First sentence of it all. " + "word " * 20 + "end. Last one!"
    assert packed(long, 64) == ["First sentence of it all.", ("word " * 13).strip(), "word " * 7 + "end.\n\nLast one!"]
    assert packed("x " + "y" * 150 + " z", 64) == ["x", "y" * 64, "y" * 64, "y" * 22 + "\n\nz"]
    assert packed("", 64) == packed(" \n\n\t", 64) == []


def test_random_texts_are_whole_and_tight():
    rng = random.Random(4)
    for _ in range(200):
        words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 4, 9, 30, 90]))) + rng.choice(["", "", ".", "?"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", "\n", "\n\n", "\r\n \r\n"]) for w in words)
        chunks = packed(text, 64)
        assert all(0 < len(c) <= 64 for c in chunks)
        assert "".join("".join(chunks).split()) == "".join(text.split())
        for a, b in zip(chunks, chunks[1:], strict=False):
            assert len(a) + 2 + len(b.split("\n\n")[0]) > 64


def test_table(spark):
    docs = spark.createDataFrame([(1, "a\n\nb", 9), (1, "a\n\nb", 9), (None, "c", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, chunk int")
    assert sorted((str(r.doc_id), r.chunk, r.text) for r in packed_paragraphs(docs, 64).collect()) == [("1", 0, "a\n\nb"), ("1", 0, "a\n\nb"), ("None", 0, "c")]
    assert not packed_paragraphs(docs.limit(0), 64).collect()
    with pytest.raises(ValueError):
        packed_paragraphs(docs, 63)
