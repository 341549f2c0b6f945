"""Token operators against the libraries; packing against its invariants; shards by round trip and lookup."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import packing, sst, token_count
from panelwright.llm.pieces_codec import Codec, Vocabulary, round_trip
from panelwright.llm.units import ByteEncoder, UnitCounter, library

BYTES, WORDS, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
ALPHABET = list("aB\0 é'  \n\t  .,;19ñ字́ſİ▁") + ["<|endoftext|>", "'s", "word", "Word,", "  ", "<|startoftext|>", "don't", "x\n y", "    "]
SCHEMA = "doc_id long, text string, lang string, n_tokens string, start string"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    return ["", " ", "a", "a ", " a", "\n", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(1500)), "x" * 3000, "ab " * 2000]


@pytest.fixture(scope="module")
def docs(spark, odd):
    rows = [(i, t, None, None, "clash") for i, t in enumerate(odd)] + [(None, "no id", "en", "x", None), (len(odd), None, None, None, None), (0, "again", None, None, None), (-7, "minus", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_units_equal_the_library(odd):
    tok, count = library(BYTES), library(WORDS)
    assert [x.tolist() for x in ByteEncoder(BYTES, cap=100).ids(odd)] == [tok.encode(t, add_special_tokens=False).ids for t in odd]
    assert UnitCounter(WORDS, cap=100).counts(pa.array(odd)).tolist() == [len(count.encode(t, add_special_tokens=False)) for t in odd]


def test_spliced_counts(odd):
    tok = library(WORDS)
    for t in [*odd[-2:], " ".join(odd[:200]), "\n".join(odd[200:400])]:
        assert token_count.spliced_count(tok, t, 200, 20) == len(tok.encode(t, add_special_tokens=False))


def test_token_counts(docs):
    tok = library(WORDS)
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, WORDS, limit=20, chunk=500, overlap=50).collect()}
    for r in docs.select("doc_id", "text").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False))
        assert got[r.doc_id, len((r.text or "").encode())] == (n, n > 20)


def test_shards(spark, docs, tmp_path):
    tok = library(BYTES)
    got = token_count_rows = sst.token_shards(docs, BYTES).collect()
    want = sorted(((-(2**63) if r.doc_id is None else r.doc_id, crc(tok.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.select("doc_id", "text").collect()))
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    ordered, at = sorted(token_count_rows, key=lambda r: r.start), 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    uri = f"file://{tmp_path}/shards"
    manifest = sst.write_shards(docs, BYTES, uri)
    system, _ = sst.file_system(uri)
    found = {}
    for path in [r.path for r in manifest.collect()]:
        with system.open_input_file(path) as source:
            reader = sst.ShardReader(source)
            for i in (None, -7, 0, 3, 10**9):
                found.setdefault(i, []).extend(x.tolist() for x in reader.get(i))
    assert len(found[0]) == 2 and len(found[None]) == len(found[-7]) == len(found[3]) == 1 and not found[10**9]
    assert found[-7][0] == tok.encode("minus", add_special_tokens=False).ids + [0]


def test_packing(docs):
    tok = library(BYTES)
    rows = packing.pack(docs, BYTES, size=64, group=400).collect()
    whole = {}
    for r in docs.select("doc_id", "text").collect():
        whole.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [0])
    assert sum(r.length for r in rows) == sum(len(x) for v in whole.values() for x in v)
    for r in rows:
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 and (len(x) > 64) == (r.length != len(x)) for x in whole[r.doc_id])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 64 + len({r.sequence_id >> 32 for r in rows})


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    bins.held, bins.free = [[6], [5, 3], [4, 4], [2]], [4, 2, 2, 8]
    for k in range(4):
        bins._index(k)
    before = sum((10 - f) ** 2 for f in bins.free)
    packing.local_search(bins)
    assert sum((10 - f) ** 2 for f in bins.free) > before
    assert sum(bool(h) for h in bins.held) == 3
    assert sorted(x for h in bins.held for x in h) == [2, 3, 4, 4, 5, 6]


def optimum(lengths: list[int], size: int) -> int:
    best = len(lengths)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                place(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, size - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_packing_against_the_optimum():
    rng, over = np.random.default_rng(3), 0
    for _ in range(150):
        lengths = rng.integers(1, 31, rng.integers(1, 11))
        bin_of, offset = packing.pack_lengths(lengths, 30)
        for k in np.unique(bin_of):
            own = sorted(zip(offset[bin_of == k].tolist(), lengths[bin_of == k].tolist(), strict=True))
            assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own[:-1]]).tolist() and sum(n for _, n in own) <= 30
        over += len(np.unique(bin_of)) - optimum(lengths.tolist(), 30)
    assert over <= 3


def test_equal_pieces_are_exchanged_together():
    bins = packing.Bins(10)
    bins.held, bins.free = [[3, 3], [5, 4]], [4, 1]
    for k in range(2):
        bins._index(k)
    packing.local_search(bins)
    assert sorted(bins.free) in ([0, 5], [1, 4]) and sorted(x for h in bins.held for x in h) == [3, 3, 4, 5]


def test_large_groups_meet_the_lower_bound():
    rng = np.random.default_rng(7)
    lengths = np.minimum(rng.geometric(1 / 350, 30_000), 2048)
    bin_of, _ = packing.pack_lengths(lengths, 2048)
    assert len(np.unique(bin_of)) <= -(-lengths.sum() // 2048) + 2


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="proven"):
        ByteEncoder(WORDS)
    with pytest.raises(ValueError, match="proven"):
        UnitCounter(BYTES)


def test_line_feeds(odd):
    tok, rng = library(BYTES), random.Random(9)
    parts = ["a", "Word", "über", ".", ",\n", "\n", "\n\n", "\n\n\n", " ", " \n", "\n ", "<|endoftext|>", "1", "\u00a0", "\x1c", "'s", "\n'll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    assert [x.tolist() for x in ByteEncoder(BYTES, cap=60).ids(texts)] == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_pieces_equal_the_library(spark, docs, odd):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    codec = Codec(Vocabulary.load(PIECES), cap=50)
    assert [x.tolist() for x in codec.encode(odd)] == [model.encode(t) for t in odd]
    for t, x in zip(odd, codec.encode(odd), strict=True):
        assert codec.decode(x) == t.replace("▁", " ")
    got = sorted((str(r.doc_id), r.n_pieces, r.ids_crc32) for r in round_trip(docs, PIECES).collect())
    assert got == sorted((str(r.doc_id), len(x), crc(x)) for r in docs.select("doc_id", "text").collect() for x in [model.encode(r.text or "")])


def test_long_texts_without_spaces():
    import time

    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    rng, codec = random.Random(4), Codec(Vocabulary.load(PIECES))
    kinds = ["日本語文字列中国", "abcdefghij", "0123456789", "日a本b語c", "ab▁c\u00a0"]
    texts = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (65, 200, 3000)]
    assert [x.tolist() for x in codec.encode(texts)] == [model.encode(t) for t in texts]
    began = time.process_time()
    codec.encode(["".join(rng.choice(kinds[0]) for _ in range(300_000))])
    assert time.process_time() - began < 6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not token_count.token_counts(empty, WORDS).collect()
    assert not sst.token_shards(empty, BYTES).collect()
    assert not packing.pack(empty, BYTES).collect()
    assert not round_trip(empty, PIECES).collect()
    assert empty.agg(F.count("*")).first()[0] == 0
