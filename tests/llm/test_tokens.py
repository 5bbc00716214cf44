"""Byte-level BPE, token files and packing against the tokenizer libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import bpe, dac, packing
from lodestone.llm.units import Pieces

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def texts() -> list[str | None]:
    rng = random.Random(3)
    bits = ["the", "The", " and", "  ", "\n", "\n\n ", " \t", "don't", "1234", "été", "中文", "\U0001f600", " ", "!!!", "_x", "antidisestablishment", "'s", " Ärger"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return [*out, None, "", " ", "   ", "a", "x" * 300, " ".join(rng.choice(bits) for _ in range(20_000)), *out[:5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts())], "doc_id long, text string, n_tokens int").repartition(5)


@pytest.fixture(scope="module")
def library():
    enc = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    return enc.encode_ordinary, Tokenizer.from_file(JSON)


def test_bpe_is_the_library(spark, docs, library):
    got = {r.doc_id: r for r in bpe.encode_decode(docs, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts()):
        ids = library[0](t or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    assert bpe.encode_decode(docs.limit(0), RANKS, PATTERN).collect() == []


def test_prefix_table_appends_and_edits():
    code, rng = bpe.PrefixBPE(bpe.load_ranks(RANKS)), random.Random(1)
    data = bytes(rng.choice(b"abcdefghij etaoin") for _ in range(600))
    table = bpe.PrefixTable(code)
    for at in range(0, 600, 37):
        table.append(data[at : at + 37])
    for _ in range(30):
        at, gone, new = rng.randrange(500), rng.randrange(6), bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(6)))
        table.splice(at, gone, new)
        fresh = bpe.PrefixTable(code, bytes(table.data))
        assert table.last == fresh.last and b"".join(code.token[i] for i in table.ids()) == bytes(table.data)
        assert table.ids() == code.merged(bytes(table.data))
    assert table.splice(10, 1, b"q") < 600  # only what stands near the edit is computed anew


def test_piece_memory_stays_bounded():
    pieces = Pieces(PATTERN, lambda m: m, "".join, entries=50)
    for i in range(500):
        text = f"word{i} and more{i} text  here {i}"
        assert "".join(pieces(text)).replace(" ", "") == text.replace(" ", "")
        assert max(map(len, (pieces.first, pieces.rest, pieces.words))) <= 70


def library_ids(t, library) -> list[int]:
    return library[1].encode(t or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_token_files(spark, docs, library, shard):
    path = dac.write(docs, JSON, PATTERN, shard_tokens=shard)
    got, start = sorted(dac.read(spark, path).collect(), key=lambda r: r.doc_id), 0
    assert len(got) == len(texts())
    for r, t in zip(got, texts(), strict=True):
        ids = library_ids(t, library)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_keep_documents_without_an_id(spark, library):
    rows = [(None, "no id"), (7, "b c"), (None, None), (-3, "a"), (None, "no id"), (0, "zero")]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.read(spark, dac.write(spark.createDataFrame(rows, "doc_id long, text string"), JSON, PATTERN)).collect())
    sums = {t: (len(ids := library_ids(t, library)), zlib.crc32(np.array(ids, "<u4").tobytes())) for _, t in rows}
    assert [r[1] for r in got] == [-3, 0, 7, None, None, None]
    assert [r[2:] for r in got[:3]] == [sums["a"], sums["zero"], sums["b c"]] and sorted(r[2:] for r in got[3:]) == sorted([sums[None], sums["no id"], sums["no id"]])
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()


def test_token_files_of_nothing(spark, docs):
    assert dac.read(spark, dac.write(docs.limit(0), JSON, PATTERN)).collect() == []


@pytest.mark.parametrize("ids", [[], [0], [255, 256], [0, 1, 255, 256, 65535, 65536, 2**32 - 1] * 50])
def test_code_gives_any_token(ids):
    code = dac.Code(dac.encode(np.array(ids, np.uint32)))
    assert len(code) == len(ids) and [code[i] for i in range(len(ids))] == ids
    places = np.random.default_rng(0).permutation(len(ids))
    assert code.take(places).tolist() == [ids[i] for i in places]


ADDED = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n  x", "<|endoftext|", "two  words <|endoftext|> and  more"]


def test_added_tokens_in_texts(spark, library):
    """Token files and packing recognise the file's added tokens inside a text, as the library does."""
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    files = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in dac.read(spark, dac.write(df, JSON, PATTERN)).collect()}
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(df, JSON, PATTERN).collect()}
    want = {i: (len(ids := library_ids(t, library)), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in enumerate(ADDED)}
    assert library_ids(ADDED[0], library) == [64, 50256, 65, 0]
    assert files == want and packed == want


def placed(rows, capacity):
    """Checks that pieces fill sequences without gaps; gives how many sequences there are."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs, library):
    rows = packing.pack(docs, JSON, PATTERN, capacity=128, block=64).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, t in enumerate(texts()):
        ids, at = library_ids(t, library), 0
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and (len(mine) == 1 or all(r.length == 128 for r in mine[1:]))
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        total += len(ids)
    assert -(-total // 128) <= placed(rows, 128) <= 1.03 * total / 128 + 3
    assert packing.pack(docs.limit(0), JSON, PATTERN).collect() == []


def test_packing_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    rows = packing.pack(df, JSON, PATTERN).collect()
    assert len(rows) == 4 and placed(rows, 2048) == 1


def test_evolution_does_not_lose_pieces():
    rng = random.Random(2)
    size = [rng.randrange(1, 100) for _ in range(300)]
    first = packing.evolve(size, [], 100, 0, 1, 1)
    later = packing.evolve(size, [first], 100, 30, 4, 2)
    for s in (first, later):
        assert np.bincount(s, size).max() <= 100 and len(s) == 300
    assert later.max() <= first.max()
