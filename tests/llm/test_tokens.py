"""Token files, pieces and packing against the tokenizer libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import token_files
from granary.llm.crc_parts import moved
from granary.llm.packing import FULL, RANKS, SPECIAL, CapacityTree, best_fit, encoder, pack_documents
from granary.llm.piece_codec import MODEL, PieceCodec, encoded, piece_digests
from granary.llm.range_coder import decode_blocks, encode_blocks
from .conftest import texts

CODEC = PieceCodec(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def library_ids(name, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


SPECIALS = ["<|endoftext|>", "<|startoftext|>", " ", "a", "B ", "<|", "|>", "<|endoftext", "\n", "\x1c", "é"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(SPECIALS), max_size=12))
def test_special_strings_are_the_ids_of_the_library(parts):
    text = "".join(parts)
    words = token_files.word_memory(token_files.TOKENIZER).ids([text])
    assert [list(x) for x in words] == library_ids("word_bpe_49k.json", [(0, text)])
    found = encoder(RANKS, SPECIAL).encode(text, allowed_special="all")
    assert [found] == library_ids("byte_bpe_50k.json", [(0, text)])


def test_coder_takes_ids_of_32_bits():
    ids = np.array([0, 70000, 5, 2**32 - 1, 70000], dtype="<u4")
    assert list(decode_blocks(encode_blocks([ids]), [5])[0]) == list(ids)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 49407), min_size=1, max_size=300), min_size=1, max_size=6))
def test_coder_round_trip(blocks):
    arrays = [np.array(b, dtype="<u4") for b in blocks]
    coded = encode_blocks(arrays)
    assert [list(x) for x in decode_blocks(coded, [len(b) for b in blocks])] == blocks
    for array, data in zip(arrays, coded):  # whatever stands beside it
        assert encode_blocks([array]) == [data]


def test_coder_learns_and_carries():
    rng = np.random.default_rng(3)
    blocks = [
        np.tile(np.array([5, 9, 70, 5, 11, 49407], dtype="<u4"), 1365), np.zeros(8192, dtype="<u4"),
        rng.integers(0, 49408, 8192).astype("<u4"), np.minimum(rng.zipf(1.3, 8192), 49407).astype("<u4"),
    ]
    coded = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks(coded, [len(b) for b in blocks])))
    assert len(coded[0]) < 2500 and len(coded[1]) < 1500
    assert len(coded[3]) < 2 * 8192
    with pytest.raises(ValueError):
        encode_blocks([np.zeros(8193, dtype="<u4")])


def test_damaged_blocks_raise():
    pieces = [(None, 2, False), (-4, 1, True)]
    data = token_files.pack_block(1 << 40, pieces, b"abcd", 3)
    assert token_files.unpack_block(data) == (1 << 40, pieces, b"abcd", 3)
    with pytest.raises(ValueError):
        token_files.unpack_block(data[:8] + bytes([data[8] ^ 1]) + data[9:])


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_files_return_all_ids_in_order(table, request, tmp_path):
    df = request.getfixturevalue(table)
    spark = df.sparkSession
    rows = texts(df)
    token_files.write_tokens(df, str(tmp_path / "t"), block=512, lanes=16)
    found = token_files.read_tokens(spark.read.parquet(str(tmp_path / "t")), lanes=16).collect()
    ids = [i + [1] for i in library_ids("word_bpe_49k.json", rows)]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(
        (i, len(x), crc(x)) for (i, _), x in zip(rows, ids)
    )
    at = 0
    order = sorted(found, key=lambda r: r.start)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in order]
    assert keys == sorted(keys)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6), st.integers(0, 1 << 40))
def test_checksum_of_a_text_from_those_of_its_parts(parts, far):
    ends = np.cumsum([len(p) for p in parts])
    aligned = moved([zlib.crc32(p) for p in parts], -ends)
    whole = moved([np.bitwise_xor.reduce(aligned)], ends[-1:])
    assert whole[0] == zlib.crc32(b"".join(parts))
    assert list(moved(moved(aligned, [far] * len(parts)), [-far] * len(parts))) == list(aligned)


def test_blocks_are_read_in_any_order(documents, tmp_path):
    spark = documents.sparkSession
    token_files.write_tokens(documents, str(tmp_path / "t"), block=64, lanes=16)
    files = spark.read.parquet(str(tmp_path / "t"))
    mixed = files.withColumn("data_", F.lit(1)).repartition(13, F.xxhash64("shard", "block"))
    want = token_files.read_tokens(files, lanes=16).collect()
    assert files.where("earlier > 64").count() and Counter(token_files.read_tokens(mixed, lanes=5).collect()) == Counter(want)


@pytest.mark.parametrize("space", [*map(chr, range(33)), "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\ufeff"])
def test_words_end_where_the_tokenizer_ends_them(space):
    rows = [(0, f"alpha{space}beta {space} gamma{space}"), (1, space)]
    found = token_files.word_memory(token_files.TOKENIZER).ids([t for _, t in rows])
    assert [list(x) for x in found] == library_ids("word_bpe_49k.json", rows)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab▁\n\té日𝒳thelo", min_size=1, max_size=90), max_size=300))
def test_agendas_side_by_side_merge_as_alone(chunks):
    chunks = [chunk * n for chunk in chunks for n in (1, 2, 3)]
    assert CODEC.merge_all(chunks) == [CODEC.merge(chunk) for chunk in chunks]


ALPHABET = "ab ▁\n\té日𝒳<s></s>  the\x00́ \r.,"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=40))
def test_pieces_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    ids = LIBRARY.encode(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_a_word_without_spaces_is_encoded_whole():
    text = "".join(random.Random(2).choice("abcdeé") for _ in range(60_000))
    assert CODEC.encode(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_digests_equal_the_library(table, request):
    df = request.getfixturevalue(table)
    expected = Counter()
    for i, t in texts(df):
        ids = LIBRARY.encode(t or "")
        expected[
            i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(),
        ] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_digests(df).collect()) == expected
    assert all(r.ids == LIBRARY.encode(t or "") for r, t in _matched(encoded(df), texts(df)))


def _matched(df, rows):
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append(t)
    for r in df.collect():
        if len(left[r.doc_id]) == 1:
            yield r, left[r.doc_id][0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_finds_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms = []
    for length, (sequence, offset) in zip(lengths, best_fit(lengths, 64)):
        fits = [room for room in rooms if room >= length]
        if fits:
            assert rooms[sequence] == min(fits)
        else:
            assert sequence == len(rooms)
            rooms.append(64)
        assert offset == 64 - rooms[sequence]
        rooms[sequence] -= length


def test_tree_is_empty_at_first():
    tree = CapacityTree(5)
    assert tree.take(1) is None
    tree.put(3, 8)
    assert tree.take(4) is None and tree.take(2) == (3, 8) and tree.take(1) is None


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_packing_holds_every_id_once(table, request):
    df = request.getfixturevalue(table)
    rows = texts(df)
    ids = [i + [0] for i in library_ids("byte_bpe_50k.json", rows)]
    found = pack_documents(df, task_pieces=40).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == Counter(
        (i, s, len(x[s : s + 1024]), crc(x[s : s + 1024]), len(x))
        for (i, _), x in zip(rows, ids) for s in range(0, len(x), 1024)
    )
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    if table == "documents":
        assert sum(map(len, ids)) > 0.93 * 1024 * len(sequences)


def test_full_windows_skip_the_packing_tasks(odd):
    found = pack_documents(odd.repartition(5), window=64).collect()
    full = [r.sequence_id for r in found if r.length == 64]
    assert len(full) > 1000 and len(set(full)) == len(full) and min(full) >= FULL
    assert all(r.sequence_id < FULL for r in found if r.length < 64)
