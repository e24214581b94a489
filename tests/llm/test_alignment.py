"""Token alignment against a plain walk over both tokenizers' whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from granary.llm import token_alignment
from granary.llm.packing import RANKS
from granary.llm.piece_codec import MODEL
from granary.llm.token_alignment import aligned_tokens, alignment_report, lanes, lockstep, tokenizer_pair
from .conftest import texts

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODDER = [
    (21, "▁ marks"), (22, "a" * 9000), (23, "日本語のテキスト。" * 700), (24, "🙂🙂 x🙂"), (25, "tabs\t\there \n\n  and   more  "),
    (26, "one two " * 3000), (27, "\x1c\x85\xa0 　 a b"), (28, "it's 'll 123 4567 'S"), (29, "naïve Ωmega <0x41> <unk> </s>"),
]


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + extra)] = b
            extra += 1
    return table


BYTES = byte_table()


def plain_tokens(text):
    """Ids and bytes of both sides, or nothing."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a = [bytes(BYTES[c] for c in A.id_to_token(k)) for k in a]
    raw_b = [
        bytes([int(p[3:5], 16)]) if B.is_byte(k) else p.replace("▁", " ").encode()
        for k, p in zip(b, map(B.id_to_piece, b))
    ]
    whole = (" " + text).encode()
    return (a, b, raw_a, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])


def plain_groups(a, b, raw_a, raw_b):
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    groups, both = [], set(ends_a) & set(ends_b)
    i = j = 0
    while i < len(a):
        i0, j0 = i, j
        while ends_a[i] not in both:
            i += 1
        while ends_b[j] not in both:
            j += 1
        i, j = i + 1, j + 1
        groups.append((a[i0:i], b[j0:j]))
    return groups


def plain_report(rows):
    docs = [(i, t, plain_tokens(t)) for i, t in rows]
    grouped = [(i, x[0], x[1], plain_groups(*x)) for i, _, x in docs]
    count, best = Counter(), defaultdict(int)
    linked = []
    for *_, groups in grouped:
        links = Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        linked.append(links)
        count.update(links.keys())
    for (p, q), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (i, a, b, groups), links in zip(grouped, linked):
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            i, len(a), len(b), len(groups), sum(links.values()),
            sum(n for k, n in links.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in links.items()),
            hashlib.sha256(shown.encode()).hexdigest() if a else "",
        ))
    return Counter(out)


@pytest.mark.parametrize("chunk_bytes", [token_alignment.CHUNK_BYTES, 1000])
def test_odd_rows_equal_brute_force(spark, odd, chunk_bytes):
    more = spark.createDataFrame(ODDER, "doc_id bigint, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).repartition(3)
    found = alignment_report(docs, chunk_bytes=chunk_bytes)
    want = plain_report(texts(docs))
    assert Counter(map(tuple, found.collect())) == want
    assert any(row[0] == 21 and row[1] == 0 for row in want) and any(row[0] == 24 and row[1] for row in want)


def test_whole_table_equals_brute_force(documents):
    assert Counter(map(tuple, alignment_report(documents).collect())) == plain_report(texts(documents))


def test_empty_table(none):
    assert alignment_report(none).collect() == [] == aligned_tokens(none).collect()


def test_tokens_and_groups_are_real(spark, odd):
    for row in aligned_tokens(odd).collect():
        assert sum(row.group_a) == len(row.a_ids) and sum(row.group_b) == len(row.b_ids)
        assert len(row.group_a) == len(row.group_b)
    want = Counter((i, tuple(x[0]), tuple(x[1])) for i, t in texts(odd) for x in [plain_tokens(t)])
    assert Counter((r.doc_id, tuple(r.a_ids), tuple(r.b_ids)) for r in aligned_tokens(odd).collect()) == want


def test_lockstep_equals_a_walk_of_each_lane(monkeypatch):
    rng = random.Random(6)
    for wide in (4096, 3):
        monkeypatch.setattr(token_alignment, "WIDE", wide)
        for _ in range(40):
            lists = []
            for _ in range(rng.randrange(1, 9)):
                size = rng.randrange(0, 40)
                side = lambda: sorted({size, *(rng.randrange(1, size) for _ in range(rng.randrange(12)))}) if size > 1 else [1] * (size > 0)
                lists.append((side(), side()))
            flat = [np.array([e for pair in lists for e in pair[s]], dtype=np.int64) for s in (0, 1)]
            to = [np.cumsum([len(pair[s]) for pair in lists]) for s in (0, 1)]
            first = [t - np.array([len(pair[s]) for pair in lists]) for s, t in enumerate(to)]
            ids = [np.array([rng.randrange(4) for _ in f], dtype=np.int64) for f in flat]
            groups, links = lockstep(flat[0], first[0], to[0], flat[1], first[1], to[1], *ids)
            want, cuts = Counter(), []
            for k, (ends_a, ends_b) in enumerate(lists):
                last = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    ga = [int(first[0][k]) + n for n, e in enumerate(ends_a) if last < e <= cut]
                    gb = [int(first[1][k]) + n for n, e in enumerate(ends_b) if last < e <= cut]
                    cuts.append((k, ga[0], len(ga), gb[0], len(gb)))
                    want.update((k, int(ids[0][p]), int(ids[1][q])) for p in ga for q in gb)
                    last = cut
            found = Counter()
            for lane, p, q, times in zip(*(x.tolist() for x in links)):
                found[lane, p, q] += times
            assert found == want
            assert list(zip(*(x.tolist() for x in (groups.lane, groups.a_from, groups.a_size, groups.b_from, groups.b_size)))) == cuts


def test_lanes_join_to_the_text():
    for _, text in ODDER:
        assert " ".join(lanes(text, 50)) == text
    text = "日本 語 " * 4000 + "end"
    assert " ".join(lanes(text)) == text and max(map(len, lanes(text))) < 2100


def test_both_libraries_split_every_character_alike():
    pair = tokenizer_pair(RANKS, MODEL)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        text = "".join(f" x{c}1{c} {c}'s" for c in chars[at : at + 4096])
        assert pair.a.encode_ordinary(text) == A.encode(text, add_special_tokens=False).ids
