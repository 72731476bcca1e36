from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import END_ID, Places, fullest, pack, plan, sequences
from tidemark.llm.tokens import Encoder, default_tokenizer


ENCODER = Encoder(default_tokenizer())


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


TEXTS = st.text(st.sampled_from("abcXYZ 'éßİΣς中́\n\t\x1c\x85  .,!|<>0129½²") | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_the_tokenizers(text):
    ids = np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()
    assert ids == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["they're I'LL x's", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İstanbul", "x\x1cy", "A" * 5000, "1234 ½"])
def test_ids_of_hard_texts(plain, text):
    ids = np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()
    assert ids == plain.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 12), st.integers(0, 4), max_size=5), st.integers(0, 25))
def test_fullest_leaves_least_slack(counts, room):
    sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
    chosen = fullest(counts, room)
    assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= room)
    assert all(0 < k <= counts[n] for n, k in chosen)


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=20))
def test_plan_uses_every_piece_once(counts):
    used = {}
    for combination, times in plan(counts, 64):
        assert sum(n * k for n, k in combination) <= 64
        for n, k in combination:
            used[n] = used.get(n, 0) + k * times
    assert used == {n: c for n, c in counts.items() if c}


def test_places_are_gapless():
    counts = {64: 3, 40: 5, 24: 4, 10: 11, 1: 30}
    places = Places.of(plan(counts, 64))
    spans = {}
    for length, n in counts.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            spans.setdefault(s, []).append((o, length))
    for parts in spans.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1]


def test_packing_equals_plain_tokenizing(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(docs, keep_ids=True)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = {doc: np.array([*plain.encode(text, add_special_tokens=False).ids, END_ID], "<u4") for doc, text in texts.items()}
    filled, pieces = {}, {}
    for r in rows.collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["ids"] == part.tobytes()
        assert r["start"] == 2048 * r["piece"]
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    assert pieces == {doc: len(x) for doc, x in ids.items()}
    least = -(-sum(map(len, ids.values())) // 2048)
    assert least <= len(filled) <= least + 1
    whole = {r["sequence_id"]: r["ids"] for r in sequences(rows).collect()}
    for sequence, parts in filled.items():
        assert whole[sequence] == b"".join(p for _, _, p in sorted(parts))


def test_odd_documents(odd_docs, crowded):
    out = pack(crowded(odd_docs)).collect()
    assert sum(r["piece"] == 0 for r in out) == odd_docs.count()
    blank = [r for r in out if r["doc_id"] in (1, 2, 3)]
    assert [(r["length"], r["ids_crc32"]) for r in blank] == [(1, zlib.crc32(bytes(4)))] * 3
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


def test_empty_table(make_docs):
    assert pack(make_docs()).count() == 0
