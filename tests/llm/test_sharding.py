from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest

from tidemark.llm import sharding


def brute_force(pairs, shards):
    """(doc_id, size, crc, shard) by definition: every capacity is tried on the ordered groups, then every cut."""
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()[: sharding.DIGEST_DIGITS]
    size = lambda text: len((text or "").encode()) + 1
    totals = {}
    for _, text in pairs:
        totals[digest(text)] = totals.get(digest(text), 0) + size(text)
    order = sorted(totals)
    marks = [0]
    for d in order:
        marks.append(marks[-1] + totals[d])
    total = marks[-1]

    def needed(capacity):
        used, count = 0, 1
        for d in order:
            if used + totals[d] > capacity:
                used, count = 0, count + 1
            used += totals[d]
        return count

    # capacities that matter are sums of neighbouring groups
    sums = sorted({b - a for i, a in enumerate(marks) for b in marks[i + 1 :]})
    capacity = next(c for c in sums if c >= max(totals.values()) and needed(c) <= shards)
    earliest = [total]
    for _ in range(shards - 1):
        earliest.insert(0, min(m for m in marks if m >= earliest[0] - capacity))
    heavy = [(marks[i], totals[d]) for i, d in enumerate(order) if totals[d] * shards > total]
    cuts = [0]
    for k in range(1, shards):
        here, left = cuts[-1], shards - k + 1
        ahead = [h for h in heavy if h[0] >= here]
        if ahead and ahead[0][0] == here:
            end = here + ahead[0][1]
        else:
            rest, others = total - here - sum(size for _, size in ahead), left - len(ahead)
            end = min(here + (math.ceil(rest / others) if others > 0 else capacity), ahead[0][0] if ahead else total)
        wanted = max(m for m in marks if m <= end)
        if wanted == here:
            wanted = min((m for m in marks if m > here), default=here)
        cuts.append(min(max(wanted, earliest[k - 1]), max(m for m in marks if m <= here + capacity)))
    shard = {d: sum(marks[i] >= c for c in cuts[1:]) for i, d in enumerate(order)}
    rows = [(doc, size(text), zlib.crc32((text or "").encode()), shard[digest(text)]) for doc, text in pairs]
    return sorted(rows, key=repr), capacity


def placed(df, shards=sharding.SHARDS):
    return [tuple(r) for r in sharding.byte_shards(df, shards).collect()]


def check(df, pairs, shards=sharding.SHARDS):
    rows = placed(df, shards)
    expected, capacity = brute_force(pairs, shards)
    assert sorted((r[:4] for r in rows), key=repr) == expected
    loads = {}
    for _, size, _, shard, slot in rows:
        loads.setdefault(shard, [0, []])
        loads[shard][0] += size
        loads[shard][1].append(slot)
    assert set(loads) <= set(range(shards))
    assert max(load for load, _ in loads.values()) == capacity or len(pairs) == 0
    for _, slots in loads.values():
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("seed, shards", [(1, 8), (2, 3), (3, 1)])
def test_smallest_capacity_equals_brute_force(spark, make_docs, seed, shards):
    dice = random.Random(seed)
    texts = ["x" * dice.randint(0, 60) + str(dice.randrange(120)) for _ in range(200)]
    pairs = [(i, dice.choice(texts[:40]) if dice.random() < 0.4 else t) for i, t in enumerate(texts)]
    check(make_docs(*pairs), pairs, shards)


def test_coarse_cells_are_refined_where_cuts_lie(spark, make_docs, monkeypatch):
    """With one hex digit to begin with, every cut lies inside a cell of many groups."""
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    dice = random.Random(9)
    pairs = [(i, "w" * dice.randint(0, 300) + str(i)) for i in range(400)]
    check(make_docs(*pairs), pairs)


def test_a_text_with_a_third_of_all_rows_stays_whole_and_the_rest_is_even(spark, make_docs):
    pairs = [(i, "the very same text") for i in range(200)] + [(1000 + i, f"other text {i}") for i in range(400)]
    check(make_docs(*pairs), pairs)
    rows = placed(make_docs(*pairs))
    assert len({r[3] for r in rows if r[0] < 1000}) == 1
    loads = [sum(r[1] for r in rows if r[3] == shard) for shard in range(8)]
    total = sum(loads)
    assert min(loads) > total / 16 / 2  # no shard is left empty behind a full one


def test_nulls_repeats_and_empties(spark, odd_docs, make_docs):
    pairs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(odd_docs, pairs)
    rows = placed(odd_docs)
    assert {r[1:3] for r in rows if r[0] == 1} == {(1, 0)}
    one = placed(make_docs((5, "alone")))
    assert [r[1:3] + r[4:] for r in one] == [(6, zlib.crc32(b"alone"), 0)]
    assert placed(make_docs((1, "a")).limit(0)) == []


def test_equal_texts_meet_null_and_empty_included(spark, make_docs):
    rows = placed(make_docs(*[(i, None if i % 2 else "") for i in range(20)], *[(100 + i, f"t{i}") for i in range(40)]))
    assert len({r[3] for r in rows if r[0] < 100}) == 1


def test_extra_columns_are_ignored(spark, crowded, make_docs):
    pairs = [(i, f"text {i % 7}") for i in range(30)]
    check(crowded(make_docs(*pairs)), pairs)
