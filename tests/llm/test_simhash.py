from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm.components import components
from tidemark.llm.simhash import QUADS, fingerprint, linked, links, near_duplicates


def plain_fingerprint(text):
    """The definition, word for word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest reachable id by comparing all pairs; prints: id -> fingerprint."""
    at = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and at[b] < at[a]:
                    at[a], changed = at[b], True
    return at


def test_quads_leave_out_every_three_positions_once():
    for missing in ((a, b, c) for a in range(8) for b in range(a) for c in range(b)):
        assert sum(not set(q) & set(missing) for q in QUADS) == 1


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "A b C d", "Ä b Ä b Ä b", "x y z\x1cq r s", "a b c " * 70_000])
def test_fingerprint_is_the_definition(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_count_filter_and_verification():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    assert linked(a, b, 3).tolist() == [f.bit_count() <= 3 for f in flips]


def test_components_equal_brute_force_on_planted_neighbours(spark):
    rng = random.Random(3)
    prints = {}
    for _ in range(40):  # chains and stars around random centres
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints[len(prints)] = at
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    distinct = {}
    for i, p in signed.items():
        distinct[p] = min(i, distinct.get(p, i))
    frame = spark.createDataFrame([(i, p) for p, i in distinct.items()], "id long, bits long")
    expected = plain_components({i: prints[i] for i in distinct.values()})
    for block in (2048, 3):  # entries cut into blocks lose nothing
        found = {r["node"]: r["component"] for r in components(links(frame, block=block)).collect()}
        assert {i: found.get(i, i) for i in distinct.values()} == expected


def test_large_group_of_neighbours_in_one_entry(spark):
    centre = 0x0123456789ABCDEF
    rows = [(n, centre ^ (1 << a) ^ (1 << b)) for n, (a, b) in enumerate((a, b) for a in range(32) for b in range(a))]
    found = components(links(spark.createDataFrame(rows, "id long, bits long"), block=64)).collect()
    assert {r["node"] for r in found} == set(range(len(rows))) and {r["component"] for r in found} == {0}


def test_components_of_a_long_chain_and_odd_links(spark):
    order = list(range(300))
    random.Random(5).shuffle(order)
    rows = [*zip(order, order[1:]), (1000, 1000), (None, 5), (2000, 2001), (2001, 2000)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {found[n] for n in order} == {0} and found[2001] == found[2000] == 2000 and 1000 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(odd_docs, crowded):
    out = near_duplicates(crowded(odd_docs)).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None, None]


def test_texts_of_one_doc_id_are_linked(make_docs):
    out = near_duplicates(make_docs((9, "aa bb cc dd"), (9, "ee ff gg hh"), (4, "ee ff gg hh"), (7, "aa bb cc dd"))).collect()
    assert {r["component_id"] for r in out} == {4}


def test_empty_table(make_docs):
    assert near_duplicates(make_docs()).count() == 0
