from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_force(docs, items, top=10):
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(rows, key=repr)


def found(docs, items, **options):
    result = lexical.ranked(docs, items, **options)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in result.collect()), key=repr)


def items_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "item_id long, text string")


def prose(seed, n, longest):
    dice = random.Random(seed)
    words = [f"w{int(dice.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, " ".join(dice.choices(words, k=dice.randint(0, longest)))) for i in range(n)]


@pytest.mark.parametrize("seed, n, longest", [(1, 300, 40), (2, 60, 900)])
def test_results_equal_brute_force(spark, make_docs, seed, n, longest):
    docs = prose(seed, n, longest)
    items = [(i, text) for i, (_, text) in enumerate(prose(seed + 10, 25, 30))]
    assert found(make_docs(*docs), items_of(spark, *items)) == brute_force(docs, items)


def test_items_go_in_parts_and_in_chunks(spark, make_docs, monkeypatch):
    docs = prose(3, 120, 60)
    items = [(i, text) for i, (_, text) in enumerate(prose(13, 12, 20))]
    monkeypatch.setattr(lexical, "CHUNK_TERMS", 25)
    assert found(make_docs(*docs), items_of(spark, *items), part_terms=60) == brute_force(docs, items)


def test_ties_take_the_smaller_doc_id_and_null_last(spark, make_docs):
    docs = [(i, "rare words here") for i in range(40, 20, -1)] + [(None, "rare words here"), (7, "something else"), (3, "rare")]
    items = [(1, "RARE, words"), (2, "nowhere at all"), (3, None), (4, ""), (None, "else"), (1, "rare")]
    assert found(make_docs(*docs), items_of(spark, *items)) == brute_force(docs, items)
    few = [(None, "rare"), (2, "rare")]
    assert found(make_docs(*few, (5, "x y z"), (6, "x y"), (8, "z")), items_of(spark, (1, "rare"))) == brute_force(
        few + [(5, "x y z"), (6, "x y"), (8, "z")], [(1, "rare")]
    )


def test_odd_documents(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "same words here today"), (2, "ÉTÉ été 字"), (3, "very LONG text"), (4, "odd\x85blanks \x1c odd")]
    assert found(odd_docs, items_of(spark, *items)) == brute_force(docs, items)


def test_empty_tables(spark, make_docs):
    none = make_docs((1, "a")).limit(0)
    assert found(none, items_of(spark, (1, "a"))) == []
    assert found(make_docs((1, "a")), items_of(spark, (1, "a")).limit(0)) == []
    assert found(make_docs((1, None), (2, " .,")), items_of(spark, (1, "a"))) == []


def test_extra_columns_are_ignored(spark, crowded, make_docs):
    docs, items = prose(5, 40, 20), [(1, "w1 w2 w3"), (2, "w5")]
    assert found(crowded(make_docs(*docs)), crowded(items_of(spark, *items))) == brute_force(docs, items)


def test_bounds_are_never_below_the_score_and_exclude_most_documents(spark, make_docs):
    docs = prose(6, 400, 50)
    index = lexical.index_blocks(make_docs(*docs)).collect()
    n_docs, n_terms = sum(len(b["doc_ids"]) for b in index), sum(sum(b["lengths"]) for b in index)
    item = {t: 1000 for t in {b"w900", b"w77", b"w3", b"w12"}}
    searcher = lexical._Searcher([item], n_docs, n_terms)
    near = total = 0
    for b in index:
        slices = np.frombuffer(b["slices"], dtype=np.uint8).reshape(b["width"], -1)
        ms = [10 + 90 * n * n_docs // n_terms for n in b["lengths"]]
        (first, where, hashes), = searcher.chunks
        with np.errstate(over="ignore"):
            bound = where[0][1] @ searcher.bounds(hashes, slices, b["lengths"], ms)[where[0][0]]
        for row, text in enumerate(b["texts"]):
            counts = Counter(lexical.terms_of(bytes(text)))
            score = sum(w * lexical.term_part(counts[t], ms[row]) for t, w in item.items() if t in counts)
            assert bound[row] >= score
            near += bound[row] <= 1.6 * score
            total += 1
    assert near > 0.9 * total
