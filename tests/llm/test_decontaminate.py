from __future__ import annotations

import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm.decontaminate import Matcher, benchmark_hits, best_match, letter_masks, normalised, without_benchmark


def edit_distance_within(item, text):
    """Fewest edits between item and any stretch of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for a in item:
        before, row = row, [row[0] + 1]
        for k, b in enumerate(text):
            row.append(min(before[k] + (a != b), before[k + 1] + 1, row[k] + 1))
    return min(row)


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=60))
def test_bit_parallel_distance(item, text):
    expected = edit_distance_within(item, text)
    found = best_match(letter_masks(item), len(item), text, len(item))
    if found:
        assert found[0] == min(expected, found[0]) and found[0] >= expected
        assert edit_distance_within(item, text[: found[1]]) == found[0]
    assert expected == len(item) or found[0] == expected


def edited(item, edits, rng):
    letters = list(item)
    for _ in range(edits):  # inside words: blanks that meet would make one edit two
        at = rng.choice([k for k in range(1, len(letters) - 1) if "".join(letters[k - 1 : k + 2]).isalpha()])
        kind = rng.randrange(3)
        letters[at : at + 1] = {0: [], 1: ["q"], 2: [letters[at], "q"]}[kind]
    return "".join(letters)


def test_any_edits_within_the_budget_are_found(spark, sf_dir):
    rng = random.Random(7)
    items = [(r["item_id"], normalised(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    matcher = Matcher(items, 0.06)
    for n, (item_id, text) in enumerate(items):
        for edits in range(matcher.errors[n] + 1):
            document = "Some words before. " + edited(text, edits, rng).replace("e", "E").replace(" ", " \n ") + " and behind"
            found = {i: e for i, e, _, _ in matcher.find(document)}
            assert found[item_id] <= edits
        assert item_id not in {i for i, *_ in matcher.find(edited(text, 3 * matcher.errors[n] + 6, rng)[: len(text) // 2])}


def test_hits_equal_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = benchmark_hits(docs, items).collect()
    exact = {
        (d["doc_id"], i["item_id"])
        for d in docs.collect()
        for i in items.collect()
        if normalised(i["text"]) in normalised(d["text"] or "")
    }
    assert {(r["doc_id"], r["item_id"]) for r in found if r["edits"] == 0} == exact and exact
    texts = {d["doc_id"]: normalised(d["text"] or "") for d in docs.collect()}
    passages = {i["item_id"]: normalised(i["text"]) for i in items.collect()}
    for r in found:
        assert edit_distance_within(passages[r["item_id"]], texts[r["doc_id"]]) == r["edits"] <= 0.06 * len(passages[r["item_id"]])
        if not r["edits"]:
            assert texts[r["doc_id"]][r["start"] : r["end"]] == passages[r["item_id"]]
    # a benchmark cut into many parts gives the same
    assert sorted(map(tuple, benchmark_hits(docs, items, part_chars=500).collect())) == sorted(map(tuple, found))
    kept = {r["doc_id"] for r in without_benchmark(docs, items).collect()}
    assert kept == set(texts) - {r["doc_id"] for r in found}


def template_items(count, seed=3):
    """Items that begin with the same 80 letters."""
    rng = random.Random(seed)
    head = "read the following passage with care and answer the question at the end of it : "
    return [(n, head + " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(25))) for n in range(count)], head


def slow_hits(matcher, text):
    """(item, edits) of all items within their budget, by the distance alone."""
    text, found = normalised(text), {}
    for n, (item_id, item) in enumerate(matcher.items):
        match = best_match(letter_masks(item), len(item), text, matcher.errors[n])
        if match:
            found[item_id] = match[0]
    return found


def test_items_with_one_beginning_cost_little_and_lose_nothing():
    items, head = template_items(2000)
    matcher, rng = Matcher(items, 0.06), random.Random(5)
    for planted in ([], [7], [11, 1200]):
        text = (head + "some other words stand here instead . ") * 5
        text += " ".join(edited(items[n][1], matcher.errors[n] // 2, rng) for n in planted)
        began = time.perf_counter()
        found = {item_id: edits for item_id, edits, *_ in matcher.find(text)}
        assert time.perf_counter() - began < 0.5  # about 0.03 alone; 5 without the bound
        assert found == slow_hits(matcher, text) and set(planted) == set(found)


def test_long_text_of_common_pieces():
    items, head = template_items(200)
    text = (head + "nothing of them . ") * 10_000 + items[150][1]
    began = time.perf_counter()
    assert [hit[:2] for hit in Matcher(items, 0.06).find(text)] == [(150, 0)]
    assert time.perf_counter() - began < 60


@given(st.lists(st.text("ab ", min_size=20, max_size=90), min_size=1, max_size=12), st.text("ab ", max_size=300))
def test_counting_first_changes_nothing(texts, document):
    items = [(n, text) for n, text in enumerate(dict.fromkeys(map(normalised, texts))) if text]
    matcher = Matcher(items, 0.2)
    loose = Matcher(items, 0.2)
    loose._promising = lambda text, item, low, high: item >= 0
    for text in (document, document + items[0][1] + document if items else document):
        assert matcher.find(text) == loose.find(text)


def test_one_part_at_a_time(spark, make_docs):
    items, _ = template_items(40)  # some seven parts
    docs = spark.createDataFrame([(n, text if n % 4 == 0 else f"clean {n}") for n, text in items], "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    kept = without_benchmark(docs, items, part_chars=1500)
    assert kept._jdf.queryExecution().toString().count("MapInArrow") <= 4  # one node in each of the four forms of the plan
    assert {r["doc_id"] for r in kept.collect()} == {n for n in range(40) if n % 4}
    assert {(r["doc_id"], r["item_id"]) for r in benchmark_hits(docs, items, part_chars=1500).collect()} == {(n, n) for n in range(0, 40, 4)}


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (2, "  ")]])
def test_nothing_to_match(spark, odd_docs, rows):
    items = spark.createDataFrame(rows, "item_id long, text string")
    assert benchmark_hits(odd_docs, items).count() == 0
    assert without_benchmark(odd_docs, items).count() == odd_docs.count()


def test_odd_documents_and_items(spark, odd_docs, make_docs, crowded):
    rows = [(3, "Same words HERE today"), (2, "same  words here today"), (None, "one very long text with"), (4, "no"), (5, None)]
    items = crowded(spark.createDataFrame(rows, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in benchmark_hits(crowded(odd_docs), items).collect()}
    # equal items count as one, short ones need word ends around them
    assert found == {(4, 2, 0), (5, 2, 0), (6, None, 0), (None, 4, 0)}
    kept = without_benchmark(crowded(odd_docs), items)
    assert kept.columns == crowded(odd_docs).columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 7, 8}
    assert benchmark_hits(make_docs(), items).count() == 0
