from __future__ import annotations

import itertools
import re
import time

import pytest

from tidemark.llm.licenses import CONFIDENCE, PHRASE_SCORE, PHRASES, gates, rules, scan, spelled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """n_words, n_base, first and last place, base labels, by walking the words."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        for at in range(len(words) - len(own) + 1):
            if words[at : at + len(own)] == own:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_whole_table_equals_plain_walk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = scan(docs).collect()
    assert {r["doc_id"]: tuple(r[c] for c in BASE) for r in rows} == {doc: plain(text) for doc, text in texts.items()}
    assert any(r["n_base"] for r in rows)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("see https://opensource.org/licenses/MPL-2.0", "mpl-2.0"),
        ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
        ("All rights reserved.", "all-rights-reserved"),
        ("mit license MIT-License mit\nlicense", "mit"),
        ("ist mit ihm ohne license", ""),
        ("permit license; mit licenses", ""),
    ],
)
def test_labels(make_docs, text, labels):
    assert scan(make_docs((1, text))).first()["labels"] == labels


def test_containing_places_suppress(make_docs):
    found = scan(make_docs((1, "licensed under the apache license version 2.0 or the apache license"))).first()["detections"]
    assert [(d["label"], d["priority"]) for d in found] == [("apache-2.0", 4), ("apache", 1)]


def test_rules_are_ordered_and_gated():
    table = rules()
    assert len(table) > 250 and [r.priority for r in table] == sorted((r.priority for r in table), reverse=True)
    for rule in table:
        re.compile(rule.pattern)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under Apache 2.0.", "apache-2.0"),
        ("Released under Apache 2.", "apache-2.0"),
        ("Available under the Mozilla Public 2.0", "mpl-2.0"),
        ("under GNU General Public version 3", "gpl-3.0"),
        ("Eclipse Public v2", "epl-2.0"),
        ("Licensed under the Expat License", "mit"),
        ("x11 licence", "mit"),
        ("CC0", "public-domain"),
        ("no rights reserved", "public-domain"),
        ("PSF 2", "psf-2.0"),
    ],
)
def test_no_other_word_is_needed(make_docs, text, labels):
    assert scan(make_docs((1, text))).first()["labels"] == labels


def test_spelled():
    assert spelled("a(?:b|cd?)? [xy]") == ["a x", "a y", "ab x", "ab y", "ac x", "ac y", "acd x", "acd y"]


def test_every_match_of_a_rule_passes_gate_and_keyword():
    gate = gates()
    for rule in rules():
        for text in spelled(rule.pattern):
            assert re.fullmatch(rule.pattern, text)
            assert any(k in f" {text} " for k in rule.keywords) and any(k in f" {text} " for k in gate), (rule, text)


def test_shortest_match_of_every_rule_is_labelled(make_docs):
    table = rules()
    rows = scan(make_docs(*((n, min(spelled(r.pattern), key=len)) for n, r in enumerate(table)))).collect()
    assert len(rows) == len(table)
    for row in rows:
        assert table[row["doc_id"]].label in row["labels"].split(","), table[row["doc_id"]]


def test_plan_is_native(spark, sf_dir):
    plan = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_documents(odd_docs, make_docs, crowded):
    docs = crowded(odd_docs.unionAll(make_docs((9, "mit license " * 4000), (10, "İ K mİt license"))))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    rows = scan(docs).collect()
    assert len(rows) == docs.count()
    assert all(tuple(r[c] for c in BASE) == plain(texts[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    assert scan(make_docs()).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "isc"),
        ("GPLv3", "gpl-3.0"), ("GPLv2+", "gpl-2.0"), ("LGPLv2.1", "lgpl-2.1"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("BSD license", "bsd"),
        ("license: MIT", "mit"), ('"license": "ISC",', "isc"), ("The Unlicense", "unlicense"), ("MIT and Apache 2.0 licenses", "apache-2.0,mit"),
        ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0"), ("licensed under CC0 1.0", "cc0-1.0"), ("Die Lizenz mit Bedingungen", ""), ("a gplx and license mitten", ""),
        ("the MİT LICENSE", ""), ("THE MIT LICENSE É", "mit"),
    ],
)
def test_signatures(make_docs, text, labels):
    assert scan(make_docs((1, text))).first()["labels"] == labels


def walked(text):
    """Labels and score by trying each rule at each word, then suppressing what a place of its or a higher priority contains."""
    words = f" {' '.join(WORD.findall(re.sub('[A-Z]', lambda m: m[0].lower(), text or '')))} "
    places = []
    for rule in rules():
        for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", words):
            places.append((*m.span(), rule.priority, rule.label))
    kept = []
    for place in places:
        start, end, priority, label = place
        inside = [p for p in places if p != place and p[0] <= start and end <= p[1] and p[2] >= priority]
        if not any(p[:2] != (start, end) or p[2] > priority or p[3] < label for p in inside):
            kept.append(place)
    base = plain(text)[4]
    scores = [CONFIDENCE[p[2]] for p in kept] + [PHRASE_SCORE] * bool(base)
    return ",".join(sorted({p[3] for p in kept} | set(filter(None, base.split(","))))), max(scores, default=0.0)


def test_labels_and_score_equal_a_walk_of_the_rules(spark, make_docs):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = [t for t in texts if t and "icen" in t][:400]
    texts += [f"{a} {b}, {a}" for a, b in itertools.permutations(["MIT license", "GNU GPL version 3", "Apache License 2.0", "CC BY 4.0", "BSD style license", "licensed under the MIT license"], 2)]
    rows = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(make_docs(*enumerate(texts))).collect()}
    assert rows == {n: walked(text) for n, text in enumerate(texts)}


def test_many_places_of_one_text(make_docs):
    began = time.perf_counter()
    row = scan(make_docs((1, "all rights reserved, " * 30_000 + "MIT license"))).first()
    assert len(row["detections"]) == 30_001 and row["labels"] == "all-rights-reserved,mit" and row["last_word"] == 90_000
    assert [d["start"] for d in row["detections"]] == sorted(d["start"] for d in row["detections"])
    assert time.perf_counter() - began < 120
