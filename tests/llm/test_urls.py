from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from tidemark.llm.urls import ALPHABET, RULES, calibrated_cut, folded, judged, scored, verdicts, weights


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    ends = [tail.find(c) for c in "?#" if c in tail]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[: min(ends, default=len(tail))]


def plain_rule(url):
    host, path = plain_parts(url)
    fits = []
    for verdict, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


HARD = [
    None, "", "no scheme/net/", "http://net", "http://NET/", "http://a.Net?x/", "http://fnet/", "https://x.example.net/en/1", "https://example.net/en",
    "https://example.net/EN/", "ftp://a.b.example.com/de/x?y#z", "http://org/fr/", "http://a.org#/fr/", "http://a://b.net/", "://x.net/", "http:///net/",
    "http://É.net/ü", "http://a.net/\nx",
]


def test_parts_and_rules_are_the_definition(spark):
    pages = spark.createDataFrame(list(enumerate(HARD)), "page_id long, url string")
    for r in judged(pages).collect():
        assert (r["host"], r["path"]) == plain_parts(r["url"])
        assert (r["decided"] or (None, None))[::-1] == plain_rule(r["url"]), r


def plain_model(urls):
    """Weights by dictionaries; urls: (text, n, verdict)."""
    logs = {}
    grams = {text[i : i + 3] for text, _, _ in urls for i in range(len(text) - 2)}
    for side in ("allow", "block"):
        counts = Counter()
        for text, n, verdict in urls:
            if verdict == side:
                for i in range(len(text) - 2):
                    counts[text[i : i + 3]] += n
        tails = [Counter() for _ in range(4)]
        for gram, n in counts.items():
            for order in (1, 2, 3):
                tails[order][gram[3 - order :]] += n
        seen = [defaultdict(list) for _ in range(4)]
        for order in (1, 2, 3):
            for tail, n in tails[order].items():
                seen[order][tail[:-1]].append(n)
        for gram in grams:
            p = 1 / len(ALPHABET)
            for order in (1, 2, 3):
                tail = gram[3 - order :]
                if of := seen[order].get(tail[:-1]):
                    p = (tails[order][tail] + len(of) * p) / (sum(of) + len(of))
            logs[side, gram] = math.log(p)
    return {g: logs["allow", g] - logs["block", g] for g in grams}


def test_model_equals_dictionaries(spark, sf_dir):
    rows = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    urls = rows.select("url", "decided.verdict", folded(rows["url"]).alias("text")).selectExpr("url", "1L AS n", "verdict", "1L AS fold", "text")
    plain = [(r["text"], r["n"], r["verdict"]) for r in urls.collect()]
    assert all(set(t) <= set(ALPHABET) for t, _, _ in plain)
    expected = plain_model(plain)
    table = weights(urls)
    found = {r["gram"]: r["weight"] for r in table.collect()}
    assert found.keys() == expected.keys() and all(abs(found[g] - w) < 1e-9 for g, w in expected.items())
    texts = {r["url"]: r["text"] for r in urls.collect()}
    for r in scored(urls, table).collect():
        text = texts[r["url"]]
        assert abs(r["score"] - sum(expected[text[i : i + 3]] for i in range(len(text) - 2)) / (len(text) - 2)) < 1e-8


def test_cut_separates_best(spark):
    rows = [("a", 3, "allow", 0, 0.5), ("b", 1, "allow", 0, -0.2), ("c", 2, "block", 0, -0.5), ("d", 2, "block", 0, 0.1), ("e", 9, None, 0, 0.0), ("f", 9, "block", 1, 9.0)]
    schema = "url string, n long, verdict string, fold int, score double"
    assert calibrated_cut(spark.createDataFrame(rows, schema)) == pytest.approx(0.11)
    assert calibrated_cut(spark.createDataFrame(rows[:2], schema)) is None


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = verdicts(pages).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        rule, verdict = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (*plain_parts(urls[r["page_id"]]), rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_plan_is_native(spark, sf_dir):
    plan = verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_pages(spark, crowded):
    odd = spark.createDataFrame([*enumerate(HARD), (None, None), (None, "http://a.net/"), (3, "http://net")], "page_id long, url string")
    rows = verdicts(crowded(odd)).collect()
    assert len(rows) == odd.count() and {r["verdict"] for r in rows} <= {"allow", "block"}
    undecided = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    assert {(r["verdict"], r["score"]) for r in verdicts(undecided).collect()} == {("allow", None)}
    assert verdicts(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hosts", [3, 1])
def test_few_hosts_still_get_a_model(spark, hosts):
    """Whatever folds the few hosts fall into: the undecided URLs look like the blocked ones and are blocked."""
    for salt in range(4 if hosts == 3 else 1):
        rows = [(i, f"http://bad{salt}.net/win/casino/{i}") for i in range(50)]
        rows += [(100 + i, f"http://good{salt}.org/fr/library/poem/{i}") for i in range(50)]
        rows += [(200 + i, f"http://other{salt if hosts == 3 else ''}.com/win/casino/{7 * i}") for i in range(5)]
        found = {r["page_id"]: r for r in verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
        assert {found[i]["verdict"] for i in range(200, 205)} == {"block"}
        assert all(r["score"] is not None for r in found.values())
