"""The pipeline stage by stage and as a whole, against plain counterparts."""

from __future__ import annotations

import ast
import pathlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.decontaminate import Matcher, normalised
from tidemark.llm.queries import QUERIES
from tidemark.llm.secrets import findings, redacted
from tidemark.llm.simhash import fingerprint

ROOT = pathlib.Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"  # the smallest tables that hold secrets


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returned, as rows by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), "test-" + name.replace(" ", "-"))
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_each_stage_equals_its_plain_counterpart(spark, sf_dir, stages):
    documents, good, distinct, clean, redacted_rows, packed = stages
    model = quality.QualityModel(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
    scores = {r["doc_id"]: r["score"] for r in model.scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert sorted(good) == sorted(r for r in documents if scores[r["doc_id"]] >= quality.ACCEPTED) and len(good) < len(documents)

    prints, group = {r["doc_id"]: fingerprint(r["text"]) for r in good}, {}
    for doc in sorted(prints):  # smallest first: a search from each id not reached yet
        if doc not in group:
            reached = [doc]
            for at in reached:
                for other in prints:
                    if other not in group and (prints[other] ^ prints[at]).bit_count() <= 3:
                        group[other] = doc
                        reached.append(other)
    assert sorted(distinct) == sorted(r for r in good if group[r["doc_id"]] == r["doc_id"]) and len(distinct) < len(good)

    items = [(r["item_id"], normalised(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    matcher = Matcher(items, 0.06)
    assert sorted(clean) == sorted(r for r in distinct if not matcher.find(r["text"])) and len(clean) < len(distinct)

    before = by_id(clean)
    assert by_id(redacted_rows).keys() == before.keys()
    for doc, row in by_id(redacted_rows).items():
        assert row["text"] == redacted(before[doc]["text"]) and row["n_chars"] == len(row["text"])
        assert (row["lang"], row["source"]) == (before[doc]["lang"], before[doc]["source"])
        assert not [f for f in findings(row["text"]) if f.kind != "literal"]
    assert any(r["text"] != before[r["doc_id"]]["text"] for r in redacted_rows)

    assert {r["doc_id"] for r in packed} == before.keys()


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    drop = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert drop(corpus_pipeline.run(spark, sf_dir).collect()) == drop(stages[-1])


def test_odd_documents_pass_every_stage(spark, sf_dir, odd_docs, crowded):
    docs = crowded(odd_docs)
    rows = docs.count()
    for name, function in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, sf_dir), "odd")
        assert docs.columns == crowded(odd_docs).columns, name
    # ids 1, 2 and 3 hold no words, 4 and 5 the same; both rows without an id stay
    assert sorted(r["doc_id"] for r in docs.filter("doc_id IS NOT NULL").collect()) == [1, 4, 6, 7, 8] and rows == 11
    assert docs.filter("doc_id IS NULL").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).filter("piece = 0").count() == 7


def test_different_texts_of_one_doc_id_all_stay(spark, make_docs):
    docs = make_docs((1, "aa bb cc"), (1, "aa bb cc"), (1, "zz yy xx"), (2, "other words here"), (3, "zz yy xx"), (None, "aa bb cc"))
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.distinct_texts(spark, docs, "").collect()), key=repr)
    assert kept == [(1, "aa bb cc"), (1, "zz yy xx"), (2, "other words here"), (None, "aa bb cc")]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_table(spark, sf_dir, make_docs, stage):
    assert stage[1](spark, make_docs(), sf_dir).count() == 0


def test_registration():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("tidemark/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        names = {n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)}
        names |= {a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names}
        assert not [n for n in names if n.startswith(("tidemark.llm", "corpus_pipeline"))], path


def test_every_registered_operator_runs(spark, sf_dir):
    for name, query in QUERIES.items():
        assert query(spark, sf_dir).limit(1).count() <= 1, name
