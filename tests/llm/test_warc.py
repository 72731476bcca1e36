from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import PAGE_FIELD, archived, deduplicate_archives, from_pages, parse, read_archives, resolved, with_targets, write_archives

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/", "same"), (5, "http://b/", "same"), (3, "http://c/", "same"), (7, "http://d/", ""), (8, None, None), (9, "http://e\r\nX: y/", "ä字\U0001f600"),
    (10, "h", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (11, "h", "\n"), (12, "h", "\r\n"), (13, "h", "\r"), (14, "h", "long " * 300_000),
    (None, "n", "same"), (None, "n", "only without id"), (15, "t2", "tie"), (15, "t1", "tie"), (15, "t1", "tie"),
]


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def expected(pages):
    groups = defaultdict(list)
    for page in pages:
        groups[digest(page[2])].append(page)
    out = []
    for key, rows in groups.items():
        rows.sort(key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
        size = len((rows[0][2] or "").encode())
        out += [(r[0], size, key, "revisit" if n else "response", rows[0][0] if n else None) for n, r in enumerate(rows)]
    return sorted(out, key=repr)


def found(df):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture
def shared(tmp_path):
    return f"file://{tmp_path}"


def test_hard_payloads_come_back(spark, shared, crowded):
    pages = crowded(spark.createDataFrame(PAGES, SCHEMA))
    assert found(archived(pages, f"{shared}/a")) == expected(PAGES)
    rows = read_archives(spark, f"{shared}/a", with_payload=True).collect()
    assert all(r["intact"] for r in rows if r["record_type"] == "response")
    assert {r["payload"].decode() for r in rows if r["record_type"] == "response"} == {p[2] or "" for p in PAGES}
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    assert found(archived(pages)) == expected([tuple(r) for r in pages.collect()])


def test_many_rows_without_page(spark, shared):
    pages = spark.range(3000).selectExpr("CAST(NULL AS LONG) page_id", "IF(id % 3 = 0, NULL, concat('u', id % 7)) url", "'common' html")
    write_archives(from_pages(pages.repartition(5)), f"{shared}/a")
    records = read_archives(spark, f"{shared}/a").collect()
    assert len(records) == len({r["record_id"] for r in records}) == 3000
    (kept,) = (r for r in records if r["record_type"] == "response")
    assert kept["url"] is None and {r["refers_to"] for r in records} == {None, kept["record_id"]}
    plan = resolved(from_pages(pages))._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_revisits_name_address_and_date_of_their_original(spark, shared):
    write_archives(from_pages(spark.createDataFrame(PAGES[:3], SCHEMA)), f"{shared}/a", date="2024-05-06T07:08:09Z")
    lines = spark.read.option("lineSep", "\n").text(f"{shared}/a").select(F.col("value").cast("binary")).collect()
    fields = {f["warc-target-uri"]: f for f, _ in parse(bytes(r[0]) for r in lines)}
    for url in ("http://a/", "http://c/"):
        assert fields[url]["warc-refers-to"] == fields["http://b/"]["warc-record-id"]
        assert fields[url]["warc-refers-to-target-uri"] == "http://b/"
        assert fields[url]["warc-refers-to-date"] == fields["http://b/"]["warc-date"] == "2024-05-06T07:08:09Z"
    assert "warc-refers-to-target-uri" not in fields["http://b/"]


def test_small_payloads_are_kept(spark, shared):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], SCHEMA)
    kinds = {r["page_id"]: r["record_type"] for r in archived(pages, f"{shared}/a", min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archives_are_deduplicated_across_each_other(spark, shared):
    for name, pages in (("in/a", PAGES[:3]), ("in/b", [(20, "http://z/", "same"), (21, "http://y/", "new")])):
        write_archives(from_pages(spark.createDataFrame(pages, SCHEMA)), f"{shared}/{name}")
    deduplicate_archives(spark, f"{shared}/in/*", f"{shared}/out")
    rows = {r["page_id"]: r for r in with_targets(read_archives(spark, f"{shared}/out")).collect()}
    assert {p: (r["record_type"], r["refers_to"], r["payload_bytes"]) for p, r in rows.items()} == {
        1: ("revisit", 20, 4), 3: ("revisit", 20, 4), 5: ("revisit", 20, 4), 20: ("response", None, 4), 21: ("response", None, 3)
    }


def test_revisit_without_its_response_keeps_the_reference(spark, shared):
    write_archives(from_pages(spark.createDataFrame(PAGES[:2], SCHEMA)), f"{shared}/in")
    only = read_archives(spark, f"{shared}/in").filter("record_type = 'revisit'")
    told = only.first()["refers_to"]
    lost = only.selectExpr("page_id", "url", "'' payload", "digest", "0L payload_bytes", "false has_payload", "refers_to told")
    write_archives(lost, f"{shared}/out")
    row = read_archives(spark, f"{shared}/out").first()
    assert (row["record_type"], row["refers_to"]) == ("revisit", told)


def test_parser_reads_other_kinds_and_cut_records():
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n" + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    raw += b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"
    got = list(parse(iter(raw.split(b"\n"))))
    assert [(f.get("warc-type"), block) for f, block in got] == [("warcinfo", b"a\r\nb"), ("response", b""), (None, b"cut\n")]
    assert PAGE_FIELD.lower() not in got[0][0]


def test_empty_table(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0
