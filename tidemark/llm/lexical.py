"""Ranked lexical search over bit-sliced Bloom signatures.

``index_blocks`` cuts the documents into blocks of documents of like size. A document's signature is a Bloom filter of its
terms, with an entry for each power of two that the term's count reaches; a block stores the signatures of its documents
slice by slice, so that the slices of a term, combined by AND, are a bitmap over the documents that may hold it. Bitmaps
overestimate presence and never miss it. A term's largest possible part in the score of each document, by the count level
its bitmaps allow and the document's length, is summed over the query's slices: an upper bound of the score. Documents
whose bound is below the tenth best score known so far are provably no result; all others are scored exactly from their
whole text. Results of the tasks meet as ten rows an item and task.

The index depends on the documents only. Queries go through it in parts of bounded size (``PART_TERMS``), so what a task
is given doesn't grow with the benchmark; a task works on one block at a time, and a block is bounded in bytes but for
a single long document.

Nulls, ties, empties: a null text has no terms. Documents without terms are no results and don't count. Every row is a
document; of equal scores the smaller doc_id comes first, null last. Items with a null id are ranked like others; items
without terms have no results; rows that share an item_id are ranked as items of their own. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, batch, pick
from tidemark.sources.staging import stage

TOP = 10
#: Entries of a signature get so many bits each and set so many.
BITS_PER_ENTRY, HASHES = 12, 4
#: Count levels 2^0 to 2^6; a count beyond the last level is bounded by the document's length.
LEVELS = 7
LEAST_WIDTH = 256
#: Most rows, cells of the bit matrix and bytes of text of a block, unless it has one document.
BLOCK_ROWS, BLOCK_CELLS, BLOCK_BYTES = 1024, 1 << 23, 2 << 20
#: Bytes of text that are cut into terms at a time.
CHUNK_BYTES = 4 << 20
#: Terms of the items that are sent to tasks at once, and of those looked up in a block at once.
PART_TERMS, CHUNK_TERMS = 200_000, 4096

#: Characters of terms are ASCII digits and letters and all beyond ASCII; only A-Z is lower-cased.
_SEPARATORS = bytes(c for c in range(128) if not (chr(c).isalnum()))
_FOLD = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
INDEX_SCHEMA = (
    "doc_ids array<long>, lengths array<long>, texts array<binary>, width int, slices binary, terms array<binary>, counts array<long>"
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms in order of a text in UTF-8."""
    return text.translate(_FOLD).lower().split()


class _Numbers(dict):
    """Terms to numbers in order of their first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(term) for term in terms), dtype=np.uint64, count=len(terms))


def _positions(hashes: np.ndarray, levels: np.ndarray | int, width: int) -> np.ndarray:
    """The slices of each entry, as (entries, HASHES); ``width`` is a power of two."""
    mixed = hashes ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(levels, dtype=np.uint64) + np.uint64(1)))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((mixed[:, None] + steps * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


def _cut_blocks(widths: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, rows) of each block: rows of one width, few enough."""
    for width in np.unique(widths):
        rows, cells, size = [], 0, 0
        for row in np.flatnonzero(widths == width):
            if rows and (len(rows) == BLOCK_ROWS or cells + width > BLOCK_CELLS or size + sizes[row] > BLOCK_BYTES):
                yield int(width), np.array(rows)
                rows, cells, size = [], 0, 0
            rows.append(row)
            cells += int(width)
            size += sizes[row]
        yield int(width), np.array(rows)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of a batch, a bounded number of bytes at a time."""
    sizes = [size or 0 for size in pc.binary_length(b.column("text")).to_pylist()]
    first = held = 0
    for row, size in enumerate([*sizes, CHUNK_BYTES]):
        if row > first and held + size > CHUNK_BYTES:
            part = b.slice(first, row - first)
            yield part.column("doc_id").to_pylist(), [text or b"" for text in part.column("text").cast(pa.binary()).to_pylist()]
            first, held = row, 0
        held += size


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs, bins = pa.list_(pa.int64()), pa.list_(pa.binary())
    names = ["doc_ids", "lengths", "texts", "width", "slices", "terms", "counts"]
    types = [longs, longs, bins, pa.int32(), pa.binary(), bins, longs]
    with np.errstate(over="ignore"):
        for b in batches:
            for ids, texts in _chunks(b):
                for values in _signed(ids, texts):
                    yield batch(names, types, [[value] for value in values])


def _signed(ids: list, texts: list[bytes]) -> Iterator[tuple]:
    """Blocks of some documents; the first one also says how many of all these documents hold each term."""
    numbers = _Numbers()
    each = [np.fromiter(map(numbers.__getitem__, terms_of(text)), dtype=np.int64) for text in texts]
    held = [row for row, found in enumerate(each) if len(found)]
    if not held:
        return
    ids, texts, each = ([column[row] for row in held] for column in (ids, texts, each))
    lengths, kinds = np.array([len(found) for found in each]), len(numbers)
    # a key for each (document, term) and how often it occurs
    keys, tf = np.unique(np.concatenate(each) + np.repeat(np.arange(len(each)) * kinds, lengths), return_counts=True)
    docs, terms = keys // kinds, keys % kinds
    levels = np.minimum(np.log2(tf).astype(np.int64), LEVELS - 1) + 1
    entries = np.bincount(docs, weights=levels, minlength=len(each)).astype(np.int64)
    widths = np.maximum(1 << np.ceil(np.log2(entries * BITS_PER_ENTRY)).astype(np.int64), LEAST_WIDTH)
    hashes, starts = _hashes(numbers), np.searchsorted(docs, np.arange(len(each) + 1))
    vocabulary, counts = list(numbers), np.bincount(terms, minlength=kinds).tolist()
    for width, rows in _cut_blocks(widths, [len(text) for text in texts]):
        part = np.concatenate([np.arange(starts[row], starts[row + 1]) for row in rows])
        column = np.repeat(np.arange(len(rows)), starts[rows + 1] - starts[rows])
        entry = np.repeat(np.arange(len(part)), levels[part])
        level = np.arange(len(entry)) - np.repeat(np.cumsum(levels[part]) - levels[part], levels[part])
        bits = np.zeros((width, -(-len(rows) // 8) * 8), dtype=bool)
        bits[_positions(hashes[terms[part]][entry], level, width), column[entry][:, None]] = True
        slices = np.packbits(bits, axis=1).tobytes()
        yield [ids[row] for row in rows], lengths[rows].tolist(), [texts[row] for row in rows], width, slices, vocabulary, counts
        vocabulary, counts = [], []


def index_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of documents with terms: ids, numbers of terms, texts, signature slices, and how many documents hold each term (of
    several blocks together, with the first of them)."""
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(arrow_map(docs, _index, INDEX_SCHEMA), "signatures")


def _weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_part(tf: int, m: int) -> int:
    """What a term of weight one adds to the score of a document of length figure ``m`` that holds it ``tf`` times."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Searcher:
    """The best rows of each item over the blocks of one task."""

    def __init__(self, items: list[dict[bytes, int]], n_docs: int, n_terms: int):
        self.items, self.n_docs, self.n_terms = items, n_docs, n_terms
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in items]
        self.chunks = []
        first = 0
        while first < len(items):
            numbers, last = _Numbers(), first
            while last < len(items) and (last == first or len(numbers) + len(items[last]) <= CHUNK_TERMS):
                for term in items[last]:
                    numbers[term]
                last += 1
            where = [(np.array([numbers[t] for t in item], dtype=np.int64), np.array(list(item.values()), dtype=np.float64)) for item in items[first:last]]
            self.chunks.append((first, where, _hashes(numbers)))
            first = last

    def bounds(self, hashes: np.ndarray, slices: np.ndarray, lengths: list[int], ms: list[int]) -> np.ndarray:
        """Most that each term, at weight one, can add to each document of the block."""
        rows, width = len(lengths), len(slices)
        bound = np.zeros((len(hashes), rows))
        maybe = np.ones((len(hashes), rows), dtype=bool)
        for level in range(LEVELS):
            found = np.bitwise_and.reduce(slices[_positions(hashes, level, width)], axis=1)
            maybe &= np.unpackbits(found, axis=1, count=rows).view(bool)
            if not maybe.any():
                break
            last = level == LEVELS - 1
            most = [term_part(n if last else min(n, (2 << level) - 1), m) for n, m in zip(lengths, ms)]
            np.copyto(bound, np.array(most, dtype=np.float64), where=maybe)
        return bound

    def block(self, ids: list[int | None], lengths: list[int], texts: list[bytes], slices: np.ndarray) -> None:
        ms = [10 + 90 * n * self.n_docs // self.n_terms for n in lengths]
        counted: dict[bytes, Counter] = {}
        for first, where, hashes in self.chunks:
            bound = self.bounds(hashes, slices, lengths, ms)
            for number, (terms, weights) in enumerate(where, first):
                self.rescore(number, weights @ bound[terms], ids, texts, ms, counted)

    def rescore(self, number: int, bound: np.ndarray, ids: list, texts: list[bytes], ms: list[int], counted: dict[bytes, Counter]) -> None:
        """Score exactly, highest bound first, whatever may still be among the best. Bounds are whole numbers below
        2^53, so that sums of doubles are exact."""
        best, item = self.best[number], self.items[number]
        least = best[0][0] if len(best) == TOP else 1
        rows = np.flatnonzero(bound >= least)
        for row in rows[np.argsort(-bound[rows], kind="stable")].tolist():
            if len(best) == TOP and bound[row] < best[0][0]:
                return
            text = texts[row]
            counts = counted.get(text)
            if counts is None:
                counts = counted[text] = Counter(terms_of(text))
            score = sum(w * term_part(counts[t], ms[row]) for t, w in item.items() if t in counts)
            if score > 0:
                found = (score, 0, -ids[row]) if ids[row] is not None else (score, -1, 0)
                if len(best) < TOP:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def _search(index: DataFrame, items: list[dict[bytes, int]], n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): the best rows of each task for each item, items by their place in the list."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            searcher = _Searcher(items, n_docs, n_terms)
            for b in batches:
                for row in range(b.num_rows):
                    ids, lengths, texts, width, slices = (b.column(c)[row].as_py() for c in ("doc_ids", "lengths", "texts", "width", "slices"))
                    searcher.block(ids, lengths, texts, np.frombuffer(slices, dtype=np.uint8).reshape(width, -1))
        found = [(n, None if null else -negated, score) for n, best in enumerate(searcher.best) for score, null, negated in best]
        if found:
            yield batch(["item", "doc_id", "score"], [pa.int64()] * 3, list(zip(*found)))

    blocks = index.select("doc_ids", "lengths", "texts", "width", "slices")
    return arrow_map(blocks, search, "item long, doc_id long, score long")


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item by exact scores, best first."""
    if top > TOP:
        raise ValueError(f"at most {TOP} documents an item")
    spark = documents.sparkSession
    index = index_blocks(documents)
    totals = index.agg(
        F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)), F.lit(0)).alias("terms"),
    ).first()
    texts = pick(items, "item_id", "text").filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    wanted = stage(arrow_map(texts, _item_terms, "item_id long, terms array<binary>"), "item-terms")
    load = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    if not load or not totals["docs"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = wanted.select(F.explode("terms").alias("term")).distinct()
    held = index.select(F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term")
    holders = held.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("counts").alias("df"))
    numbered = stage(wanted.withColumn("number", F.monotonically_increasing_id()), "numbered-items")
    weighed = numbered.select("item_id", "number", F.explode("terms").alias("term")).join(holders, "term")
    item = weighed.groupBy("number", "item_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    parts = -(-load // part_terms)
    item = stage(item.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts))), "items")
    found = []
    for part in range(parts):
        rows = item.filter(F.col("part") == part).select("item_id", "terms").collect()
        if not rows:
            continue
        weights = [{bytes(t["term"]): w for t in row["terms"] if (w := _weight(t["df"], totals["docs"]))} for row in rows]
        names = spark.createDataFrame([(n, row["item_id"]) for n, row in enumerate(rows)], "item long, item_id long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        merged = _search(index, weights, totals["docs"], totals["terms"]).withColumn("rank", F.row_number().over(order))
        kept = merged.filter(F.col("rank") <= top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found.append(kept if parts == 1 else stage(kept, "found"))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms = [sorted(set(terms_of(text))) for text in b.column("text").cast(pa.binary()).to_pylist()]
        yield batch(["item_id", "terms"], [pa.int64(), pa.list_(pa.binary())], [b.column("item_id"), terms])
