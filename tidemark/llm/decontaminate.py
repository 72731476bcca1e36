"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with runs of white space as one space. An item of m characters may be found with up to
k = ``ERROR_RATE`` x m edits. Cut into k + 1 pieces, at least one of them survives any k edits, so every hit shows up as
an exact piece: the pieces of all items sit in one Aho-Corasick automaton that reads each whole text once. Around each
piece hit, the item is verified with Myers' bit-parallel distance, free to begin and end anywhere in the window. Where
pieces that many items share open many windows, a window is verified only if it holds enough stretches of five letters
of its item: k edits spoil at most 5 k of them. The bound loses no match.

Scale: the benchmark is cut by its measured size into parts of about ``PART_CHARS`` characters, each broadcast and
matched against all texts in turn, so what is broadcast is bounded however large the benchmark grows. What one part
gives is written before the next one is broadcast: one part is held at a time, by one Python worker a task. Texts stay
where they are read: no shuffle.

Nulls and ties: null texts count as empty; empty items match nothing. Items of equal normalised text count as one, under
the smallest item_id. An item without an error budget has to stand between word ends. Of several places of an item in a
text the one with the fewest edits is reported, the first of equals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, batch, texts_of
from tidemark.sources.staging import stage

ERROR_RATE = 0.06
PART_CHARS = 4 << 20
#: Letters of the stretches that are counted before a window is verified.
GRAM = 5
#: Up to this many windows are verified without counting first; only time depends on it.
FEW = 8
#: Piece hits times owners, or grams, that are worked on at once; only memory depends on it.
HELD = 1 << 18


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): the item in errors + 1 pieces of about equal length."""
    cuts = [len(item) * n // (errors + 1) for n in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for place, letter in enumerate(item):
        masks[letter] = masks.get(letter, 0) | 1 << place
    return masks


def best_match(masks: dict[str, int], length: int, window: str, errors: int) -> tuple[int, int] | None:
    """(edits, end): the fewest edits between the item and any stretch of ``window``, and where the first such ends."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, edits, found = full, 0, length, None
    for end, letter in enumerate(window, 1):
        same = masks.get(letter, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rises, falls = (down | ~(across | up)) & full, up & across
        if rises & top:
            edits += 1
        elif falls & top:
            edits -= 1
        rises, falls = rises << 1 & full, falls << 1 & full
        up, down = (falls | ~(vertical | rises)) & full, rises & vertical
        if edits <= errors and (found is None or edits < found[0]):
            found = edits, end
            if not edits:
                break
    return found


def gram_hashes(text: str) -> np.ndarray:
    """A 32-bit number for each stretch of ``GRAM`` letters, in order."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = max(0, len(letters) - GRAM + 1)
    mixed = np.zeros(count, np.uint64)
    for place in range(GRAM):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + letters[place : place + count]
    return (mixed >> np.uint64(32)).astype(np.uint32)


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of runs of the given sizes, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


class Matcher:
    """Finds a part of the benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = items
        self.errors = [int(error_rate * len(text)) for _, text in items]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for start, piece in pieces(text, self.errors[n]):
                places.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(places):
            self.automaton.add_word(piece, (len(piece), number, len(places[piece])))
        self.automaton.make_automaton()
        # the owners of a piece and its places in them are one run of these arrays
        owners = np.array([pair for where in places.values() for pair in where], np.int64).reshape(-1, 2)
        self.owner, self.start = owners[:, 0], owners[:, 1]
        self.owners = np.array([len(where) for where in places.values()], np.int64)
        self.first = np.cumsum(self.owners) - self.owners
        self.budget = np.array(self.errors, np.int64)
        self.length = np.array([len(text) for _, text in items], np.int64)
        grams = [gram_hashes(text) for _, text in items]
        self.grams = np.concatenate([np.empty(0, np.uint32), *grams])
        self.gram_count = np.array([len(g) for g in grams], np.int64)
        self.gram_first = np.cumsum(self.gram_count) - self.gram_count

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of each item found, places in the normalised text; start is where the first
        letter stands if the edits lie behind it."""
        if not self.items:
            return []
        text = normalised(text)
        best: dict[int, tuple[int, int, int]] = {}
        at, numbers, held = [], [], 0
        for last, (size, number, owners) in self.automaton.iter(text):
            at.append(last + 1 - size)
            numbers.append(number)
            held += owners
            if held >= HELD:
                self._verify(text, at, numbers, best)
                at, numbers, held = [], [], 0
        if at:
            self._verify(text, at, numbers, best)
        return [(self.items[n][0], *best[n]) for n in sorted(best)]

    def _windows(self, at: list[int], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(item, step) of the windows that piece hits open, by item and place; hits of one item that shift by less than
        its budget share a window."""
        number = np.array(numbers)
        sizes = self.owners[number]
        own = _runs(self.first[number], sizes)
        item = self.owner[own]
        step = (np.repeat(np.array(at), sizes) - self.start[own]) // (self.budget[item] + 1)
        low, span = step.min(), step.max() - step.min() + 1
        keys = np.unique(item * span + (step - low))
        return keys // span, keys % span + low

    def _promising(self, text: str, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which windows hold as many of the item's grams as any match within the budget must: an edit touches at most
        ``GRAM`` of them. Windows that lie together share one table of the grams there, which can only overestimate."""
        scale = np.ceil(np.log2(np.maximum(high - low, 4 * GRAM))).astype(np.int64)
        area = low >> scale
        areas = area.max() + 1
        pairs, which = np.unique((scale * areas + area) * len(self.items) + item, return_inverse=True)
        where, owner = np.divmod(pairs, len(self.items))
        met = np.empty(len(pairs), np.int64)
        for rows in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(where)) + 1):
            size, place = divmod(int(where[rows[0]]), int(areas))
            here = np.zeros(1 << (size + 5), bool)
            mask = np.uint32(len(here) - 1)
            # a window begins in its area and is no longer than one
            here[gram_hashes(text[place << size : (place + 2) << size]) & mask] = True
            for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(self.gram_count[owner[rows]]) // HELD)) + 1):
                sizes = self.gram_count[owner[some]]
                seen = here[self.grams[_runs(self.gram_first[owner[some]], sizes)] & mask]
                ends = np.cumsum(sizes)
                total = np.concatenate([[0], np.cumsum(seen)])
                met[some] = total[ends] - total[ends - sizes]
        return met[which] >= self.gram_count[item] - GRAM * self.budget[item]

    def _verify(self, text: str, at: list[int], numbers: list[int], best: dict[int, tuple[int, int, int]]) -> None:
        """Adds to ``best`` what is found around piece hits: (edits, start, end) by item."""
        item, step = self._windows(at, numbers)
        low = np.maximum(0, step * (self.budget[item] + 1) - self.budget[item])
        high = np.minimum(len(text), (step + 1) * (self.budget[item] + 1) + self.length[item] + self.budget[item])
        if len(item) > FEW:
            kept = self._promising(text, item, low, high)
            item, low, high = item[kept], low[kept], high[kept]
        for n, low, high in zip(item.tolist(), low.tolist(), high.tolist()):
            item, errors = self.items[n][1], self.errors[n]
            if n in best and not best[n][0]:
                continue
            if not errors:
                at = text.find(item, low, high)
                edges = text[at - 1 : at] + text[at + len(item) : at + len(item) + 1]
                if at >= 0 and not any(map(str.isalnum, edges)):
                    best[n] = 0, at, at + len(item)
                continue
            if (at := text.find(item, low, high)) >= 0:  # the common case of an exact copy
                best[n] = 0, at, at + len(item)
                continue
            if n not in self.masks:
                self.masks[n] = letter_masks(item)
            if match := best_match(self.masks[n], len(item), text[low:high], errors):
                edits, end = match
                if n not in best or edits < best[n][0]:
                    best[n] = edits, max(0, low + end - len(item)), low + end


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items, error_rate: float) -> Matcher:
    """The worker's automaton for a part; built once per worker, the last part's goes."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, error_rate)
    return _MATCHERS[key]


def parts_of(items: DataFrame, part_chars: int = PART_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct texts in parts of about ``part_chars`` characters, dealt by the texts' hash."""
    one = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text"))
    distinct = one.groupBy("text").agg(F.min("item_id").alias("item_id")).filter("text <> ''")
    chars = distinct.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // part_chars)
    for part in range(parts):
        rows = distinct.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()  # part_chars in the mean
        ids: dict[str, int] = {}
        for row in rows:
            if text := normalised(row["text"]):
                known = [i for i in (ids.get(text), row["item_id"]) if i is not None]
                ids[text] = min(known, default=None)
        yield [(i, text) for text, i in ids.items()]


def _hit_batches(key: str, items, error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(key, items, error_rate).find
        names, types = ("doc_id", "item_id", "edits", "start", "end"), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for rows in batches:
            hits = [(doc, *hit) for doc, text in zip(rows.column(0).to_pylist(), texts_of(rows.column(1))) for hit in find(text)]
            yield batch(names, types, list(zip(*hits)) or [[]] * len(names))

    return run


def _clean_batches(key: str, items, error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(key, items, error_rate).find
        for rows in batches:
            yield rows.filter(pa.array([not find(text) for text in texts_of(rows.column("text"))], pa.bool_()))

    return run


def _broadcast_parts(spark: SparkSession, items: DataFrame, part_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """Each part as a broadcast, and whether it is the last. All others are gone when the next one is asked for."""
    parts = parts_of(items, part_chars)
    part = next(parts, None)
    while part is not None:
        following = next(parts, None)
        shared = spark.sparkContext.broadcast(part)
        yield shared, following is None
        if following is not None:
            shared.destroy()
        part = following


def benchmark_hits(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each benchmark item found in a document, places in the normalised text."""
    schema = "doc_id long, item_id long, edits int, start long, end long"
    wanted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    found = None
    for shared, last in _broadcast_parts(docs.sparkSession, items, part_chars):
        hits = arrow_map(wanted, _hit_batches(uuid.uuid4().hex, shared, error_rate), schema)
        hits = hits if last else stage(hits, "benchmark-hits")
        found = hits if found is None else found.unionAll(hits)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_benchmark(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    for shared, last in _broadcast_parts(docs.sparkSession, items, part_chars):
        kept = arrow_map(docs, _clean_batches(uuid.uuid4().hex, shared, error_rate), docs.schema)
        docs = kept if last else stage(kept, "benchmark-free")
    return docs
