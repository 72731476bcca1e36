"""Best-fit packing of tokenized documents into sequences of bounded length, by minimum bin slack.

What fits together depends on lengths alone, and there are at most ``capacity`` of them. So the corpus is reduced to a
count per length, and the plan is made on that table: for the longest length left, a bitset subset-sum over the lengths
available finds the combination that leaves the least slack; it is taken as often as the counts allow and removed.
The plan's size is bounded by the capacity, not by the corpus.

Pieces are numbered per length where they are cut (task by task, the counts of earlier tasks added afterwards), and the
plan tells for each number of a length its sequence and place. A frequent length is thus spread over all tasks.

Nulls and ties: a null text counts as empty, an empty document is its end token alone. Rows with a null or repeated
doc_id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, batch, texts_of
from tidemark.llm.tokens import default_tokenizer, encoder
from tidemark.sources.staging import stage

CAPACITY = 2048
END_ID = 0
ID_BYTES = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _piece_batches(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        step, end = capacity * ID_BYTES, END_ID.to_bytes(ID_BYTES, "little")
        for rows in batches:
            docs, numbers, starts, lengths, sums, nth, kept = [], [], [], [], [], [], []
            for doc, ids in zip(rows.column(0).to_pylist(), encode(texts_of(rows.column(1)))):
                ids += end
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    length = len(part) // ID_BYTES
                    docs.append(doc), numbers.append(number), starts.append(at // ID_BYTES), lengths.append(length)
                    sums.append(zlib.crc32(part)), nth.append(seen[length])
                    seen[length] += 1
                    if keep_ids:
                        kept.append(part)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [docs, numbers, starts, lengths, sums, np.full(len(docs), task, np.int32), nth]
            if keep_ids:
                names, types, columns = [*names, "ids"], [*types, pa.binary()], [*columns, kept]
            yield batch(names, types, columns)

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The documents' ids, each with the end id, cut into pieces of at most ``capacity``; ``task`` and ``nth`` number
    the pieces of a length. With ``keep_ids`` the ids come along as little-endian 32-bit bytes."""
    wanted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    schema = PIECES + (", ids binary" if keep_ids else "")
    return arrow_map(wanted, _piece_batches(tokenizer or default_tokenizer(), capacity, keep_ids), schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) that fill ``room`` best, longer lengths first, by subset sums as bits of one integer."""
    mask, reached, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:  # powers of two stand for any number up to the count
            take = min(times, left)
            layers.append((length, take, reached))
            reached |= reached << (length * take) & mask
            left -= take
            times *= 2
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination, number of sequences): every length of ``counts`` is used as often as it occurs."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = dict(fullest(rest, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[length] // n for length, n in chosen.items())
        out.append((sorted(chosen.items(), reverse=True), times))
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


@dataclass(frozen=True)
class Places:
    """Where the n-th piece of a length goes: sorted runs of numbers, each with its first sequence and offset."""

    key: np.ndarray
    per_sequence: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    BITS = 48  # numbers of one length fit in these

    @classmethod
    def of(cls, plan: list[tuple[list[tuple[int, int]], int]]) -> Places:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for combination, times in plan:
            offset = 0
            for length, n in combination:
                start = used.get(length, 0)
                rows.append(((length << cls.BITS) + start, n, sequence, offset))
                used[length] = start + n * times
                offset += length * n
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*(np.ascontiguousarray(table[:, k]) for k in range(4)))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length << self.BITS) + number
        run = np.searchsorted(self.key, wanted, side="right") - 1
        k = wanted - self.key[run]
        return self.sequence[run] + k // self.per_sequence[run], self.offset[run] + k % self.per_sequence[run] * length


def _place_batches(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, number = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("length", "number"))
            sequence, offset = places.value.find(length, number)
            table = {n: rows.column(n) for n in rows.schema.names if n != "number"}
            table |= {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_pydict(table)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and the offset there instead of task and nth."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("pieces"))
    counts = stage(per_task, "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(Places.of(plan(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(
        counts.select("task", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before")), "packing-before"
    )
    numbered = pieces.join(before, ["task", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    kept = [name for name in pieces.columns if name not in ("task", "nth")]
    schema = ", ".join(f"{name} {dict(pieces.dtypes)[name]}" for name in kept) + ", sequence_id long, offset long"
    return arrow_map(numbered.select(*kept, "number"), _place_batches(places), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return pack_pieces(stage(token_pieces(docs, capacity, tokenizer, keep_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from :func:`pack` with ``keep_ids``. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
