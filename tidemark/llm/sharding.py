"""Shards of nearly equal bytes that keep equal texts together: the minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of their digests. The smallest capacity with which a greedy pass
fits them into the shards is found by binary search, and the order is cut there. The order never reaches the driver: it
is seen as cells (digest prefixes) with their bytes, first 4,096 of them. What cells can prove about a capacity is taken
as bounds; the few cells in which a cut may lie are read again at a finer prefix, until every cell that matters holds one
group. So the capacity is exact, and the driver holds some ten thousand cells however many groups there are.

A greedy pass fills the first shards and may leave the last ones empty. The cuts therefore stand as near to equal shares
as that capacity allows: never before the place from which the rest wouldn't fit, never behind the place where the shard
overflows. A heavy group, larger than an equal share (there are fewer than shards), gets a shard of its own, and the shares
of the others are those of what is left.

Shards are digest ranges, so a document finds its shard by comparing its digest with the cuts: no join, and a text that
a third of all rows hold costs no task more than others. Places in a shard are numbered in slices of a hash.

Nulls, ties, empties: a null text counts as the empty one, of size 1, and both are one group. Rows are told apart by
doc_id, null included; repeated rows get a place each. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import empty_if_null, pick
from tidemark.sources.staging import stage

SHARDS = 8
#: Hex digits of the first cells, and how many more a cell is cut by.
FIRST_DIGITS, MORE_DIGITS = 3, 2
DIGEST_DIGITS = 32
BEHIND_ALL = "g"  # sorts behind every digest


class _Cells:
    """Non-empty digest ranges in order: prefix, bytes, groups, bytes of the largest group."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        rows = sorted(rows)
        self.prefixes = [r[0] for r in rows]
        self.groups = np.array([r[2] for r in rows], dtype=np.int64)
        self.largest = max(r[3] for r in rows)
        self.rows = rows
        #: Bytes before each boundary; boundary i is the start of cell i, the last one the end of all.
        self.before = np.concatenate([[0], np.cumsum(np.array([r[1] for r in rows], dtype=np.int64))])
        self.total, self.end = int(self.before[-1]), len(rows)

    def last_up_to(self, byte: int, late: bool) -> int:
        """The boundary at or before the last group start up to ``byte``; with ``late`` the boundary at or behind it."""
        i = int(np.searchsorted(self.before, byte, "right")) - 1
        inside = i < self.end and self.groups[i] > 1 and self.before[i] < byte
        return i + 1 if late and inside else i

    def first_from(self, byte: int, early: bool) -> int:
        """The boundary at or behind the first group start from ``byte`` on; with ``early`` the one at or before it."""
        i = int(np.searchsorted(self.before, max(byte, 0), "left"))
        inside = i > 0 and self.groups[i - 1] > 1 and self.before[i] > byte
        return i - 1 if early and inside else i

    def fits(self, capacity: int, shards: int, hopeful: bool) -> bool:
        """Whether a greedy pass needs no more than the shards: surely, or with ``hopeful`` perhaps."""
        i = 0
        for _ in range(shards - 1):
            i = self.last_up_to(int(self.before[i]) + capacity, late=hopeful)
        # the last shard takes the rest or doesn't, whatever its cells hold
        return int(self.before[i]) + capacity >= self.total

    def smallest_capacity(self, shards: int, hopeful: bool) -> int:
        low, high = max(self.largest, -(-self.total // shards)), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, hopeful) else (middle + 1, high)
        return low

    def wanted(self, place: int, shards: int, capacity: int, heavy: list[tuple[str, int]]) -> int:
        """The byte where the shard that begins at a boundary should end, with ``shards`` to come."""
        at = int(self.before[place])
        ahead = [(int(self.before[self.cell_of(digest)]), size) for digest, size in heavy]
        ahead = [(start, size) for start, size in ahead if start >= at]
        if ahead and ahead[0][0] == at:
            return at + ahead[0][1]
        rest, others = self.total - at - sum(size for _, size in ahead), shards - len(ahead)
        share = -(-rest // others) if others > 0 else capacity
        return min(at + share, ahead[0][0] if ahead else self.total)

    def cell_of(self, digest: str) -> int:
        return bisect_right(self.prefixes, digest) - 1

    def cuts(self, shards: int, heavy: list[tuple[str, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Cuts between the shards and all places they depend on, each as the boundaries that enclose it."""
        least, most = self.smallest_capacity(shards, hopeful=True), self.smallest_capacity(shards, hopeful=False)
        at = lambda i: int(self.before[i])
        # from behind: no cut may stand before the place from which the rest just fits
        earliest = [(self.end, self.end)]
        for _ in range(shards - 1):
            low, high = earliest[0]
            earliest.insert(0, (self.first_from(at(low) - most, early=True), self.first_from(at(high) - least, early=False)))
        greedy, chosen, seen = (0, 0), [(0, 0)], list(earliest)
        for k in range(1, shards):
            low, high = chosen[-1]
            ends = [self.wanted(place, shards - k + 1, most, heavy) for place in (low, high)]
            wanted = self.last_up_to(min(ends), late=False), self.last_up_to(max(ends), late=True)
            if low == high == wanted[0] < self.end:  # not even one group: take one
                wanted = low, max(low + 1, wanted[1])
                wanted = (low + 1, low + 1) if self.groups[low] == 1 else wanted
            furthest = (self.last_up_to(at(low) + least, late=False), self.last_up_to(at(high) + most, late=True))
            greedy = (self.last_up_to(at(greedy[0]) + least, late=False), self.last_up_to(at(greedy[1]) + most, late=True))
            chosen.append(tuple(min(max(w, e), f) for w, e, f in zip(wanted, earliest[k - 1], furthest)))
            seen += [wanted, furthest, greedy]
        return chosen[1:], seen

    def unclear(self, places: list[tuple[int, int]]) -> list[str]:
        """Cells of several groups that a place may lie in."""
        within = sorted({i for low, high in places for i in range(low, high) if self.groups[i] > 1})
        return [self.prefixes[i] for i in within]


def _read_cells(groups: DataFrame, prefix) -> list[tuple]:
    cells = groups.groupBy(prefix.alias("prefix")).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n"), F.max("total").alias("top"))
    return [tuple(row) for row in cells.filter("prefix IS NOT NULL").collect()]


def _finer(groups: DataFrame, cells: _Cells, prefixes: list[str]) -> _Cells:
    """Cut the given cells by two more digits: at most 256 new ones each."""
    wanted = F
    for digits in sorted({len(p) for p in prefixes}):
        hit = F.substring("digest", 1, digits).isin([p for p in prefixes if len(p) == digits])
        wanted = wanted.when(hit, F.substring("digest", 1, digits + MORE_DIGITS))
    dropped = set(prefixes)
    return _Cells([row for row in cells.rows if row[0] not in dropped] + _read_cells(groups, wanted))


def capacity_cuts(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """Digest prefixes at which the shards begin, without the first; ``groups`` has (digest, total bytes) per text."""
    rows = _read_cells(groups, F.substring("digest", 1, FIRST_DIGITS))
    if not rows:
        return [BEHIND_ALL] * (shards - 1)
    cells = _Cells(rows)
    large = groups.filter(F.col("total") * shards > cells.total).orderBy("digest").select("digest", "total")
    heavy = [(row["digest"], row["total"]) for row in large.collect()]  # fewer than shards
    while hidden := sorted({cells.prefixes[i] for digest, _ in heavy if cells.groups[i := cells.cell_of(digest)] > 1}):
        cells = _finer(groups, cells, hidden)
    while True:
        chosen, seen = cells.cuts(shards, heavy)
        unclear = cells.unclear(seen)
        if not unclear:
            return [(cells.prefixes + [BEHIND_ALL])[place] for place, _ in chosen]
        cells = _finer(groups, cells, unclear)


def byte_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: sizes are UTF-8 bytes plus one, slots count from 0."""
    text = empty_if_null("text")
    sized = pick(documents, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, DIGEST_DIGITS).alias("digest"),
    )
    sized = stage(sized, "sized")
    groups = stage(sized.groupBy("digest").agg(F.sum("size").alias("total")), "text-groups")
    cuts = capacity_cuts(groups, shards)
    shard = sum(((F.col("digest") >= cut).cast("int") for cut in cuts), F.lit(0)) if cuts else F.lit(0)
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))
    placed = sized.withColumns({"shard": shard, "place": order}).withColumn("slice", F.substring("place", 1, FIRST_DIGITS))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x 4,096 rows
    slices = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    slices = slices.select("shard", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "slice").orderBy("place", "doc_id")
    return placed.join(F.broadcast(slices), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.row_number().over(within) - 1 + F.col("ahead")).cast("long").alias("slot")
    )
