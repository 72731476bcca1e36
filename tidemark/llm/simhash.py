"""Near duplicates by SimHash, found through a byte-position inverted index with count filtering.

A fingerprint of 64 bits is 8 bytes. Two fingerprints that differ in at most d bits differ in at most d bytes, so they
share at least 8 - d positional bytes. With d = 3, at least five. Lists of a single (position, byte) would each hold
1/256 of all fingerprints, so the index joins four positions at a time: the 14 sets of four positions whose numbers
XOR to zero form a Steiner system, in which every three positions lie outside exactly one set. Whichever three bytes
differ, one set is thus untouched, and an entry (set, its four bytes) holds 1 / 2^32 of unrelated fingerprints.
Within an entry the shared positional bytes of each pair are tallied, pairs below the guaranteed count are dropped and
the bit distance of the others is verified. Only links that join two parts of an entry leave the task.

Scale: equal fingerprints collapse before indexing. An entry larger than ``BLOCK`` is cut into blocks and every pair of
blocks goes to a task of its own, so no task ever holds an entry and no link is lost. Components are found on links
between distinct fingerprints by star contraction, see :mod:`tidemark.llm.components`.

Nulls and ties: a null text counts as empty; texts without words get the zero fingerprint and link like any other.
Rows without a doc_id are reported with a null component. Rows that share a doc_id are parts of one document: their
fingerprints are each linked to that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import arrow_map, batch, pick, texts_of
from tidemark.sources.staging import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BYTES = 8
#: Sets of four byte positions that XOR to zero: every three positions are avoided by exactly one of them.
QUADS = [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
BLOCK = 2048
ROWS_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of the text's word shingles, repeats included; the whole sequence where there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = [end - 1 for end in accumulate(len(word) + 1 for word in words)]
    starts = [0, *(end + 1 for end in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), ROWS_AT_ONCE):
        part = hashes[at : at + ROWS_AT_ONCE].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prints = np.array([fingerprint(text, shingle) for text in texts_of(rows.column(1))], np.uint64)
            yield batch(("doc_id", "bits"), (pa.int64(), pa.int64()), (rows.column(0), prints.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long, a row for each input row."""
    wanted = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return arrow_map(wanted, _fingerprint_batches(shingle), "doc_id long, bits long")


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def linked(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are within ``max_bits``: positional bytes are tallied first, only pairs with enough are verified."""
    differing = np.ascontiguousarray(left ^ right)
    shared = (differing.view(np.uint8).reshape(*differing.shape, BYTES) == 0).sum(axis=-1, dtype=np.uint8)
    found = shared >= BYTES - max_bits
    found[found] = np.bitwise_count(differing[found]) <= max_bits
    return found


class _Forest:
    """Union-find over a task's rows; remembers which links joined two trees."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _tile_links(bits: np.ndarray, ids: np.ndarray, own: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links of one tile as a forest: each row with the smallest id of its tree. ``own``: the row's block is the first."""
    order = np.argsort(ids, kind="stable")
    bits, ids, own = bits[order], ids[order], own[order]
    forest = _Forest(len(ids))
    first, second = np.flatnonzero(own), np.flatnonzero(~own)
    inside = len(second) == 0
    others = first if inside else second
    for k, i in enumerate(first):
        rest = others[k + 1 :] if inside else others
        if len(rest):
            for j in rest[linked(np.full(len(rest), bits[i]), bits[rest], max_bits)]:
                forest.join(int(i), int(j))
    for i in range(len(ids)):
        if (root := forest.root(i)) != i:
            yield int(ids[root]), int(ids[i])


def _link_batches(max_bits: int):
    """Rows come sorted by tile; small tiles are compared in whole batches, by shifting, large ones one by one."""
    small = 48

    def flush(rows: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
        tile, bits, ids, own = rows["tile"], rows["bits"], rows["id"], rows["own"]
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        sizes = np.diff(np.r_[starts, len(tile)])
        left, right = [], []
        size_of_row = np.repeat(sizes, sizes)
        few = size_of_row <= small
        longest = int(sizes[sizes <= small].max(initial=0))
        for shift in range(1, longest):
            at = np.flatnonzero(few[:-shift] & (tile[shift:] == tile[:-shift]))
            at = at[own[at] | own[at + shift]]
            at = at[linked(bits[at], bits[at + shift], max_bits)]
            left.append(ids[at]), right.append(ids[at + shift])
        for start, size in zip(starts[sizes > small], sizes[sizes > small]):
            cut = slice(start, start + size)
            pairs = np.array(list(_tile_links(bits[cut], ids[cut], own[cut], max_bits)), np.int64).reshape(-1, 2)
            left.append(pairs[:, 0]), right.append(pairs[:, 1])
        return np.concatenate(left or [ids[:0]]), np.concatenate(right or [ids[:0]])

    def out(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        left, right = flush(rows)
        return batch(("a", "b"), (pa.int64(), pa.int64()), (left, right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for part in batches:
            new = {n: part.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "bits", "id", "own")}
            new["bits"] = new["bits"].astype(np.int64).view(np.uint64)
            rows = new if kept is None else {n: np.concatenate([kept[n], new[n]]) for n in new}
            if not len(rows["tile"]):
                continue
            last = np.flatnonzero(rows["tile"] == rows["tile"][-1])[0]  # the last tile may go on
            kept = {n: v[last:] for n, v in rows.items()}
            if last:
                yield out({n: v[:last] for n, v in rows.items()})
        if kept is not None and len(kept["tile"]):
            yield out(kept)

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect whatever lies within ``max_bits`` among (id, bits); other pairs are left out where
    the links of one tile already connect them."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the sets of four positions guarantee distances up to 3 bits")
    sets = F.array(*(F.struct(F.lit(n).alias("quad"), F.col("bits").bitwiseAND(F.lit(_mask(q))).alias("bytes")) for n, q in enumerate(QUADS)))
    entries = pick(distinct, "id", "bits").select("id", "bits", F.explode(sets).alias("e")).select("id", "bits", "e.quad", "e.bytes")
    sizes = stage(entries.groupBy("quad", "bytes").agg(F.count("*").alias("size")).filter("size > 1"), "simhash-sizes")
    blocks = F.ceil(F.col("size") / block)
    tiles = (
        entries.join(sizes, ["quad", "bytes"])
        .withColumn("block", F.pmod(F.xxhash64("bits"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(
            "id",
            "bits",
            F.xxhash64("quad", "bytes", F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
            (F.col("block") <= F.col("other")).alias("own"),
        )
    )
    return arrow_map(tiles.repartition("tile").sortWithinPartitions("tile", "own", "id"), _link_batches(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``: the fingerprint as 16 hex digits, the component as
    the smallest doc_id that links of at most ``max_bits`` reach."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    distinct = stage(prints.groupBy("bits").agg(F.min("doc_id").alias("id")).filter("id IS NOT NULL"), "simhash-distinct")
    # the fingerprints of a doc_id that has several are linked to it
    several = prints.groupBy("doc_id").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).filter("low <> high")
    same_id = prints.join(several.select("doc_id"), "doc_id", "left_semi").join(distinct, "bits").select("id", "doc_id")
    groups = components(links(distinct, max_bits).unionAll(same_id))
    named = stage(
        distinct.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
            "bits", F.coalesce("component", "id").alias("component_id")
        ),
        "simhash-named",
    )
    hex_digits = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return prints.join(named, "bits", "left").select("doc_id", hex_digits, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` without near duplicates: of the rows whose fingerprints links of at most ``max_bits`` connect, the one of
    the smallest id stays, of several such rows the one of the smallest hash over all columns, once.

    Here the texts alone decide: rows that share an id are no parts of one document, so different texts under one id all
    stay. Rows without an id all stay.
    """
    row_hash = F.xxhash64(*(docs[c] for c in docs.columns))
    known = docs.filter(docs[id_col].isNotNull())
    wanted = known.select(known[id_col].cast("long").alias("doc_id"), known[text_col].alias("text"), row_hash.alias("row"))
    prints = stage(arrow_map(wanted, _keyed_batches(shingle), "doc_id long, row long, bits long"), "simhash-rows")
    first = prints.groupBy("bits").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    distinct = stage(first.withColumn("id", F.col("bits")), "simhash-texts")
    groups = components(links(distinct, max_bits)).withColumnRenamed("node", "id")
    named = stage(distinct.join(groups, "id", "left").select("bits", "first", F.coalesce("component", "id").alias("component")), "simhash-groups")
    stays = named.groupBy("component").agg(F.min("first").alias("stays"))
    decided = stage(named.join(stays, "component").select("bits", "stays"), "simhash-decided")
    rows = prints.groupBy("bits", "doc_id", "row").agg(F.count("*").alias("n")).join(decided, "bits")
    gone = F.struct("doc_id", "row") != F.col("stays")
    told = rows.filter(gone | (F.col("n") > 1)).select(F.col("doc_id").alias("told id"), F.col("row").alias("told row"), gone.alias("told gone"))
    told = stage(told, "simhash-told")
    # what goes grows with the table: by key at every size, the told rows hashed
    met = known.join(told.hint("shuffle_hash"), (known[id_col].cast("long") == told["told id"]) & (row_hash == told["told row"]), "left")
    once = met.filter(F.col("told gone").isNull()).select(*(known[c] for c in docs.columns))
    repeated = met.filter(~F.col("told gone")).select(*(known[c] for c in docs.columns)).distinct()  # equal rows meet before they move
    return once.unionAll(repeated).unionAll(docs.filter(docs[id_col].isNull()))


def _keyed_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prints = np.array([fingerprint(text, shingle) for text in texts_of(rows.column(1))], np.uint64)
            yield batch(("doc_id", "row", "bits"), (pa.int64(), pa.int64(), pa.int64()), (rows.column(0), rows.column(2), prints.view(np.int64)))

    return run
