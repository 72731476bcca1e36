"""Prefix trie of conversations as a burst trie.

A turn is known by its id, 128 bits of a digest of role and text, and a conversation by the row of its turn ids. Equal
rows collapse first. All of them then start in one suffix container under the root. A container of more than ``BURST``
different rows bursts: what all its rows share becomes a trie head (a chain of nodes without a branch), and the rows are
dealt to new containers by their next turn id. What is left in containers is sorted and swept into nodes, shard by shard;
the heads are finished from the sums of the containers below them.

Only ids and byte counts travel, no texts. A container is the work of one task and holds a bounded number of rows; the
sweep keeps one path and the finished siblings along it. A hot first turn bursts until its containers are small; copies of
a conversation are one row, their ids meet as joined blocks of ids, which are hashed as they stream by. A conversation
itself is one row of 16 bytes and one number a turn.

Nulls, ties, empties: a null role or text is the empty string. Rows without conv_id belong to no conversation and take no
part. Turns stand in the order of ``turn``, nulls first; equal turns by role, then by turn id; repeated rows are turns of
their own. Conversations without turns are members of the root. Extra columns are ignored. No conversations: no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, batch, empty_if_null, pick
from tidemark.operators.joins import salted_left_join
from tidemark.sources.staging import stage

ID_BYTES = 16
#: Different rows that a container may hold before it bursts.
BURST = 4096
#: Bursts of nested containers; what is still oversized then is swept as it is, which costs balance and nothing else.
ROUNDS = 64
#: Trie heads of a round that are broadcast, at under 100 bytes each; more of them are joined by a shuffle.
BROADCAST_HEADS = 10_000
#: Conversation ids that are joined to a text in one task.
ID_BLOCK = 4096
FLUSH_ROWS = 20_000

NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NODE_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
NODE_TYPES = (*[pa.int64()] * 7, pa.string())
NOBODY = hashlib.sha256().hexdigest()

SHARED = 5  # conversations that share the opening of the first of them
OPENING = 9  # an opening has fewer turns than this


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn) with turn as a struct that sorts as it should: turn, role, id, bytes."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    role, text = empty_if_null("role"), empty_if_null("text")
    # the length in front tells where the role ends
    turn_id = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID_BYTES)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), turn_id.alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("turn"),
    )


def _sequence(turns: Column) -> tuple[Column, Column]:
    ids = F.unhex(F.array_join(F.transform(turns, lambda t: t["id"]), ""))
    return ids.alias("path"), F.transform(turns, lambda t: t["bytes"]).alias("sizes")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): turn ids in order as one binary value, and the bytes of each turn's text."""
    whole = _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    return whole.select("conv_id", *_sequence(F.col("own")))


def branched_sequences(conversations: DataFrame) -> DataFrame:
    """The same of rebuilt conversations: the first h turns of conversation c - c % 5, then c's own behind its first h,
    with h = crc32(c) % 9. One shuffle puts the five side by side. Of negative ids the remainder is SQL's (-7 % 5 = -2)."""
    conv = F.col("conv_id")
    placed = _turns(conversations).withColumn("first_id", conv - conv % SHARED).repartition("first_id")
    whole = placed.groupBy("first_id", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    # at most nine conversations, around zero
    beside = whole.groupBy("first_id").agg(F.collect_list(F.struct("conv_id", "own")).alias("convs"))
    first = F.get(F.filter("convs", lambda c: c["conv_id"] == F.col("first_id")), F.lit(0))["own"]
    opening = F.pmod(F.crc32(conv.cast("string")), F.lit(OPENING)).cast("int")
    each = beside.select(F.slice(first, 1, OPENING - 1).alias("head"), F.inline("convs")).withColumn("h", opening)
    kept = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    rest = F.slice("own", F.col("h") + 1, F.size("own"))
    return each.select("conv_id", F.concat(kept, rest).alias("turns")).select("conv_id", *_sequence(F.col("turns")))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids in order of path and block to one row a path, with the digest of all its ids."""
    names = ["path", "sizes", "n", "conv", "ends"]
    types = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    rows: list[tuple] = []
    path = sizes = conv = digest = None
    n = 0
    for b in batches:
        for next_path, next_sizes, count, smallest, ids in zip(*(b.column(c).to_pylist() for c in ("path", "sizes", "n", "conv", "ids"))):
            if next_path == path:
                digest.update(b"," + ids.encode())
                n += count
                continue
            if path is not None:
                rows.append((path, sizes, n, conv, digest.hexdigest()))
            path, sizes, n, conv, digest = next_path, next_sizes, count, smallest, hashlib.sha256(ids.encode())
        if len(rows) >= FLUSH_ROWS:
            yield batch(names, types, list(zip(*rows)))
            rows = []
    if path is not None:
        rows.append((path, sizes, n, conv, digest.hexdigest()))
    if rows:
        yield batch(names, types, list(zip(*rows)))


def _distinct(rows: DataFrame) -> DataFrame:
    """One row a different sequence: its conversations' number, smallest id, and the digest of their ids in order."""
    blocks = rows.groupBy("path", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.first("sizes").alias("sizes"), F.sort_array(F.collect_list("conv_id")).alias("convs")
    )
    joined = blocks.select(
        "path", "block", "sizes", F.size("convs").cast("long").alias("n"), F.get("convs", F.lit(0)).alias("conv"),
        F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("ids"),
    )
    placed = joined.repartition("path").sortWithinPartitions("path", "block")
    return stage(arrow_map(placed, _hash_ends, "path binary, sizes array<long>, n long, conv long, ends string"), "conversations")


def _grow_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared turns of each bursting container, from its first and last row in order."""
    names = ["key", "top", "bottom", "n", "conv", "above", "heads", "chain", "ends"]
    types = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()]
    for b in batches:
        rows = []
        for row in b.to_pylist():
            low, high, top = row["low"]["path"], row["high"], row["top"]
            bottom = _shared(low, high, top)
            chain = [row["low"]["sizes"][d - 1] if d else 0 for d in range(top, bottom + 1)]
            ends = row["low"]["ends"] if len(low) == bottom * ID_BYTES else None
            rows.append((row["key"], top, bottom, row["n"], row["conv"], row["above"], row["heads"], chain, ends))
        if rows:
            yield batch(names, types, list(zip(*rows)))


HEAD_SCHEMA = "key string, top long, bottom long, n long, conv long, above long, heads array<string>, chain array<long>, ends string"


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Turns that both paths share, ``known`` of them known."""
    most = min(len(a), len(b)) // ID_BYTES
    while known < most and a[known * ID_BYTES : (known + 1) * ID_BYTES] == b[known * ID_BYTES : (known + 1) * ID_BYTES]:
        known += 1
    return known


def _burst(rows: DataFrame, burst: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows in their final containers, and the heads of each round.

    A container has the key of the prefix its rows share by construction, the depth ``top`` of that node, the smallest
    conversation ``above`` it, and the keys of the ``heads`` on the way to it, the nearest last.
    """
    open_rows = rows.withColumns(
        {"key": F.md5(F.substring("path", 1, 0)), "top": F.lit(0).cast("long"), "above": F.lit(None).cast("long"), "heads": F.array().cast("array<string>")}
    )
    settled: list[DataFrame] = []
    heads: list[DataFrame] = []
    for round_ in range(ROUNDS):
        heavy = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > burst).select("key")
        heavy = stage(heavy, f"heavy-{round_}")
        n_heavy = heavy.count()
        if not n_heavy:
            break
        few = n_heavy <= BROADCAST_HEADS
        bursting = open_rows.join(F.broadcast(heavy) if few else heavy, "key", "left_semi")
        ends = bursting.groupBy("key", "top").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.first("above").alias("above"), F.first("heads").alias("heads"),
            F.min(F.struct("path", "sizes", "ends")).alias("low"), F.max("path").alias("high"),
        )
        grown = stage(arrow_map(ends, _grow_heads, HEAD_SCHEMA), f"heads-{round_}")
        heads.append(grown)
        below = grown.select("key", F.col("bottom").alias("bottom"), F.col("conv").alias("head_conv"))
        met = open_rows.join(F.broadcast(below), "key", "left") if few else salted_left_join(open_rows, below, "key", F.col("path"))
        met = stage(met, f"containers-{round_}")
        settled.append(met.filter("bottom IS NULL").select(*open_rows.columns))
        next_key = F.md5(F.substring("path", F.lit(1), ((F.col("bottom") + 1) * ID_BYTES).cast("int")))
        open_rows = met.filter(F.col("bottom").isNotNull() & (F.octet_length("path") > F.col("bottom") * ID_BYTES)).select(
            *rows.columns, next_key.alias("key"), (F.col("bottom") + 1).alias("top"), F.col("head_conv").alias("above"),
            F.concat("heads", F.array("key")).alias("heads"),
        )
    return reduce(DataFrame.unionAll, settled, open_rows), heads


class _Node:
    __slots__ = ("depth", "conv", "n", "children", "leaves", "saved", "bytes", "ends", "waiting")

    def __init__(self, depth: int, size: int):
        self.depth, self.bytes = depth, size
        self.conv: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends = NOBODY
        self.waiting: list[_Node] = []

    def end_here(self, n: int, conv: int, ends: str) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.ends = ends

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.bytes

    def take(self, child: _Node) -> None:
        self.n += child.n
        self.conv = child.conv if self.conv is None else min(self.conv, child.conv)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved
        self.waiting.append(child)

    def row(self, parent: int | None) -> tuple:
        return (self.conv, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.ends)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers in order, each with its rows in order, to nodes. The top of a container carries the heads above it."""
    names, types = [*NODE_COLUMNS, "heads"], [*NODE_TYPES, pa.list_(pa.string())]
    rows: list[tuple] = []
    stack: list[_Node] = []
    key = path = above = heads = None

    def close_to(height: int) -> None:
        while len(stack) > height:
            node = stack.pop()
            node.close()
            rows.extend((*child.row(node.conv), None) for child in node.waiting)
            node.waiting = []
            if stack:
                stack[-1].take(node)
            else:
                rows.append((*node.row(above), heads))

    columns = ("key", "top", "path", "sizes", "n", "conv", "ends", "above", "heads")
    for b in batches:
        for next_key, top, next_path, sizes, n, conv, ends, next_above, next_heads in zip(*(b.column(c).to_pylist() for c in columns)):
            if next_key != key:
                close_to(0)
                key, above, heads = next_key, next_above, next_heads
                stack.append(_Node(top, sizes[top - 1] if top else 0))
                shared = top
            else:
                shared = _shared(path, next_path, top)
            path = next_path
            close_to(shared - top + 1)
            stack.extend(_Node(depth, sizes[depth - 1]) for depth in range(shared + 1, len(path) // ID_BYTES + 1))
            stack[-1].end_here(n, conv, ends)
            if len(rows) >= FLUSH_ROWS:
                yield batch(names, types, list(zip(*rows)))
                rows.clear()
    close_to(0)
    if rows:
        yield batch(names, types, list(zip(*rows)))


def _unroll_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each head's chain; only its last node has more than one child."""
    for b in batches:
        rows = []
        for row in b.to_pylist():
            saved, nodes = row["saved"], []
            for depth, size in reversed(list(enumerate(row["chain"], row["top"]))):
                saved += (row["n"] - 1) * size
                last = depth == row["bottom"]
                parent = row["above"] if depth == row["top"] else row["conv"]
                ends = (row["ends"] if last else None) or NOBODY
                nodes.append((row["conv"], depth, parent, row["n"], row["children"] if last else 1, row["leaves"], saved, ends))
            rows.extend(nodes)
        if rows:
            yield batch(NODE_COLUMNS, NODE_TYPES, list(zip(*rows)))


def prefix_trie(rows: DataFrame, burst: int = BURST) -> DataFrame:
    """Every node of the trie over (conv_id, path, sizes): smallest member, depth, the parent's smallest member, members,
    children, leaves and saved bytes below, and the digest of the ids of members that end there."""
    contained, heads = _burst(_distinct(rows), burst)
    placed = contained.repartition("key").sortWithinPartitions("key", "path")
    swept = arrow_map(placed, _sweep, f"{NODE_SCHEMA}, heads array<string>")
    if not heads:
        return swept.select(*NODE_COLUMNS)
    swept = stage(swept, "swept")
    grown = reduce(DataFrame.unionAll, heads)
    own = F.aggregate("chain", F.lit(0).cast("long"), lambda total, size: total + size) * (F.col("n") - 1)
    # what every container and every head adds to each of the heads above it
    tops = swept.filter("heads IS NOT NULL").select("heads", "n_leaves", "saved_tokens")
    parts = tops.unionAll(grown.select("heads", F.lit(0).cast("long"), own))
    dealt = parts.select(F.posexplode("heads").alias("place", "key"), F.size("heads").alias("height"), "n_leaves", "saved_tokens")
    below = dealt.groupBy("key").agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.count_if(F.col("place") == F.col("height") - 1).alias("children"),
    )
    head_nodes = arrow_map(grown.join(below, "key"), _unroll_heads, NODE_SCHEMA)
    return swept.select(*NODE_COLUMNS).unionAll(head_nodes)
