from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """Conversations by definition: conv_id to its rebuilt turns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {conv: [(t[2], t[4]) for t in sorted(turns)] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    return out


def brute_force(convs):
    members, children = {}, {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = 0 if node in children else 1
        for child in children.get(node, []):
            more = below(child)
            saved, leaves = saved + more[0], leaves + more[1]
        return saved, leaves

    rows = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(node)))
        saved, leaves = below(node)
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(who), len(node), parent, len(who), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def nodes(spark, rows, burst=trie.BURST):
    found = trie.prefix_trie(trie.branched_sequences(spark.createDataFrame(rows, SCHEMA)), burst)
    assert tuple(found.columns) == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def talk(seed, n, kinds, longest):
    """Conversations over few different turns, so that prefixes, whole copies and ends inside others are frequent."""
    dice = random.Random(seed)
    rows = []
    for conv in range(n):
        hot = dice.random() < 0.4
        for turn in range(dice.randint(1, longest)):
            word = "hot" if hot else f"t{dice.randrange(kinds)}"
            rows.append((conv, turn, "user" if turn % 2 else None, word * (turn + 1)))
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("burst", [1, 3, 20, trie.BURST])
def test_trie_equals_brute_force_whether_containers_burst_or_not(spark, burst):
    rows = talk(7, 150, 2, 9)
    assert nodes(spark, rows, burst) == brute_force(rebuilt(rows))


def test_one_long_chain_bursts_once(spark):
    """All conversations share thirty turns; the head takes them at one go, and ends inside the chain stay."""
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(12) for t in range(30)]
    rows += [(c * 5, 30, "user", f"own {c % 7}") for c in range(11)]
    assert nodes(spark, rows, 2) == brute_force(rebuilt(rows))


def test_many_copies_share_one_digest_of_their_ids(spark):
    rows = [(c * 5, 0, "user", "the same") for c in range(3 * trie.ID_BLOCK // 5)]
    assert nodes(spark, rows) == brute_force(rebuilt(rows))


def test_nulls_ties_empties_and_repeats(spark):
    rows = [
        (None, 0, "user", "nobody's"), (0, None, None, None), (0, 0, "", ""), (0, 0, "", ""), (0, 0, "a", "x"), (0, 0, "a", "y"), (1, 5, "user", "été 字"),
        (2, None, "user", "first"), (2, -3, "user", "second"), (-7, 0, "u", "negative"), (-6, 0, "u", "beside"), (10, 0, "ab", "c"), (15, 0, "a", "bc"), (11, 0, "u", None),
    ]
    # negative ids by SQL's remainder
    sql = {conv: turns for conv, turns in rebuilt([r for r in rows if r[0] is None or r[0] >= 0]).items()}
    own = {conv: [(r[2], r[3]) for r in rows if r[0] == conv] for conv in (-7, -6)}
    for conv, turns in own.items():
        base = conv + (-conv % 5)
        h = zlib.crc32(str(conv).encode()) % 9
        sql[conv] = own.get(base, [])[:h] + turns[h:]
    assert nodes(spark, rows) == brute_force(sql)


def test_no_conversations_no_nodes(spark):
    assert nodes(spark, []) == []


def test_extra_columns_are_ignored(spark, crowded):
    rows = talk(3, 20, 2, 4)
    extra = crowded(spark.createDataFrame(rows, SCHEMA))
    found = trie.prefix_trie(trie.branched_sequences(extra), 2).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_force(rebuilt(rows))


def test_plain_sequences_keep_all_turns(spark):
    rows = talk(5, 30, 3, 6)
    found = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA)), 4).collect()
    own = {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append((turn, role or "", text))
    assert sorted((tuple(r) for r in found), key=repr) == brute_force({c: [t[1:] for t in sorted(turns)] for c, turns in own.items()})
