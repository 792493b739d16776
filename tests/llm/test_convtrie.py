import hashlib
from collections import defaultdict
from zlib import crc32

import pytest

from evalmill.llm import convtrie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_by_conversation(rows):
    """rows (conv_id, turn, role, text); turns of one number by role and text's digest."""
    held = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            line = f"{len(role.encode())}:".encode() + role.encode() + text.encode()
            held[conv_id].append((turn is not None, turn or 0, hashlib.sha256(line).hexdigest()[:32], role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in held.items()}


def rebuild(held):
    out = {}
    for c, own in held.items():
        h = crc32(str(c).encode()) % 9
        out[c] = held.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(conversations):
    """Every node by its whole sequence of turns."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    return sorted(
        (
            m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string" + extra)


def test_query_equals_brute_force(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert result(convtrie.op13_conversation_trie(conversations)) == brute(rebuild(turns_by_conversation(rows)))


@pytest.fixture(scope="module")
def branching():
    """Few different turns, so that prefixes meet at all depths, some past several blocks."""
    rows = []
    for c in range(60):
        length = (c * 7) % 11 if c % 10 else 8 * (c // 10) + c % 3
        rows += [(c, d, "user", f"é{(c // (1 + d % 4)) % (2 if d < 3 or c % 10 == 0 else 3)}") for d in range(length)]
    rows += [(100 + c, d, "user", "same") for c in range(40) for d in range(20)]
    return rows + [(7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "eit"), (8, 1, "", "é0"), (8, 1, "", "é0")]


def test_tries_over_several_blocks(spark, branching):
    held = turns_by_conversation(branching)
    assert max(map(len, held.values())) > 3 * convtrie.BLOCK
    conversations = table(spark, branching)
    assert result(convtrie.conversation_trie(conversations)) == brute(held)
    assert result(convtrie.op13_conversation_trie(conversations)) == brute(rebuild(held))


def test_hot_conversations_in_pieces(spark, branching, monkeypatch):
    """Pieces and ranges of a few rows give the same trie."""
    monkeypatch.setattr(convtrie, "PIECE", 3)
    held = turns_by_conversation(branching)
    assert result(convtrie.conversation_trie(table(spark, branching))) == brute(held)


def test_odd_conversations(spark):
    rows = [
        (5, 0, "user", ""), (6, 0, None, None), (-3, 1, "a", "b"), (-5, 0, "a", "x" * 100_000), (-3, 0, "ab", ""),
        (None, 0, "user", "nobody's"), (2**62, 0, "user", "\x00\n漢字"), (11, 0, "u", "only turn"), (12, 1, "a", "bc"),
    ]
    odd = [r + (1, "x") for r in rows * 2]
    conversations = table(spark, odd, ", u int, key string")
    held = turns_by_conversation(rows * 2)
    assert result(convtrie.conversation_trie(conversations)) == brute(held)
    assert result(convtrie.op13_conversation_trie(conversations)) == brute(rebuild(held))
    empty = convtrie.op13_conversation_trie(conversations.limit(0))
    assert empty.count() == 0 and set(COLUMNS) == set(empty.columns)


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "t") for c in range(1, 5)]  # no conversation 0, so early turns are lost
    held = rebuild(turns_by_conversation(rows))
    assert any(not turns for turns in held.values())
    got = result(convtrie.op13_conversation_trie(table(spark, rows)))
    assert got == brute(held) and got[0][3] == 4
