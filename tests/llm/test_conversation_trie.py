"""The prefix trie against one that puts every conversation together."""

import hashlib
import zlib
from random import Random

import pytest

from cueloom.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, fa int, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, n, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    members = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole = tuple(own.get(base, [])[:h] + x[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole) == d))
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    for node, own_members in members.items():
        ids = ",".join(map(str, sorted(c for c, ends in own_members if ends)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in own_members), len(node), parent, len(own_members), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def rows_of(seed, convs, words="ab"):
    rng = Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 2, 3, 5, 7, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "user", None]), rng.choice([*words, "é😀" * 3, "", None]), 7, "clash"))
    return rows + [(None, 0, "user", "a", 7, "clash")]


def test_nodes_equal_plain_trie(spark):
    rows = rows_of(1, [*range(40), *range(95, 140), 205, 303, 404, -3, -100, -150, 10**15, 10**15 + 7])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(trie.prefix_nodes(frame)) == brute(rows)


def test_long_conversations_are_spread(spark, monkeypatch):
    rng = Random(2)
    long = [(7, t, "user", f"turn {t % 11}", 7, "") for t in range(5000)] + [(8, t, "user", f"turn {t % 11}", 7, "") for t in range(3000)]
    rows = [*long, *rows_of(3, range(30)), *[(9, None, "user", rng.choice("xyz"), 7, "") for _ in range(60)], *[(9, 5, rng.choice("pq"), "x" * 70 + "y" * (t % 2), 7, "") for t in range(40)]]
    monkeypatch.setattr(trie, "BLOCK", 64)
    rows = [r for r in rows if r[0] != 9 or r[1] is None]
    assert found(trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_copies_and_common_heads(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    rows = [(c, t, "user" if t % 2 else "assistant", f"same {t}", 7, "") for c in range(500, 800) for t in range(4)] + [(c, t, "user", f"own {c if t else 0}", 7, "") for c in range(900, 1100) for t in range(2)]
    assert found(trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_clashes_are_noticed(spark, monkeypatch):
    rows = rows_of(4, range(20), "abcdefgh")
    tried, hashed = [], trie._hashed
    monkeypatch.setattr(trie, "_hashed", lambda c, seed, bits: tried.append(seed) or hashed(c, seed, 1 if seed == 0 else bits))
    assert found(trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and tried == [0, 1]
    monkeypatch.setattr(trie, "BASES", (1, 1, 1, 1))
    with pytest.raises(RuntimeError):  # products that do not tell the order of turns
        trie.prefix_nodes(spark.createDataFrame([(c, t, "user", x, 7, "") for c, xs in ((200, "abc"), (300, "bac")) for t, x in enumerate(xs)], SCHEMA))


def test_empty_and_turnless(spark):
    assert trie.prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "user", "only", 7, "") for c in alone]
    got = found(trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 1 and got[0][1] == 0
