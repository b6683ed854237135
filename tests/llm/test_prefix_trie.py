"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from cohortloom.llm import prefix_trie

FIELDS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, (r or "", x or "")))
    # Turns that tie come in the order of their digests.
    own = {c: [v for *_, v in sorted(ts, key=lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2][0].encode())}:{t[2][0]}{t[2][1]}".encode()).digest()))] for c, ts in convs.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        paths[c] = tuple(base[:h] + ts[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, cs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in cs if paths[c] == p))).encode()).hexdigest())
        for p, cs in nodes.items()
    )


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS id", "2 AS pos", "3 AS top", "4 AS item", "5 AS p")
    return Counter(tuple(r) for r in prefix_trie.prefix_nodes(df, **more).collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for c in [*range(0, 60), *range(98, 140), 205, 331, -7, -100, 900, 10**12]:
        n = r.choice((0, 1, 2, 3, 5, 8, 14)) if c != 100 else 17
        out += [(c, t, r.choice(("user", "assistant", None)), r.choice(("é" * 3, "b", "cc", None, ""))) for t in range(n)]
    out += [(c, t, "user", "same") for c in range(400, 440) for t in range(9)]  # copies
    out += [(500, None, "system", "null first"), (500, 0, "a", "x"), (500, 0, "a", "x"), (500, 0, "b", "y"), (500, 0, None, "z" * 50_000)]
    out += [(None, 1, "user", "nobody"), (None, None, None, None)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block, shard", [(4096, 1 << 17), (5, 7)])
def test_nodes_match_brute_force(spark, rows, block, shard):
    assert found(spark, rows, block=block, shard=shard) == brute(rows)


def test_conversations_without_rebuilt_turns(spark):
    rows = [(c, 0, "user", "hi") for c in range(701, 730)]  # their hundred's first conversation does not exist
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == brute(rows[:1])
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], FIELDS)).count() == 0
    assert not found(spark, [(None, 1, "a", "b")])


def test_long_lists_of_ends_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, t, "user", "same") for c in range(1000, 1300) for t in range(7)]
    assert found(spark, rows, shard=5) == brute(rows)


def test_ternary_tree_is_balanced_by_medians():
    tree = prefix_trie.TernaryTree()
    for m in prefix_trie.medians(1023):
        tree.insert([m])
    depth = {tree.top: 1}
    for v in tree.walk():
        depth.update({x: depth[v] + 1 for x in (tree.low[v], tree.high[v]) if x >= 0})
    assert sorted(prefix_trie.medians(1023)) == list(range(1023)) and max(depth.values()) == 10 and len(depth) == 1023
