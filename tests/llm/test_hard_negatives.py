"""Hard negatives against brute force in whole numbers."""

import math
import random
from collections import Counter

import pytest

from cohortloom.llm import hard_negatives

FIELDS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50):
    good = [(i, v, [math.floor(256 * x) for x in e], y) for i, (v, e, y) in enumerate(rows) if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for i, v, q, y in good:
        if v is None or v % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, p)), w is None, w or 0, j, w, z) for j, w, p, z in good if j != i and len(p) == len(q)]
        scored.sort(key=lambda t: (-t[0], t[1], t[2]))
        for s, *_, w, _ in [t for t in scored if t[5] == y][:5]:
            hits = [t for t in scored if t[5] != y and 50 * s <= 100 * t[0] <= 95 * s][:3]
            out.update((v, w, k + 1, t[4], s, t[0]) for k, t in enumerate(hits))
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS rid", "2 AS cell", "3 AS v", "4 AS dim", "5 AS key")
    return Counter(tuple(r) for r in hard_negatives.mine(df, **more).collect())


def rounded(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(n, d, seed, labels=4):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.2) for _ in range(d)] for _ in range(labels)]
    return [(i, [rounded(c + r.gauss(0, 0.2)) for c in middles[i % labels]], i % labels) for i in range(n)]


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rows = vectors(700, 12, 1)
    rows += [(50, rows[3][1], 0), (50, rows[3][1], 0), (None, rows[4][1], 1), (None, rows[4][1], 2)]  # repeated and null ids
    rows += [(900 + i, rows[5][1], i % 2) for i in range(60)]  # copies: ties
    rows += [(1050, None, 1), (1100, rows[1][1], None), (1150, [*rows[1][1][:11], None], 1), (1200, [*rows[1][1][:11], float("nan")], 1), (1250, [*rows[1][1][:11], float("inf")], 1)]
    rows += [(1300, [0.0] * 12, 1), (1350, [], 1), (1351, [], 2), (1400, [0.5, 0.25], 1), (1401, [0.5, 0.25], 1), (1402, [0.25, 0.5], 2)]
    monkeypatch.setattr(hard_negatives, "CELL", 128)
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    assert mined(spark, rows) == brute(rows)


def test_hard_negatives_of_huge_components_and_few_rows(spark):
    r = random.Random(4)
    rows = [(i, [rounded(r.gauss(0, 1) * 10 ** r.choice((0, 20, 30))) for _ in range(3)], i % 2) for i in range(120)]
    limit = (1 << 63) - 1
    want = Counter()
    for k, n in brute(rows).items():
        want[(*k[:4], *(max(-limit - 1, min(limit, s)) for s in k[4:]))] += n
    assert mined(spark, rows) == want and want
    assert not mined(spark, rows[:1]) and not mined(spark, [(1, [0.5], 0), (2, [0.5], 1)])
    assert hard_negatives.mine(spark.createDataFrame([], FIELDS)).count() == 0


def test_windows_and_bounds_lose_no_score(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = np.floor(r.normal(0, 60, (300, 8)))
    norm, turn = hard_negatives.norms_and_angles(x, np.eye(3, 8))
    cell = hard_negatives.Cell.__new__(hard_negatives.Cell)
    cell.rid, cell.x, cell.norm, cell.angles, cell.most = np.arange(300), x, norm, turn, norm.max()
    cell.order = np.argsort(turn, axis=0, kind="stable")
    cell.sorted = np.take_along_axis(turn, cell.order, axis=0)
    for i in range(0, 300, 17):
        s = x @ x[i]
        for low in np.quantile(s, [0.3, 0.7, 0.95]):
            assert set(np.flatnonzero(s >= low)) <= set(cell.window(i, cell, low).tolist())
        least, most = cell.bounds(i, cell, np.arange(300))
        assert (least <= s).all() and (s <= most).all()


@pytest.mark.parametrize("label, want", [(9, 0), (3, 4)])
def test_relabelled(spark, label, want):
    df = spark.createDataFrame([(14, [0.5], label), (15, [0.5], label), (None, [0.5], label)], FIELDS)
    assert [r.label for r in hard_negatives.relabelled(df).collect()] == [want, label, label]
