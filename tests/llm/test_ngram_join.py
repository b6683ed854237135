"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import ngram_join

FIELDS = "doc_id long, text string"
UPPER = {c: c + 32 for c in range(65, 91)}


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(rows):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = top(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return Counter((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS node", "2 AS sig", "3 AS k1", "4 AS root", "5 AS n", "6 AS items")
    return Counter(tuple(r)[:3] for r in ngram_join.ngram_join(df, **more).collect())


def families(seed):
    """Groups around the bar, a line and a passage that many texts hold, short texts and copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    rows, line, passage = [], [word() for _ in range(6)], [word() for _ in range(25)]
    for size, count in ((130, 40), (60, 30), (25, 30), (300, 20)):
        base = [word() for _ in range(size)]
        for _ in range(count):
            w = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6))):
                w[r.randrange(size)] = word()
            if r.random() < 0.4:
                w = w[: r.randrange(size // 2, size)] if r.random() < 0.5 else w + [word() for _ in range(r.randrange(1, size // 4))]
            rows.append(" ".join(w))
    for k in range(70):
        w = [word() for _ in range(r.choice((4, 8, 20, 40)))]
        rows.append(" ".join(w + line + [word() for _ in range(k % 9)] + (passage if k % 2 else [])))
    rows += [" ".join(line[:k]) for k in range(7)] + ["One  TWO\tthree", "one two three", "one two three four", "ÀÉ", "àé", "a\x00b c", None, "", " \n", "x"]
    rows += [rows[3]] * 6 + [" ".join(line * 400)]
    return list(enumerate(rows))


@pytest.mark.parametrize("few", [16, 2])
def test_components_match_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "CELL_FEW", 7)
    monkeypatch.setattr(ngram_join, "CELL_ALL", 13)
    rows = families(few)
    assert found(spark, rows) == brute(rows)


def test_null_and_repeated_ids_and_empty_tables(spark):
    t = "a b c d e f g h i j"
    rows = [(None, t), (7, t), (9, t.upper()), (3, "other words here"), (3, "quite another text of words"), (3, "quite another text of words"), (None, "alone it is"), (None, None), (5, None)]
    assert found(spark, rows) == brute(rows)
    assert ngram_join.ngram_join(spark.createDataFrame([], FIELDS)).count() == 0


def test_linked_sets_agree_in_a_segment_or_its_neighbourhood():
    bands = ngram_join.Bands(80)
    r = np.random.default_rng(3)
    for n in [*range(1, 40), 100, 333, 2000]:
        for _ in range(20):
            m = int(r.integers(n, n * 100 // 80 + 1))
            most = 20 * (n + m) // 180
            same = (n + m - most + 1) // 2 if (n + m - most) % 2 else (n + m - most) // 2
            same = min(same, n)
            if 100 * same < 80 * (n + m - same):
                continue
            x = r.integers(1, 1 << 62, n + m).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:same], x[n : n + m - same]]))
            assert bands.of(np.array([m]))[0] - bands.of(np.array([n]))[0] in (0, 1)
            if n == m == same:
                continue
            row = np.repeat([0, 1], [len(a), len(b)])
            own, _, sig, _ = ngram_join.equal_signatures(row, np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
            assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


def test_shared_rows_over_batches():
    import pyarrow as pa

    r = np.random.default_rng(1)
    sig, node = r.integers(0, 40, 300), r.integers(0, 6, 300)
    rows = sorted(zip(sig.tolist(), node.tolist()))
    want = {x for x in rows if len({b for a, b in rows if a == x[0]}) > 1}
    for step in (1, 2, 7, 300):
        parts = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows[i : i + step]]), pa.array([b for _, b in rows[i : i + step]])], ["sig", "node"]) for i in range(0, 300, step)]
        got = [x for b in ngram_join._shared(iter(parts)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert len(got) == len(want) and set(got) == want


def test_dear_signatures_are_not_joined_back_to_their_rows(spark, monkeypatch):
    plans, stored = {}, ngram_join.C.stored
    monkeypatch.setattr(ngram_join.C, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and stored(df, name))
    monkeypatch.setattr(ngram_join, "FEW", 1)
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for q in rng.sample(range(60), rng.randrange(12)):
            words[q] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert any(n.startswith("join-near") for n in plans) and "join-cells" in plans
    assert not any(f"Join LeftSemi, (sig#" in p for p in plans.values())
    sets = [{tuple(t.split()[j : j + 5]) for j in range(56)} for _, t in rows]
    root = list(range(40))
    for _ in rows:
        for i in range(40):
            for j in range(40):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_components_of_stars_take_one_round(spark, monkeypatch):
    """Stars around their least node, and chains, get the least node; a star needs one round and no second one to see that it is done."""
    from cohortloom.llm import common as C
    from cohortloom.llm.components import components

    kept, own = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: kept.append(name) or own(df, name))
    star = [(1, 7), (9, 1), (1, 8), (7, 1), (20, 30), (5, 5)]
    got = components(spark.createDataFrame(star, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (7, 1), (8, 1), (9, 1), (20, 20), (30, 20)]
    assert len(kept) == 5
    chain = [(i, i + 1) for i in range(40)] + [(100, 40), (201, 200)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(41)] + [(100, 0), (200, 200), (201, 200)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(7)
    for n in [*range(1, 70), 100, 333, 1024, 5000]:
        for m in (n, n + n // 4, 3 * n):
            same = int(r.integers(0, n + 1))
            x = np.unique(r.integers(1, 1 << 62, n + m).astype(np.uint64) & ngram_join.KEPT)
            a, b = x[:n], np.concatenate([x[:same], x[n : n + m - same]])
            row = np.repeat([0, 2], [len(a), len(b)])
            raw = ngram_join.sketched(row, np.concatenate([a, b]), 3).to_pylist()
            assert len(raw[1]) == 8 and not any(raw[1])
            bits = [8 * len(s) for s in raw]
            assert bits[0] >= max(64, 2 * len(a)) and bits[0] <= max(64, 4 * len(a))
            p, q = (ngram_join.folded(int.from_bytes(raw[i], "little"), bits[i], min(bits[0], bits[2])) for i in (0, 2))
            assert (p ^ q).bit_count() <= len(np.setxor1d(a, b))
            assert same < n or m > n or p == q


def test_only_sets_that_may_link_are_overlapped(spark, monkeypatch):
    """Texts that share passages but are far apart, and others: only near ones are overlapped."""
    kept, own = Counter(), ngram_join.C.stored

    def stored(df, name):
        out = own(df, name)
        kept[name] += out.count()
        return out

    monkeypatch.setattr(ngram_join.C, "stored", stored)
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = [" ".join(word() for _ in range(50)) for _ in range(300)]
    shared = [word() for _ in range(150)]
    far = [" ".join([*shared, *(word() for _ in range(100))]) for _ in range(14)]
    near = [" ".join([*shared, *(f"n{k}" for k in range(100)), f"x{i}"]) for i in range(3)]
    rows = list(enumerate(rows + far + near))
    assert found(spark, rows) == brute(rows)
    overlaps = sum(c for n, c in kept.items() if n.startswith("join-overlaps"))
    assert sum(c for n, c in kept.items() if n.startswith("join-pairs")) > 20 and overlaps <= 3


def test_sets_without_a_mark_stay():
    import pyarrow as pa

    texts = pa.array([f"some text number {i} of a few words" for i in range(40)] + ["", " "])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    every = pa.Table.from_batches(ngram_join._bagged(5, np.full(2, -1, np.int64).view(np.uint64))(iter([batch])))
    assert every.num_rows == 40 and set(every["size"].to_pylist()) == {4}
    words = np.zeros(1 << 14, np.uint64)
    for x in every["node"].to_numpy()[[3, 8]].view(np.uint64):
        at = int(x) % (64 * len(words))
        words[at // 64] |= np.uint64(1 << at % 64)
    some = pa.Table.from_batches(ngram_join._bagged(5, words)(iter([batch])))
    assert some.to_pylist() == every.take([3, 8]).to_pylist()


def test_marks_hold_all_nodes(spark, monkeypatch):
    node = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 3000, np.int64)
    for most in (ngram_join.MARKS, 256):
        monkeypatch.setattr(ngram_join, "MARKS", most)
        words = ngram_join.marks(spark.createDataFrame([(int(x),) for x in node[:1500]], "node long").distinct())
        assert 64 * len(words) <= max(most, 64) and ngram_join.marked(node[:1500], words).all()
        assert most == 256 or ngram_join.marked(node[1500:], words).mean() < 0.2
    assert not ngram_join.marked(node, ngram_join.marks(spark.createDataFrame([], "node long"))).any()
