"""Near-duplicates by BagMinHash (op 8).

A text is the multiset of its shingles of five words (fewer words: one shingle of all). The weight of
a shingle is its count. Signatures come from hierarchical Poisson processes over the discretised
weights: the levels (0,1], (1,2], (2,4], (4,8] ... of a shingle each have a process seeded by shingle
and block, with the block's width as rate; a point counts for a text if its level is within the
weight. Each point falls on one of ``size`` registers, a register keeps its earliest point, so two
texts agree in a register with the probability of their weighted Jaccard similarity. Points are made
in time order and only up to the time by which all registers are full.

Bands of signatures give candidates, exact multiset overlap of shingles verifies them. A text is first
compared with the most central text of its buckets, then with another; after that all pairs of a
bucket that are still in different classes are compared, unless the shingles that only one of them
has rule the link out; in large buckets (in cells of bounded size) also by signature. Pairs whose link could not join two classes are not verified, so
``links`` counts verified links only. Bands of 5 of 190 registers miss a pair of similarity 0.8 with
odds of 3e-7; the comparison by signature (4.1 standard errors below) with odds of 2e-5.

Equal texts form one class from the start. Null text counts as empty; empty texts are one class.
A class is made of texts, whatever their doc_ids: null doc_id stands for a row like another, and so does
a repeated one. Rows equal in doc_id and text count once. The least doc_id of a class is null only if all are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C
from cohortloom.llm.components import components

SMALL = 16  # members of a bucket whose pairs are joined directly; larger buckets are compared by signature first
GOLD = np.uint64(0x9E3779B97F4A7C15)
KEY = ["k1", "k2", "size"]  # rows that agree in these hold one doc_id and one text


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of a chunk."""
    start, end, first = C.words(data, offsets)
    hashes = C.Ranges(C.word_hashes(data, start, end))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, hashes(at, np.minimum(at + width, first[row + 1]))


def signatures(row: np.ndarray, item: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Point ids (uint32) of every register of every row; rows without items keep zeros."""
    ids = np.zeros((rows, size), np.uint32)
    if not len(row):
        return ids
    order = np.lexsort((item, row))
    row, item = row[order], item[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(row)))
    row, item = row[at], item[at]
    total = np.bincount(row, weight, rows)
    blocks = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    each = np.repeat(np.arange(len(row)), blocks)
    block = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    width = np.where(block == 0, 1, 2 ** np.maximum(block - 1, 0)).astype(np.float64)
    base = np.where(block == 0, 0, 2 ** np.maximum(block - 1, 0)).astype(np.float64)
    seed = C.mix(item[each] + block.astype(np.uint64) * GOLD)
    row, weight = row[each], weight[each].astype(np.float64)
    limit = size * (np.log(size) + 10) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        best = np.full(rows * size, 0, np.uint32)
        full = np.zeros(rows * size, bool)
        live = np.flatnonzero(todo[row])
        time, k, found = np.zeros(len(live)), 0, []
        while len(live):
            step = 8 if len(live) > 1000 else 128
            h = C.mix(seed[live][:, None] + np.arange(k + 1, k + step + 1, dtype=np.uint64) * GOLD)
            gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width[live][:, None]
            t = time[:, None] + np.cumsum(gap, axis=1)
            i, j = np.nonzero(t <= limit[row[live]][:, None])
            h = C.mix(h[i, j] ^ GOLD)
            own = live[i]
            level = base[own] + 1 + np.floor(((h >> np.uint64(32)) & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24 * width[own])
            ok = level <= weight[own]
            slot = row[own] * size + (h % np.uint64(size)).astype(np.int64)
            found.append((t[i, j][ok], slot[ok], C.mix(h)[ok].astype(np.uint32)))
            stay = t[:, -1] <= limit[row[live]]
            live, time, k = live[stay], t[stay, -1], k + step
        t, slot, point = (np.concatenate(x) for x in zip(*found))
        back = np.argsort(-t, kind="stable")
        best[slot[back]] = point[back]
        full[slot] = True
        done = todo & full.reshape(rows, size).all(axis=1)
        ids[done] = best.reshape(rows, size)[done]
        todo &= ~done
        limit = limit * 2
    return ids


def bands(ids: np.ndarray, rows: int) -> np.ndarray:
    """A hash per band of ``rows`` registers."""
    n, size = ids.shape
    h = np.zeros((n, size // rows), np.uint64)
    part = ids.reshape(n, size // rows, rows).astype(np.uint64)
    for r in range(rows):
        h = C.mix(h * GOLD + part[:, :, r] + np.uint64(1))
    return C.mix(h + np.arange(size // rows, dtype=np.uint64) * GOLD)


def _signed(size: int, rows: int, width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, offsets in C.chunks(batch.column("text")):
                row, item = shingles(data, offsets, width)
                ids = signatures(row, item, j - i, size)
                has = np.bincount(row, minlength=j - i) > 0
                h = bands(ids[has], rows)
                flat = pa.array(h.reshape(-1).view(np.int64))
                at = pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1])
                signs = pa.array([r.tobytes() for r in ids[has]], pa.binary())
                own = [batch.column(c).slice(i, j - i).filter(pa.array(has)) for c in KEY]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(at, flat), signs], [*KEY, "bands", "sign"])

    return run


def _shingled(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in C.chunks(batch.column("text")):
                row, item = shingles(data, offsets, width)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[i:j]), pa.array([np.sort(item[x:y]).tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())], ["node", "items"]
                )

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    every = len(a) + len(b) - both
    return float(both / every) if every else 1.0


def _verified(least: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            value = np.array([overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], np.float64)
            keep = pa.array(value >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(value[value >= least])], ["a", "b", "similarity"])

    return run


def _counted(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in C.chunks(batch.column("text")):
                row, item = shingles(data, offsets, width)
                order = np.lexsort((item, row))
                row, item = row[order], item[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(node[i:j][row[at]]), pa.array(item[at].view(np.int64)), pa.array(count.astype(np.int64))], ["node", "item", "n"])

    return run


def _texts_of(keyed: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text``: one row for each of ``nodes``."""
    return keyed.join(ids.join(nodes, "node").select(*KEY, "node"), KEY).dropDuplicates(KEY).select("node", "text")


def _alone(keyed: DataFrame, nodes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Per text of ``ids``: its shingles (``total``) and those that no other of them has (``alone``)."""
    items = C.stored(_texts_of(keyed, nodes, ids).mapInArrow(_counted(width), "node long, item long, n long"), "near-items")
    total = items.groupBy("node").agg(F.sum("n").alias("total"))
    alone = items.groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("most"), F.sum("n").alias("n")).filter("node = most")
    alone = alone.groupBy("node").agg(F.sum("n").alias("alone"))
    return C.stored(total.join(alone, "node", "left").select("node", "total", F.coalesce("alone", F.lit(0)).alias("alone")), "near-alone")


def _links(keyed: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs (a, b) whose multiset overlap is at least ``least``."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = C.stored(_texts_of(keyed, nodes, ids).mapInArrow(_shingled(width), "node long, items binary"), "near-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return C.stored(both.mapInArrow(_verified(least), "a long, b long, similarity double"), "near-links")


def _likely(few, every, size: int, rows: int, least: float, bar: float) -> np.ndarray:
    """Index pairs of ``few`` and ``every`` (node, root, sign, main, band, total, alone) of different classes whose signatures agree in
    ``least`` of the registers, once: in the first band that both share."""
    x = np.frombuffer(b"".join(few.sign), np.uint32).reshape(-1, size)
    y = np.frombuffer(b"".join(every.sign), np.uint32).reshape(-1, size)
    n, shared = every.total.to_numpy(), (every.total - every.alone).to_numpy()
    out = []
    for i in range(len(x)):
        same = y == x[i]
        # An overlap of ``bar`` of both sizes needs as many shingles that are not a text's own.
        ok = np.minimum(shared, few.total.iloc[i] - few.alone.iloc[i]) >= bar * (n + few.total.iloc[i]) - 1e-9
        ok &= (same.mean(axis=1) >= least) & (every.root.to_numpy() != few.root.iloc[i])
        ok &= (every.root == every.main).to_numpy() | (every.node < few.node.iloc[i]).to_numpy()
        j = np.flatnonzero(ok)
        if len(j):
            first = same[j].reshape(len(j), size // rows, rows).all(axis=2).argmax(axis=1)
            # The first shared band must be this one.
            mine = bands(x[i : i + 1], rows)[0].view(np.int64)
            j = j[mine[first] == few.band.iloc[i]]
            out.append(np.column_stack([np.full(len(j), i), j]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _large_pairs(few: DataFrame, every: DataFrame, counts: DataFrame, size: int, rows: int, least: float, bar: float) -> DataFrame:
    """Pairs of large buckets, in cells of at most about 512 by 2048 rows."""
    import pandas as pd

    counts = counts.select("band", F.ceil(F.col("n_few") / 512).alias("ci"), F.ceil(F.col("n") / 2048).alias("cj"))
    few, every = few.toDF(*few.columns), every.toDF(*every.columns)  # both come from one frame
    few = few.join(counts, "band").withColumn("i", F.pmod(F.xxhash64("node"), "ci")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cj") - 1)))
    every = every.join(counts, "band").withColumn("j", F.pmod(F.xxhash64("node"), "cj")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ci") - 1)))

    def cell(a, b):
        found = _likely(a, b, size, rows, least, bar)
        p, q = a.node.to_numpy()[found[:, 0]], b.node.to_numpy()[found[:, 1]]
        return pd.DataFrame({"a": np.maximum(p, q), "b": np.minimum(p, q)})

    few, every = few.toDF(*few.columns), every.toDF(*every.columns)
    return few.groupBy("band", "i", "j").cogroup(every.groupBy("band", "i", "j")).applyInPandas(cell, "a long, b long")


def _classes(keyed: DataFrame, least: float, size: int, rows: int, width: int) -> DataFrame:
    """``k1, k2, size, node, root, links`` for each text of ``keyed``: its number, that of its class, and its
    verified links. ``k1`` is the least doc_id of the text; numbers follow the order of doc_ids, null last."""
    void = F.col("k1") == -(1 << 63)
    ids = keyed.groupBy("k2", "size").agg(F.min(F.struct(void.alias("void"), "k1")).alias("least"))
    ids = C.stored(ids.select("least.void", "least.k1", "k2", "size"), "near-keys")
    # Sorted by unique keys, so that the order of the numbers does not depend on the run.
    order = ["void", *KEY]
    ids = ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())
    ids = C.stored(ids.select(*KEY, "node"), "near-ids")
    signs = keyed.mapInArrow(_signed(size, rows, width), "k1 long, k2 long, size int, bands array<long>, sign binary")
    signs = C.stored(signs.join(ids, KEY).dropDuplicates(KEY).select("node", "bands", "sign"), "near-signatures")
    signed = signs.select("node", F.explode("bands").alias("band"))
    spread = signed.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("other"), F.count("*").alias("n"))
    spread = C.stored(spread.filter("leader < other"), "near-buckets")
    # The leader of a bucket is its most central text: the one with most neighbours over all its buckets.
    members = C.stored(signed.join(spread, "band").drop("leader"), "near-members")
    central = C.stored(members.groupBy("node").agg(F.sum("n").alias("near")), "near-central")
    best = members.join(central, "node").groupBy("band").agg(F.max(F.struct("near", "node")).alias("leader"))
    members = C.stored(members.join(C.stored(best, "near-leaders"), "band"), "near-members")
    done, links, root = None, None, None
    for step in ("leader", "other", "rest"):
        at = members
        if root is not None:
            at = at.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if step == "leader":  # each text against the most central text it shares a bucket with
            pairs = at.groupBy("node").agg(F.max("leader").alias("leader")).select("node", F.col("leader.node").alias("leader"))
        elif step == "other":  # and against the largest one of another class
            other = root.select(F.col("node").alias("other"), F.col("root").alias("near"))
            pairs = at.join(other, "other", "left").filter(F.col("root") != F.coalesce("near", "other")).groupBy("node").agg(F.max("other").alias("other"))
        else:
            # All members outside a bucket's largest class against all members of other classes.
            at = C.stored(at.select("band", "node", "root"), "near-open")
            part = at.groupBy("band", "root").agg(F.count("*").alias("m"))
            main = part.groupBy("band").agg(F.max_by("root", "m").alias("main"), F.sum("m").alias("n"), F.max("m").alias("m"), F.count("*").alias("classes"))
            main = C.stored(main.filter("classes > 1").select("band", "main", "n", (F.col("n") - F.col("m")).alias("n_few")), "near-open")
            open_ = at.join(main, "band")
            open_ = C.stored(open_.join(_alone(keyed, ids, open_.select("node").distinct(), width), "node"), "near-open")
            bar = least / (1 + least)
            small = open_.filter(f"n <= {SMALL}")
            few = small.filter("root <> main").select("band", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("total").alias("ta"), F.col("alone").alias("la"))
            every = small.select("band", F.col("node").alias("b"), F.col("root").alias("rb"), "main", "total", "alone")
            pairs = few.join(every, "band").filter(f"ra <> rb and (rb = main or a > b) and least(ta - la, total - alone) >= {bar} * (ta + total) - 1e-9").select("a", "b")
            large = open_.filter(f"n > {SMALL}").drop("n", "n_few").join(signs.select("node", "sign"), "node")
            large = C.stored(large, "near-large")
            counts = main.filter(f"n > {SMALL}")
            pairs = pairs.unionByName(_large_pairs(large.filter("root <> main"), large, counts, size, rows, least - 4.1 * (least * (1 - least) / size) ** 0.5, bar))
            pairs = pairs.select(F.col("a").alias("node"), F.col("b").alias("rest"))
        pairs = pairs.filter(F.col("node") != F.col(step)).select(F.greatest("node", step).alias("a"), F.least("node", step).alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = C.stored(pairs, f"near-pairs-{step}")
        done = pairs if done is None else done.unionByName(pairs)
        found = _links(keyed, ids, pairs, least, width)
        links = found if links is None else links.unionByName(found)
        root = C.stored(components(links.select("a", "b"), "near-components"), "near-roots")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    ids = ids.join(root, "node", "left").join(degree, "node", "left")
    return ids.select(*KEY, "node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def _keyed(docs: DataFrame) -> DataFrame:
    return C.text_keys(docs).withColumn("size", F.octet_length("text"))


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 190, rows: int = 5, width: int = 5) -> DataFrame:
    """``doc_id, class_id, links``: the class is the least doc_id of its component; ``links`` counts the verified
    links of the row's text to other texts."""
    keyed = _keyed(docs)
    ids = C.stored(_classes(keyed, least, size, rows, width), "near-classes")
    lead = ids.filter("node = root").select("root", F.col("k1").alias("lead"))
    ids = ids.join(lead, "root").select("k2", "size", "lead", "links")
    out = keyed.select(*KEY).join(ids, ["k2", "size"])
    return out.select(C.doc_id_of(F.col("k1")).alias("doc_id"), C.doc_id_of(F.col("lead")).alias("class_id"), F.col("links").cast("long"))


def one_of_each(docs: DataFrame, least: float = 0.8, size: int = 190, rows: int = 5, width: int = 5) -> DataFrame:
    """One row of ``docs`` per class, one with the least doc_id, with all its columns."""
    lead = _classes(_keyed(docs), least, size, rows, width).filter("node = root")
    lead = C.stored(lead.select(*(F.col(c).alias(f"_{c}") for c in KEY)), "near-leads")
    text = F.coalesce(F.col("text"), F.lit(""))
    k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select("*", k1.alias("_k1"), F.xxhash64(text).alias("_k2"), F.octet_length(text).alias("_size"))
    return own.join(lead, lead.columns, "left_semi").dropDuplicates(lead.columns).select(*docs.columns)
