"""Exact repeated windows of bytes or words: anchors, classes, contexts, and a check window by window.

Each window of ``length`` items has one anchor: the leftmost of its least ``seed``-grams. Equal
windows have equal anchors at equal places. All windows of a row with one anchor are one *context*:
the items they cover. Contexts met twice settle all their windows at once. Where an anchor's class
holds several contexts (the ends of matches), contexts are split into blocks of windows, and those
into single windows. A block whose core (what all its windows share) is met once holds no repeat;
one whose hull (what they cover together) is met twice holds nothing else.

Hashes have 64 bits (a false match has odds of about pairs / 2^64).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C


@dataclass(frozen=True)
class Windows:
    length: int
    seed: int
    bytewise: bool
    blocks: tuple[int, ...] = (16, 1)

    def items(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item hashes of a chunk and the first item of each row."""
        if self.bytewise:
            return C.byte_values(data), offsets
        start, end, first = C.words(data, offsets)
        return C.word_hashes(data, start, end), first

    def anchors(self, hashes: C.Ranges, n: int, first: np.ndarray):
        """row, anchor, first and last window start of every context."""
        z = np.zeros(0, np.int64)
        if n < self.length:
            return z, z, z, z
        at = np.arange(n - self.seed + 1)
        grams = hashes(at, at + self.seed).astype(np.uint32)
        _, pos = C.least(grams, self.length - self.seed + 1)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(pos)]
        start = np.arange(len(pos))
        good = start + self.length <= first[1:][row]
        start, pos, row = start[good], pos[good].astype(np.int64), row[good]
        if not len(start):
            return z, z, z, z
        new = np.ones(len(start), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])
        i = np.flatnonzero(new)
        return row[i], pos[i], start[i], start[np.append(i[1:], len(start)) - 1]


def _emit(kind: Windows):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(zero_copy_only=False), batch.column("k2").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in C.chunks(batch.column("text")):
                items, first = kind.items(data, offsets)
                hashes = C.Ranges(items)
                row, pos, lo, hi = kind.anchors(hashes, len(items), first)
                cls = hashes(pos, pos + kind.seed)
                ctx = hashes(lo, hi + kind.length) ^ C.mix(((pos - lo) << 32 | (hi - lo)).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cls.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(k1[i:j][row]), pa.array(k2[i:j][row]),
                        pa.array((lo - first[row]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)),
                        pa.array((pos - lo).astype(np.int32)), pa.array(np.ones(len(lo), bool)),
                    ],
                    ["cls", "ctx", "k1", "k2", "lo", "more", "far", "need"],
                )

    return run


def _split(kind: Windows, block: int):
    """Split asked window ranges into blocks of ``block`` offsets from their anchor.

    ``asked`` holds start << 32 | more windows << 17 | first offset << 1 | needs an answer. The class
    of a block is what all its windows share (its core), its context what they cover (its hull).
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(zero_copy_only=False), batch.column("k2").to_numpy(zero_copy_only=False)
            asked = batch.column("asked")
            bounds = np.asarray(asked.offsets).astype(np.int64)
            values = asked.values.to_numpy(zero_copy_only=False)
            for i, j, data, offsets in C.chunks(batch.column("text")):
                items, first = kind.items(data, offsets)
                hashes = C.Ranges(items)
                v = values[bounds[i] : bounds[j]]
                row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                start, more, far, need = v >> 32, (v >> 17) & 0x7FFF, (v >> 1) & 0xFFFF, v & 1
                near = far - more  # offsets from the anchor fall as windows start later
                n = far // block - near // block + 1
                each = np.repeat(np.arange(len(v)), n)
                b = far[each] // block - (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
                top = np.minimum(far[each], b * block + block - 1)
                low = np.maximum(near[each], b * block)
                row = row[each]
                lo = start[each] + far[each] - top
                at = first[row] + lo
                core = at + top - b * block
                cls = hashes(core, core - block + 1 + kind.length) ^ C.mix(b.astype(np.uint64))
                ctx = hashes(at, at + top - low + kind.length) ^ C.mix((top << 32 | low).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cls.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(k1[i:j][row]), pa.array(k2[i:j][row]),
                        pa.array(lo.astype(np.int32)), pa.array((top - low).astype(np.int32)), pa.array(top.astype(np.int32)),
                        pa.array(need[each].astype(bool)),
                    ],
                    ["cls", "ctx", "k1", "k2", "lo", "more", "far", "need"],
                )

    return run


ROWS = "cls long, ctx long, k1 long, k2 long, lo int, more int, far int, need boolean"


def removed_spans(keyed: DataFrame, kind: Windows, earlier_only: bool, name: str = "repeats") -> DataFrame:
    """``k1, k2, spans``: spans of windows to remove as start << 32 | items.

    ``earlier_only``: a window counts if it also starts under a smaller ``k1``; else if it starts
    anywhere else. ``keyed`` holds ``k1, k2, text``.
    """
    rows, spans = keyed.mapInArrow(_emit(kind), ROWS), []
    for level, block in enumerate((*kind.blocks, 0)):
        rows = C.stored(rows, f"{name}-rows{level}")
        # Counted before they are dealt out, copies cost a row per task; most classes have one row and go here.
        classes = rows.groupBy("cls").agg(
            F.count("*").alias("n"), F.min("k1").alias("least"), (F.min("ctx") != F.max("ctx")).alias("several")
        )
        # Read back, the classes are a plain join side, so that a hot class is split at run time.
        classes = C.stored(classes.filter("n >= 2"), f"{name}-classes{level}")
        rows = (rows if block else rows.filter("need")).join(classes, "cls")
        lead = F.col("k1") == F.col("least")
        if not block:  # a window is its own context
            spans.append(rows.filter(~lead if earlier_only else F.lit(True)).select("k1", "k2", _packed(F.col("lo"), F.lit(kind.length)).alias("span")))
            break
        rows = C.stored(rows, f"{name}-repeated{level}")
        mixed = rows.filter("several").drop("n", "least")
        contexts = mixed.groupBy("cls", "ctx").agg(F.count("*").alias("n"), F.min("k1").alias("least"))
        contexts = C.stored(contexts, f"{name}-contexts{level}")
        mixed = mixed.join(contexts, ["cls", "ctx"])
        hits = rows.filter("not several").drop("several").unionByName(mixed.drop("several"))
        settled = ~lead if earlier_only else F.col("n") >= 2
        spans.append(hits.filter(settled & F.col("need")).select("k1", "k2", _packed(F.col("lo"), F.col("more") + kind.length).alias("span")))
        need = F.col("need") if earlier_only else F.col("need") & (F.col("n") == 1)
        ask = _packed(F.col("lo"), F.shiftleft(F.col("more").cast("long"), 17) + F.shiftleft(F.col("far"), 1) + need.cast("int"))
        asked = mixed.filter(lead).groupBy("k1", "k2").agg(F.collect_list(ask).alias("asked"))
        rows = keyed.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked").mapInArrow(_split(kind, block), ROWS)
    return reduce(DataFrame.unionByName, spans).groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))


def _packed(high, low):
    return F.shiftleft(high.cast("long"), 32) + low


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` items the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    start = spans >> 32
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (spans & 0xFFFFFFFF), -1)
    return np.cumsum(edge[:n]) > 0
