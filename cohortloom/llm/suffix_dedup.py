"""Dedup of repeated byte strings (op 3), by hashes of anchors and contexts.

Not by suffix arrays or Burrows-Wheeler transforms: no shard is sorted, and no intervals of shards are
merged. Windows of ``length`` bytes are grouped by their content-defined anchor and compared by 64-bit
hashes of their contexts, blocks and single windows (``repeats``, shared with op 9). A window met twice
anywhere is a repeat; the result is the same as that of a suffix array, up to hash collisions.

Null text: no bytes, nothing removed. Matches never cross rows; a window repeated in its own row
counts. Rows with one doc_id and text count as two copies of each other, and both lose the repeats.
Texts shorter than ``length`` bytes stay whole. ``kept_text`` leaves out
characters that a cut leaves in part; the digest is of all kept bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from cohortloom.llm import common as C
from cohortloom.llm.repeats import Windows, covered, removed_spans


def suffix_order(row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Suffix array of a block of symbol strings (one per row): ranks double until all differ.

    The end of a row sorts first; equal suffixes of different rows stand in row order. The query does not use it.
    """
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    left = np.searchsorted(row, row, "right") - np.arange(n)  # symbols up to the end of the row
    while step < n:
        follow = np.zeros(n, np.int64)
        follow[:-step] = np.where(left[:-step] > step, rank[step:] + 1, 0)
        pair = rank * (n + 1) + follow
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        if new[order[-1]] == rank[order].max() and (new == rank).all():
            break
        rank = new
        step *= 2
    return order


def dedup_suffixes(docs: DataFrame, length: int = 200, seed: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``carry``, ``n_bytes, n_removed, n_spans, kept_sha256, kept_text`` for each row of ``docs`` (doc_id, text)."""
    keyed = C.text_keys(docs, carry)
    spans = removed_spans(keyed.select("k1", "k2", "text"), Windows(length, seed, True), False, name="suffix")

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            spans = batch.column("spans").to_pylist()
            data, offsets = C.texts_of(batch.column("text"))
            out = []
            for k in range(batch.num_rows):
                own, gone, runs = data[offsets[k] : offsets[k + 1]], 0, 0
                n = len(own)
                if spans[k]:
                    mask = covered(np.array(spans[k], np.int64), n)
                    gone = int(mask.sum())
                    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    own = own[~mask]
                own = own.tobytes()
                out.append((n, gone, runs, hashlib.sha256(own).hexdigest(), own.decode("utf-8", "ignore")))
            n, gone, runs, sha, kept = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"), *(batch.column(c) for c in carry), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()),
                ],
                ["k1", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    own = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    done = keyed.join(spans, ["k1", "k2"], "left").select("k1", *carry, "text", "spans").mapInArrow(
        finish, f"k1 long, {own}n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
    return done.select(C.doc_id_of(done.k1).alias("doc_id"), *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
