"""Concatenate and cut (op 2).

Pass 1 tokenises every text once, in its partition, and writes ids with their place in the partition.
The totals of the partitions (one row each) are summed up in order, which gives each partition its
global offset. Pass 2 cuts at fixed windows of ``size`` ids; a document over a window's end leaves a
boundary record in each window. The ids after the last full window are cut at powers of two, so no
sequence needs padding.

``added`` maps literals to ids of their own, as the added tokens of a tokenizer file; without it such a
literal is text like any other. Null or empty text: the end id alone. Documents with equal or null doc_id are packed like others.
An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.llm import common as C

VOCABULARY = "byte_bpe_50k"
MEMORY = 400_000  # words whose ids a task remembers at once; it forgets all when full


class Encoder:
    """Ids of the byte-level vocabulary; ``tiktoken`` reads the same vocabulary as ``tokenizers`` and is faster.

    A space before a word always starts a token, so texts without double spaces are encoded word by
    word, and words are remembered. A literal of ``added`` ends the text before it and gives its id.
    """

    def __init__(self, ranks_path: str | None, pattern: str | None, added: dict[str, int] | None = None):
        import base64

        import tiktoken

        if ranks_path is None:
            import public_tokenizers

            ranks_path, pattern = public_tokenizers.path(f"{VOCABULARY}.tiktoken"), public_tokenizers.PATTERN
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.added = {t: np.array([i], "<u2").tobytes() for t, i in (added or {}).items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.literal = re.compile(f"({'|'.join(longest_first)})") if self.added else None

    def _word(self, word: str) -> bytes:
        if len(self.known) >= MEMORY:
            self.known.clear()
        ids = self.known[word] = np.array(self.whole(word), "<u2").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if self.literal is None or not self.literal.search(text):
            return self._plain(text)
        # Every second part is a literal.
        parts = self.literal.split(text)
        return b"".join(self.added[t] if i % 2 else self._plain(t) for i, t in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        if "  " in text or not text:
            return np.array(self.whole(text), "<u2").tobytes()
        known = self.known
        first, *rest = text.split(" ")
        out = [self._word(first)] if first else []
        for w in rest:
            w = " " + w
            ids = known.get(w)
            out.append(self._word(w) if ids is None else ids)
        return b"".join(out)


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Literals and ids that the tokenizer file at ``path`` adds to its vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(f"{VOCABULARY}.json")
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def pack(
    docs: DataFrame,
    size: int = 1024,
    end_id: int = 0,
    ranks_path: str | None = None,
    pattern: str | None = None,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``."""

    def tokenise(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, encode = TaskContext.get().partitionId(), 0, Encoder(ranks_path, pattern, added)
        tail = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            column = batch.column("text")
            for lo in range(0, batch.num_rows, 1000):
                ids = [encode(t) + tail for t in column.slice(lo, 1000).to_pylist()]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, 1000), pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(n), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "local", "n", "ids"],
                )

    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = C.stored(tokens.mapInArrow(tokenise, "doc_id long, part int, local long, n long, ids binary"), "pack-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    # One row per partition of the scan: small enough for one window, and bounded by the number of tasks.
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = C.stored(totals.select("part", before.alias("before"), F.sum("n").over(W.partitionBy()).alias("total")), "pack-totals")
    placed = tokens.join(totals.hint("broadcast") if totals.count() < 1_000_000 else totals, "part")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            local, n = batch.column("local").to_numpy(), batch.column("n").to_numpy()
            total = int(batch.column("total")[0].as_py()) if batch.num_rows else 0
            begin = batch.column("before").to_numpy() + local
            full = total // size
            # Ends of the sequences after the last full window: the binary digits of what is left.
            tail = [full * size]
            for bit in range(size.bit_length() - 1, -1, -1):
                if (total % size) >> bit & 1:
                    tail.append(tail[-1] + (1 << bit))
            tail = np.array(tail, np.int64)
            rows, start, length, crc, seq, off, piece = [], [], [], [], [], [], []
            for r, ids in enumerate(batch.column("ids")):
                ids, b = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4"), int(begin[r])
                e = b + len(ids)
                edges = np.arange((b // size + 1) * size, min(e, int(tail[0]) + 1), size)
                edges = np.unique(np.concatenate([[b], edges, tail[(tail > b) & (tail < e)], [e]]))
                edges = edges[(edges >= b) & (edges <= e)].tolist()
                for x, y in zip(edges[:-1], edges[1:]):
                    if x < tail[0]:
                        s, o = x // size, x % size
                    else:
                        k = int(np.searchsorted(tail, x, "right")) - 1
                        s, o = full + k, x - int(tail[k])
                    own = ids[x - b : y - b].tobytes()
                    rows.append(r)
                    start.append(x - b)
                    length.append(y - x)
                    crc.append(zlib.crc32(own))
                    seq.append(s)
                    off.append(o)
                    piece.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array(n[rows] if rows else [], pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(piece, pa.binary()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.select("doc_id", "local", "n", "ids", "before", "total").mapInArrow(cut, schema)
