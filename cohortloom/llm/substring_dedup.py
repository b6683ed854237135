"""Substring dedup by seed and extend (op 9).

Words are runs of characters other than space and 0x09-0x0D. Documents meet on winnowed anchors
(the least word gram of every window of ``length`` words); around an anchor the match extends both
ways, window by window. A word goes if a window over it also starts under a smaller doc_id; the
first document keeps its copy, so kept repeats are the maximal ones.

Null or empty text: no words, nothing removed. Null doc_id counts as smaller than all others.
Rows with one doc_id and text give equal results; the same doc_id never removes its own repeats.
Texts shorter than a window stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from cohortloom.llm import common as C
from cohortloom.llm.repeats import Windows, covered, removed_spans


def dedup_substrings(docs: DataFrame, length: int = 50, seed: int = 10) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for each row of ``docs`` (doc_id, text)."""
    keyed = C.text_keys(docs)
    spans = removed_spans(keyed, Windows(length, seed, False, (6, 1)), True, name="substring")

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            spans = batch.column("spans").to_pylist()
            out = []
            for i, j, data, offsets in C.chunks(batch.column("text")):
                start, end, first = C.words(data, offsets)
                raw = data.tobytes()
                for k in range(j - i):
                    a, b = first[k], first[k + 1]
                    s, e, gone = start[a:b], end[a:b], 0
                    if spans[i + k]:
                        mask = covered(np.array(spans[i + k], np.int64), b - a)
                        gone = int(mask.sum())
                        s, e = s[~mask], e[~mask]
                    kept = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist())])
                    out.append((int(b - a), gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            n, gone, sha, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["k1", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    done = keyed.join(spans, ["k1", "k2"], "left").select("k1", "text", "spans").mapInArrow(
        finish, "k1 long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return done.select(C.doc_id_of(done.k1).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")
