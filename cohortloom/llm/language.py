"""Language ID with string kernels (op 5).

A text is the set of its character n-grams (n of 1 to 3, lower case, other than letters as a gap),
hashed to fixed widths. The kernel of two texts is the blended spectrum: the sum over n of shared
grams over the root of both counts. Landmarks (training texts, equally many per language) give the
Nystroem map; one-versus-rest kernel ridge regression on it is a small matrix, and batches of texts
are scored by matrix products.

Training rows: at most about ``sample`` per language, chosen by hash. Null text or no letter: ``und``
with score 0. Without training rows all is ``und``. Null doc_id: never a training row, held_out null. NUL characters are gaps.
Rows that repeat are predicted alike (and count repeatedly in training). Very long texts are read whole, 128 texts at a time.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C

WIDTHS = (512, 2048, 4096)  # hashed grams of 1, 2 and 3 characters


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0/1 per text over all widths."""
    total = sum(WIDTHS)
    out = np.zeros((len(texts), total), np.uint8)
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("\x00\x00\x00".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return out
    # Rows come from lengths: a text may itself hold NUL, which is a gap like any other than a letter.
    lengths = np.array([len(t) for t in lowered])
    row = np.repeat(np.arange(len(texts)), lengths + 3)[: len(code)]
    within = np.arange(len(code)) - np.repeat(np.cumsum(lengths + 3) - lengths - 3, lengths + 3)[: len(code)]
    used, back = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in used.tolist()])
    code = np.where(letter, used, 32).astype(np.uint64)[back]
    code[within >= lengths[row]] = 0  # between texts
    base = 0
    for n, width in enumerate(WIDTHS, 1):
        h = np.zeros(len(code) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : len(code) - n + 1 + k]
        h = C.mix(h) % np.uint64(width)
        ok = code[: len(h)] != 0
        for k in range(1, n):
            ok &= code[k : len(h) + k] != 0
        out[row[: len(h)][ok], base + h[ok].astype(np.int64)] = 1
        base += width
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Blended spectrum kernel of rows of presence vectors."""
    total, base = 0.0, 0
    for width in WIDTHS:
        x, y = a[:, base : base + width].astype(np.float32), b[:, base : base + width].astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(y.sum(1), 1))[None, :]
        total = total + (x @ y.T) / norm
        base += width
    return total / len(WIDTHS)


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], landmarks: int, ridge: float = 1e-2):
        self.langs = sorted(set(langs))
        y = np.array([[1.0 if v == l else -1.0 for l in self.langs] for v in langs])
        each = max(1, landmarks // len(self.langs))
        pick = np.concatenate([np.flatnonzero(y[:, i] > 0)[:each] for i in range(len(self.langs))])
        self.marks = x[pick]
        values, vectors = np.linalg.eigh(kernel(self.marks, self.marks).astype(np.float64))
        good = values > 1e-6 * values.max()
        map_ = vectors[:, good] / np.sqrt(values[good])
        phi = np.column_stack([kernel(x, self.marks) @ map_, np.ones(len(x))])
        weights = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
        self.weights, self.intercept = map_ @ weights[:-1], weights[-1]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = kernel(x, self.marks) @ self.weights + self.intercept
        return out.argmax(1), np.clip((out.max(1) + 1) / 2, 0, 1)


def learn(docs: DataFrame, sample: int = 600, landmarks: int = 128) -> Model | None:
    """A model from rows with a language outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.filter("lang is not null and doc_id is not null and text is not null")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rates = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, sample / n))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    rows = rows.filter(part < rates[F.col("lang")])

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                x = presence(batch.column("text").slice(lo, 64).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, 64), batch.column("lang").slice(lo, 64), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["doc_id", "lang", "x"]
                )

    got = rows.mapInArrow(vectors, "doc_id long, lang string, x binary").toPandas().sort_values(["doc_id", "lang"])
    got = got[[len(x) > 0 for x in got.x]]
    if not len(got):
        return None
    x = np.unpackbits(np.frombuffer(b"".join(got.x), np.uint8).reshape(len(got), -1), axis=1)[:, : sum(WIDTHS)]
    return Model(x, got.lang.tolist(), landmarks)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs`` (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                texts = [t or "" for t in batch.column("text").slice(lo, 128).to_pylist()]
                letters = np.array([any(map(str.isalpha, t[:256])) or any(map(str.isalpha, t)) for t in texts])
                if model is None:
                    names, score = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    best, score = model(presence(texts))
                    names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters)]
                    score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 128), pa.array(names), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
