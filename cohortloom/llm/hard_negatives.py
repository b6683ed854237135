"""Hard negatives by angular triangle filtering (op 13).

Vectors are scaled to integers, q = floor(256 x), and scored by integer inner products. Every row stores its
norm and its angles to ``REFERENCES`` directions (sums of the vectors of label groups). The triangle
inequality on the sphere bounds the angle between an anchor and a row by their angles to each direction:
|a - b| <= angle <= min(a + b, 2 pi - a - b). Cosines of these ends times the norms, widened by more than
the rounding of either, bound the score, so a score that can matter lies in one window of the rows sorted by
angle; the narrowest window over the directions is taken, the other directions thin it out, and only what is
left is scored exactly.

Anchors (a stated query set, ``vec_id`` divisible by ``every``) meet all rows in cells: rows fall into cells by
a hash, ``CELL`` rows each whatever the labels or copies are, anchors into chunks of at most about ``CHUNK``.
A cell returns at most a few rows per anchor, merged by a window per anchor. One pass finds the positives, one the negatives.

Rows with a null label, a null vector, or a null or non-finite component (also: 256 x beyond a double) take no part. Vectors of other
length than the anchor's are not compared with it. A null vec_id is no anchor and ranks after equal scores with
an id. Rows that repeat are rows of their own (also as anchors). A zero vector scores 0 with every row. Empty vectors
score 0 with each other. Components of any finite size are scored exactly (as Python integers where doubles would round);
scores outside a long are clamped in the output only. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.llm import common as C

REFERENCES = 16
CELL, CHUNK = 4096, 2048
ANGLE_SLACK, COS_SLACK = 1e-6, 4e-6
BIG = float(1 << 53)


def _sums(batches):
    """Per batch, label group and length: the sum of the unit vectors, a bounded table whatever the rows."""
    import pyarrow as pa

    for batch in batches:
        group, dim = batch.column("g").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy(zero_copy_only=False)
        raw = batch.column("v").to_pylist()
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            x = np.array([np.frombuffer(raw[i], np.float64) for i in at]).reshape(len(at), d)
            top = np.abs(x).max(axis=1, initial=0)
            x = x / np.where(top > 0, top, 1)[:, None]
            norm = np.sqrt((x * x).sum(axis=1))
            x = x / np.where(norm > 0, norm, 1)[:, None]
            own = np.unique(group[at])
            rows = [x[group[at] == g].sum(axis=0) for g in own]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), d)), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["g", "dim", "s"])


def directions(refs: dict[int, np.ndarray], d: int) -> np.ndarray:
    """Unit directions for vectors of length ``d``; coordinate axes where nothing was summed."""
    if d in refs:
        return refs[d]
    return np.eye(1, d) if d else np.zeros((1, 0))


def norms_and_angles(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows and their angles to each direction; a zero row counts as orthogonal to all."""
    top = np.abs(x).max(axis=1, initial=0)
    unit = x / np.where(top > 0, top, 1)[:, None]
    norm = np.sqrt((unit * unit).sum(axis=1))
    cos = (unit / np.where(norm > 0, norm, 1)[:, None]) @ refs.T
    return norm * top, np.arccos(np.clip(cos, -1, 1))


def exact_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of ``a`` with the rows of ``x``: float64 where it is exact, else Python integers."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), np.int64)
    if np.abs(a).max() * np.abs(x).max() * len(a) < BIG:
        return (x @ a).astype(np.int64)
    own = [int(v) for v in a]
    return np.array([sum(int(p) * q for p, q in zip(row, own)) for row in x.tolist()], dtype=object)


class Cell:
    """Rows of a cell with their bounds; ``rid`` orders nothing, it only tells rows apart."""

    def __init__(self, table):
        self.rid = table.column("rid").to_numpy()
        self.label = table.column("label").to_numpy()
        self.has_id = table.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        self.vec_id = table.column("vec_id").fill_null(0).to_numpy()
        n = len(self.rid)
        self.x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(n, -1)
        self.norm = table.column("norm").to_numpy()
        self.angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), np.float64).reshape(n, -1)
        self.order = np.argsort(self.angles, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.angles, self.order, axis=0)
        self.most = self.norm.max(initial=0)

    def window(self, anchor: int, other: "Cell", low: float) -> np.ndarray:
        """Rows of ``other`` whose angles to one direction allow a score of ``low``: the narrowest window."""
        scale = self.norm[anchor] * other.most
        if low <= 0 or not scale > 0:
            return np.arange(len(other.rid))
        wide = np.arccos(np.clip(low / scale - COS_SLACK, -1, 1)) + ANGLE_SLACK
        if low / scale > 1 + COS_SLACK:
            return np.zeros(0, np.int64)
        own, best = self.angles[anchor], None
        for r in range(len(own)):
            i = np.searchsorted(other.sorted[:, r], own[r] - wide, "left")
            j = np.searchsorted(other.sorted[:, r], own[r] + wide, "right")
            if best is None or j - i < best[1] - best[0]:
                best = (i, j, r)
        return other.order[best[0] : best[1], best[2]]

    def bounds(self, anchor: int, other: "Cell", rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the angles to all directions allow."""
        a, b = self.angles[anchor], other.angles[rows]
        near = np.abs(b - a).max(axis=1)
        far = np.minimum(a + b, 2 * np.pi - a - b).min(axis=1)
        scale = self.norm[anchor] * other.norm[rows]
        slack = COS_SLACK * scale + 1e-3
        return scale * np.cos(np.minimum(far + ANGLE_SLACK, np.pi)) - slack, scale * np.cos(np.maximum(near - ANGLE_SLACK, 0)) + slack

    def ranked(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Positions by falling score, then by vec_id, null last."""
        return np.lexsort((self.rid[rows], self.vec_id[rows], ~self.has_id[rows], -scores)) if scores.dtype != object else np.array(
            sorted(range(len(rows)), key=lambda i: (-scores[i], not self.has_id[rows[i]], self.vec_id[rows[i]], self.rid[rows[i]])), np.int64
        )


OFFSET = 1 << 319  # scores as 40 bytes that sort as numbers
OUT = "rid long, other long, vec_id long, key binary, score long"


def _printed(s) -> tuple[bytes, int]:
    """A score as sortable bytes, and clamped to a long."""
    s = int(s)
    return (s + OFFSET).to_bytes(40, "big"), max(-(1 << 63), min((1 << 63) - 1, s))


def best_positives(anchors: Cell, cell: Cell, k: int):
    """(anchor rid, row rid, row id, score) of the ``k`` best rows of each anchor's label in this cell."""
    by = {v: np.flatnonzero(cell.label == v) for v in np.unique(anchors.label)}
    same = {v: (cell.label == v) for v in by}
    for i in range(len(anchors.rid)):
        mine = by[anchors.label[i]]
        if not len(mine):
            continue
        seeds = mine
        if len(mine) > 4 * k + 16:
            # A first guess from rows at nearly the anchor's angles.
            near = np.abs(cell.angles[mine] - anchors.angles[i]).max(axis=1)
            seeds = mine[np.argpartition(near, 2 * k + 8)[: 2 * k + 8]]
        seeds = seeds[cell.rid[seeds] != anchors.rid[i]]
        s = exact_scores(anchors.x[i], cell.x[seeds])
        if len(seeds) < len(mine) - 1 and len(s) >= k:
            low = float(sorted(s.tolist(), reverse=True)[k - 1])
            rows = anchors.window(i, cell, low)
            rows = rows[same[anchors.label[i]][rows]]
            rows = rows[anchors.bounds(i, cell, rows)[1] >= low]
            seeds = rows[cell.rid[rows] != anchors.rid[i]]
            s = exact_scores(anchors.x[i], cell.x[seeds])
        for j in cell.ranked(seeds, s)[:k]:
            yield anchors.rid[i], cell.rid[seeds[j]], seeds[j], s[j]


def best_negatives(anchors: Cell, cell: Cell, positives: list, k: int, low_pct: int, high_pct: int):
    """(anchor rid, positive rid, row rid, row, score): for each positive the ``k`` best rows of other labels in its window."""
    for i in range(len(anchors.rid)):
        own = [(p, s) for p, s in positives[i] if s >= 0]
        if not own:
            continue
        # 100 score between low_pct and high_pct of the positive's score, in whole numbers.
        ends = [(-(-low_pct * s // 100), high_pct * s // 100) for _, s in own]
        low, high = min(e[0] for e in ends), max(e[1] for e in ends)
        rows = anchors.window(i, cell, float(low))
        rows = rows[cell.label[rows] != anchors.label[i]]
        if not len(rows):
            continue
        least, most = anchors.bounds(i, cell, rows)
        fit = (most >= low) & (least <= high)
        rows, least, most = rows[fit], least[fit], most[fit]
        if len(rows) > 64:
            # The k best of some rows raise what is asked of the others.
            seeds = rows[np.argpartition(-least, 31)[:32]]
            s = exact_scores(anchors.x[i], cell.x[seeds])
            need = []
            for a, b in ends:
                inside = sorted((v for v in s.tolist() if a <= v <= b), reverse=True)
                need.append(inside[k - 1] if len(inside) >= k else a)
            rows = rows[most >= min(need)]
        s = exact_scores(anchors.x[i], cell.x[rows])
        ranked = cell.ranked(rows, s)
        rows, s = rows[ranked], s[ranked]
        for (p, _), (a, b) in zip(own, ends):
            for j in np.flatnonzero((s >= a) & (s <= b))[:k]:
                yield anchors.rid[i], p, cell.rid[rows[j]], rows[j], s[j]


def _table(columns: dict, schema):
    import pyarrow as pa

    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _positives(k: int):
    import pyarrow as pa

    schema = pa.schema([("rid", pa.int64()), ("other", pa.int64()), ("vec_id", pa.int64()), ("key", pa.binary()), ("score", pa.int64())])

    def run(left, right):
        out = {n: [] for n in schema.names}
        if len(left) and len(right):
            cell = Cell(right)
            for a, b, j, s in best_positives(Cell(left), cell, k):
                for n, v in zip(schema.names, (a, b, int(cell.vec_id[j]) if cell.has_id[j] else None, *_printed(s))):
                    out[n].append(v)
        return _table(out, schema)

    return run


def _negatives(k: int, low_pct: int, high_pct: int):
    import pyarrow as pa

    schema = pa.schema([("rid", pa.int64()), ("positive", pa.int64()), ("other", pa.int64()), ("vec_id", pa.int64()), ("key", pa.binary()), ("score", pa.int64())])

    def run(left, right):
        out = {n: [] for n in schema.names}
        if len(left) and len(right):
            cell, own = Cell(right), left.column("positives").to_pylist()
            own = [[(p["other"], int.from_bytes(p["key"], "big") - OFFSET) for p in x] for x in own]
            for a, p, b, j, s in best_negatives(Cell(left), cell, own, k, low_pct, high_pct):
                for n, v in zip(schema.names, (a, p, b, int(cell.vec_id[j]) if cell.has_id[j] else None, *_printed(s))):
                    out[n].append(v)
        return _table(out, schema)

    return run


def _prepared(rows: DataFrame) -> DataFrame:
    """``rid, vec_id, label, v`` (components as packed doubles), ``dim, norm, angles``: stored once."""
    spark = rows.sparkSession
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) != float("inf")))

    def scaled(x):
        y = x.cast("double") * 256
        # floor() gives a long; doubles beyond 2^52 are whole numbers already.
        return F.when(F.abs(y) < 2.0**52, F.floor(F.when(F.abs(y) < 2.0**52, y)).cast("double")).otherwise(y)

    good = rows.select("vec_id", "label", "embedding").filter("label is not null and embedding is not null").filter(whole)
    good = good.select("vec_id", "label", F.transform("embedding", scaled).alias("q"), F.size("embedding").alias("dim"))

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column("q")
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            v = pa.array([flat[s:e].tobytes() for s, e in zip(off[:-1], off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("dim"), b.column("g"), v], ["vec_id", "label", "dim", "g", "v"])

    good = good.withColumn("g", F.pmod(F.xxhash64("label"), F.lit(REFERENCES)).cast("int"))
    good = good.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "dim", "g", "q").mapInArrow(packed, "vec_id long, label long, dim int, g int, v binary")
    good = C.stored(good.withColumn("rid", F.monotonically_increasing_id()), "negatives-rows")
    # The directions: at most REFERENCES sums per vector length, of which there are few.
    sums = good.select("g", "dim", "v").mapInArrow(_sums, "g int, dim int, s array<double>").select("g", "dim", F.posexplode("s").alias("i", "x"))
    sums = sums.groupBy("dim", "g", "i").agg(F.sum("x").alias("x")).groupBy("dim", "g").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    refs: dict[int, list] = {}
    for r in sums.select("dim", "s.x").collect():
        refs.setdefault(r.dim, []).append(r.x)
    units = {}
    for d, m in refs.items():
        m = np.array(m, np.float64)
        n = np.sqrt((m * m).sum(axis=1))
        units[d] = m[n > 1e-9] / n[n > 1e-9][:, None] if (n > 1e-9).any() else np.eye(1, d)
    shared = spark.sparkContext.broadcast(units)

    def measured(batches):
        import pyarrow as pa

        for b in batches:
            dim, raw = b.column("dim").to_numpy(zero_copy_only=False), b.column("v").to_pylist()
            norm, angles = np.zeros(len(raw)), [b""] * len(raw)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.array([np.frombuffer(raw[i], np.float64) for i in at]).reshape(len(at), d)
                norm[at], turned = norms_and_angles(x, directions(shared.value, int(d)))
                for i, t in zip(at, turned):
                    angles[i] = t.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "vec_id", "label", "dim", "v")), pa.array(norm), pa.array(angles, pa.binary())], ["rid", "vec_id", "label", "dim", "v", "norm", "angles"])

    return C.stored(good.mapInArrow(measured, "rid long, vec_id long, label long, dim int, v binary, norm double, angles binary"), "negatives-angles")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``."""
    data = _prepared(rows)
    sizes = data.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("a"))
    # One row per vector length.
    sizes = sizes.select("dim", F.ceil(F.col("n") / CELL).alias("cells"), F.ceil(F.col("a") / CHUNK).alias("chunks"))
    sizes = C.stored(sizes, "negatives-sizes")
    data = data.join(sizes, "dim")
    cells = data.withColumn("cell", F.pmod(F.xxhash64("rid"), F.col("cells"))).withColumn("chunk", F.explode(F.when(F.col("chunks") > 0, F.sequence(F.lit(1), F.col("chunks"))).otherwise(F.array().cast("array<bigint>"))))
    keys = ["dim", "chunk", "cell"]
    cells = cells.select(*keys, "rid", "vec_id", "label", "v", "norm", "angles")
    anchors = data.filter(F.col("vec_id") % every == 0).withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("chunks")) + 1)
    anchors = anchors.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    anchors = anchors.select(*keys, "rid", "vec_id", "label", "v", "norm", "angles")

    def met(left, run, schema):
        # Both sides come from one table: new names for the columns of each.
        a, b = left.toDF(*left.columns), cells.toDF(*cells.columns)
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)

    def ordered(*by):
        return W.partitionBy(*by).orderBy(F.col("key").desc(), F.col("vec_id").asc_nulls_last(), "other")

    found = met(anchors, _positives(positives), OUT)
    found = found.withColumn("at", F.row_number().over(ordered("rid"))).filter(F.col("at") <= positives)
    found = C.stored(found.select("rid", "other", F.col("vec_id").alias("positive_id"), "key", F.col("score").alias("positive_score")), "negatives-positives")
    own = found.groupBy("rid").agg(F.collect_list(F.struct("other", "key")).alias("positives"))
    queries = anchors.join(own, "rid").select(*anchors.columns, "positives")
    missed = met(queries, _negatives(negatives, low_pct, high_pct), "rid long, positive long, other long, vec_id long, key binary, score long")
    missed = missed.withColumn("rank", F.row_number().over(ordered("rid", "positive"))).filter(F.col("rank") <= negatives)
    missed = missed.select("rid", F.col("positive").alias("other"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = data.filter(F.col("vec_id") % every == 0).select("rid", F.col("vec_id").alias("anchor_id"))
    out = missed.join(found.drop("key"), ["rid", "other"]).join(ids, "rid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh vector under the next of ten labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.select("vec_id", "embedding", label.alias("label"))
