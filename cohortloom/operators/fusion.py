"""Multi-view fusion of per-layer consensus kernels.

A sample carries one label history per layer; layer kernels and their weighted
sum are evaluated tile by tile from these histories, so no fused n x n matrix is
stored. The weight search touches only eigenvalues and quadratic forms.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import kernels
from cohortloom.operators.consensus import consensus_block, unpack_history
from cohortloom.operators.lloyd import lloyd_rows
from cohortloom.operators.spectral import tile_product
from cohortloom.operators.tiles import TILE_ROWS, block_count, spread, to_tiles
from cohortloom.session import cut

logger = logging.getLogger(__name__)

PULL = 0.05  # fixed value: weight of the pull towards CKA-informed weights


def join_views(hists: dict[str, DataFrame]) -> DataFrame:
    """``(id, s0, s1, ...)`` for ids present in every layer, layers in given order."""
    parts = [h.select("id", F.col("sig").alias(f"s{i}")) for i, h in enumerate(hists.values())]
    return reduce(lambda a, b: a.join(b, "id"), parts)


def view_profiles(views: DataFrame) -> DataFrame:
    """``(id, w, s0, s1, ...)``: equal histories in every layer as one row, named by the first member.

    A kernel value depends on the two histories alone, so copies have equal rows of every layer kernel.
    """
    sigs = [c for c in views.columns if c != "id"]
    return views.groupBy(*sigs).agg(F.min("id").alias("id"), F.count("*").cast("double").alias("w")).select("id", "w", *sigs)


def _layer_block(i: int, n_algos: int) -> Callable:
    return lambda r, c: consensus_block(unpack_history(r[f"s{i}"]), unpack_history(c[f"s{i}"]), n_algos)


def fused_block(weights: Sequence[float], n_algos: int) -> Callable:
    blocks = [(w, _layer_block(i, n_algos)) for i, w in enumerate(weights)]
    return lambda r, c: sum(w * f(r, c) for w, f in blocks)


def cka_table(views: DataFrame, names: Sequence[str], n_algos: int, n_rows: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(layer_a, layer_b, hsic, cka)`` for all ordered layer pairs.

    Centring is algebraic: a tile contributes row sums per layer and the sums of
    elementwise kernel products, nothing of pair size leaves it. Copies are one weighted row.
    """
    names = list(names)
    L = len(names)
    blocks = [_layer_block(i, n_algos) for i in range(L)]

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        r = pdf[pdf["blk"] == bi]
        c = r if bi == bj else pdf[pdf["blk"] == bj]
        if not len(r) or not len(c):
            return pd.DataFrame(columns=["id", "w", "v"])
        ks = [f(r, c) for f in blocks]
        wr, wc = r["w"].to_numpy(float), c["w"].to_numpy(float)
        prod = np.array([[wr @ (a * b) @ wc for b in ks] for a in ks]).ravel() * (1 if bi == bj else 2)
        out = []
        for d, side in ((r, 1),) if bi == bj else ((r, 1), (c, 0)):
            v = np.zeros((len(d), L + L * L))
            v[:, :L] = np.stack([k @ wc if side else wr @ k for k in ks], axis=1)
            out.append(pd.DataFrame({"id": d["id"].to_numpy(), "w": d["w"].to_numpy(float), "v": list(v)}))
        out[0]["v"].iloc[0][L:] = prod
        return pd.concat(out)

    profiles = cut(view_profiles(views))
    n_blocks = block_count(profiles.count(), tile_rows)
    parts = spread(to_tiles(profiles, n_blocks), 1 << 30, "bi", "bj").groupBy("bi", "bj").applyInPandas(
        tile, "id string, w double, v array<double>"
    )
    by_id = parts.groupBy("id").agg(F.max("w").alias("w"), *[F.sum(F.element_at("v", i + 1)).alias(f"v{i}") for i in range(L + L * L)])
    cells = [
        F.struct(
            F.lit(a).alias("layer_a"),
            F.lit(b).alias("layer_b"),
            (
                F.sum(f"v{L + i * L + j}")
                - 2 * F.sum(F.col("w") * F.col(f"v{i}") * F.col(f"v{j}")) / n_rows
                + F.sum(F.col("w") * F.col(f"v{i}")) * F.sum(F.col("w") * F.col(f"v{j}")) / (float(n_rows) * n_rows)
            ).alias("t"),
        )
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    scale = max((n_rows - 1.0) ** 2, 1.0)
    t = by_id.agg(F.array(*cells).alias("q")).select(F.explode("q").alias("q")).select("q.layer_a", "q.layer_b", (F.col("q.t") / scale).alias("hsic"))
    self_a = t.where(F.col("layer_a") == F.col("layer_b")).select("layer_a", F.greatest("hsic", F.lit(1e-12)).alias("ha"))
    self_b = self_a.select(F.col("layer_a").alias("layer_b"), F.col("ha").alias("hb"))
    cka = F.when(F.col("layer_a") == F.col("layer_b"), 1.0).otherwise(F.col("hsic") / F.sqrt(F.col("ha") * F.col("hb")))
    return t.join(self_a, "layer_a").join(self_b, "layer_b").select("layer_a", "layer_b", "hsic", cka.alias("cka"))


# ------------------------------------------------------------------ weights


def to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = np.cumsum(u) - 1
    r = np.nonzero(u - c / np.arange(1, len(u) + 1) > 0)[0][-1]
    return np.maximum(v - c[r] / (r + 1), 0)


def ascend(gap: Callable, inform: np.ndarray, steps: int = 40) -> np.ndarray:
    """Projected gradient ascent of ``gap(w) - PULL |w - inform|^2`` on the simplex from uniform.

    ``gap(w)`` returns the eigengap quality and its gradient.
    """
    w = np.full(len(inform), 1 / len(inform))
    q, grad = gap(w)
    best = q - PULL * ((w - inform) ** 2).sum()
    for _ in range(steps):
        g = grad - 2 * PULL * (w - inform)
        g -= g.mean()
        size, step, moved = np.linalg.norm(g), 0.5, False
        while size > 1e-9 and step > 1e-4:
            cand = to_simplex(w + step * g / size)
            q, cg = gap(cand)
            value = q - PULL * ((cand - inform) ** 2).sum()
            if value > best + 1e-8:
                w, grad, best, moved = cand, cg, value, True
                break
            step /= 4
        if not moved:
            break
    return w


def _quality(vals: np.ndarray, quad: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Gap ratio lambda_k / (|lambda_k+1| + 1e-9) and its gradient from per-layer quadratic forms."""
    low = abs(vals[k]) + 1e-9
    return vals[k - 1] / low, quad[:, 0] / low - vals[k - 1] * np.sign(vals[k]) * quad[:, 1] / low**2


def optimise_weights(
    views: DataFrame, cka: DataFrame, names: Sequence[str], n_algos: int, n_rows: int, k: int, tile_rows: int = TILE_ROWS
) -> list[tuple[str, float, float]]:
    """``(layer, weight, mean CKA)``; the tables involved are layers x layers."""
    names = list(names)
    mean = {r["layer_a"]: r["m"] for r in cka.groupBy("layer_a").agg(F.avg("cka").alias("m")).collect()}
    cka_mean = np.array([mean[n] for n in names])
    inform = np.maximum(0, cka_mean)
    inform = inform / max(inform.sum(), 1e-12)
    L = len(names)
    profiles = cut(view_profiles(views))
    largest = profiles.count()
    if largest <= tile_rows:
        def local(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            root = np.sqrt(pdf["w"].to_numpy(float))
            mats = [_layer_block(i, n_algos)(pdf, pdf) * np.outer(root, root) for i in range(L)]

            def gap(w):
                vals, vecs = np.linalg.eigh(sum(a * m for a, m in zip(w, mats)))
                return _ritz_gap(vals, np.array([(vecs * (m @ vecs)).sum(0) for m in mats]), k, n_rows)

            return pd.DataFrame({"w": [ascend(gap, inform)]})

        one = profiles.withColumn("one", F.lit(1)).groupBy("one")
        w = np.asarray(one.applyInPandas(local, "w array<double>").first()["w"])
    else:
        scaled = profiles.withColumn("f", F.sqrt("w")).withColumn("loop", F.lit(0.0)).drop("w")
        blocks = [_layer_block(i, n_algos) for i in range(L)]
        w, _ = _search_in_basis(scaled, blocks, lambda gap: ascend(gap, inform), n_rows, k, block_count(largest, tile_rows))
    return sorted(zip(names, w.tolist(), cka_mean.tolist()), key=lambda t: -t[1])


def _ritz_gap(vals: np.ndarray, quad: np.ndarray, k: int, n_rows: int) -> tuple[float, np.ndarray]:
    """Quality of ascending eigenvalues of weighted profiles; the copies they stand for add eigenvalues of 0."""
    spare = min(max(n_rows - len(vals), 0), k + 1)
    vals, quad = np.append(vals, np.zeros(spare)), np.hstack([quad, np.zeros((len(quad), spare))])
    order = np.argsort(-vals, kind="stable")
    vals, quad = vals[order], quad[:, order]
    if len(vals) <= k:
        return float(vals[0]), quad[:, 0]
    return _quality(vals, quad[:, [k - 1, k]], k)


def _products(rows: DataFrame, blocks: Sequence[Callable], n_blocks: int) -> DataFrame:
    """``(id, p)``: every kernel, scaled by ``f`` on both sides, times ``new``, kernel after kernel; a tile evaluates each once."""

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        r = pdf[pdf["blk"] == bi]
        c = r if bi == bj else pdf[pdf["blk"] == bj]
        if not len(r) or not len(c):
            return pd.DataFrame(columns=["id", "p"])
        ks = [f(r, c) for f in blocks]
        out = []
        for a, b, flip in ((r, c, False),) if bi == bj else ((r, c, False), (c, r, True)):
            x = np.stack(b["new"].to_list()) * b["f"].to_numpy(float)[:, None]
            y = np.hstack([(m.T if flip else m) @ x for m in ks]) * a["f"].to_numpy(float)[:, None]
            out.append(pd.DataFrame({"id": a["id"].to_numpy(), "p": list(y)}))
        return pd.concat(out)

    parts = spread(to_tiles(rows, n_blocks), 1 << 30, "bi", "bj").groupBy("bi", "bj").applyInPandas(tile, "id string, p array<double>")
    cells = parts.select("id", F.posexplode("p").alias("at", "v")).groupBy("id", "at").agg(F.sum("v").alias("v"))
    return cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("p"))


def _inner(state: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Inner products of all columns of the vectors in ``cols``, side by side."""

    def part(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                m = np.hstack([np.stack(pdf[c].to_list()) for c in cols])
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    got = state.select(*cols).mapInPandas(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    size = int(round(np.sqrt(len(got))))
    return got.sort_values("at")["v"].to_numpy().reshape(size, size)


BASIS, PASSES, RESIDUAL = 120, 60, 1e-6


def _search_in_basis(profiles: DataFrame, blocks: Sequence[Callable], search: Callable, n_rows: int, k: int, n_blocks: int):
    """``search(gap)`` over weighted sums of kernels larger than a tile, and the leading ``k + 1`` vectors ``(id, v)`` at its last weights.

    ``profiles`` has ``f`` (scale of a row on either side) and ``loop`` (taken off the diagonal). The products of every
    kernel with a common basis give the eigenvalues of all weighted sums as small matrices on the driver, and the residual
    of every eigenpair. The whole search runs on these; each pass over the tiles adds the residuals of the weights where
    they are largest, until at all weights that the search tries the leading ``k + 1`` pairs reach ``RESIDUAL``. So the
    passes do not grow with the number of weights tried.
    """
    L, dims = len(blocks), k + 3
    sigs = [c for c in profiles.columns if c not in ("id", "f", "loop")]
    ys = [f"y{i}" for i in range(L)]
    start = [F.pmod(F.xxhash64(F.lit(1), F.lit(d), F.col("id")), F.lit(1 << 40)) / float(1 << 40) - 0.5 for d in range(dims)]
    empty = F.array().cast("array<double>")
    state = profiles.select("id", "f", "loop", *sigs, empty.alias("z"), *[empty.alias(y) for y in ys], F.array(*start).alias("new"))
    schema = state.schema

    def stepped(state: DataFrame, turn, mix) -> DataFrame:
        """Basis times ``turn`` (none: kept), and as ``new`` the sum of basis and products times ``mix``."""

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                parts = [np.stack(pdf[c].to_list()) for c in ("z", *ys)]
                pdf = pdf.copy()
                pdf["new"] = list(np.hstack(parts) @ mix)
                if turn is not None:
                    for c, m in zip(("z", *ys), parts):
                        pdf[c] = list(m @ turn)
                yield pdf

        return state.mapInPandas(run, schema)

    for _ in range(PASSES):
        state = cut(state)
        state = state.join(_products(state.select("id", "f", "new", *sigs), blocks, n_blocks), "id").select(
            "id", "f", "loop", *sigs, F.concat("z", "new").alias("z"),
            *[F.concat(y, F.zip_with(F.slice("p", i * dims + 1, dims), "new", lambda a, b: a - F.col("loop") * b)).alias(y) for i, y in enumerate(ys)], "new",
        )
        state = cut(state)
        g = _inner(state, ["z", *ys])
        m = len(g) // (L + 1)
        cell = lambda i, j: g[i * m : (i + 1) * m, j * m : (j + 1) * m]
        size = np.sqrt(np.maximum(np.diag(cell(0, 0)), 1e-300))
        s, u = np.linalg.eigh(cell(0, 0) / np.outer(size, size))
        on = s > 1e-9 * s[-1]
        basis = (u[:, on] / np.sqrt(s[on])) / size[:, None]
        forms = [basis.T @ (cell(0, i + 1) + cell(0, i + 1).T) @ basis / 2 for i in range(L)]
        moved = [[basis.T @ cell(i + 1, j + 1) @ basis for j in range(L)] for i in range(L)]
        tried = []

        def gap(w):
            vals, vecs = np.linalg.eigh(sum(a * f for a, f in zip(w, forms)))
            top = vecs[:, ::-1][:, : k + 1]
            image = sum(a * b * moved[i][j] for i, a in enumerate(w) for j, b in enumerate(w))
            left = np.maximum((top * (image @ top)).sum(0) - vals[::-1][: k + 1] ** 2, 0)
            tried.append((np.sqrt(left.max()) / max(abs(vals[-1]), 1e-300), w, vals[::-1][: k + 1], top))
            return _ritz_gap(vals, np.array([(vecs * (f @ vecs)).sum(0) for f in forms]), k, n_rows)

        w, worst = search(gap), []
        for t in sorted(tried, key=lambda t: -t[0]):
            if t[0] > RESIDUAL and len(worst) < 3 and all(np.abs(t[1] - o[1]).max() > 1e-3 for o in worst):
                worst.append(t)
        if not worst:
            break
        mix = []
        for _, at, vals, top in worst:
            c = basis @ top
            r = np.vstack([-c * vals, *[a * c for a in at]])
            mix.append(r / np.sqrt(np.maximum((r * (g @ r)).sum(0), 1e-300)))
        mix, turn = np.hstack(mix), None
        dims = mix.shape[1]
        if m + dims > BASIS:
            turn = basis @ np.linalg.qr(np.hstack([t[3] for t in worst]))[0]
        state = stepped(state, turn, mix)
    else:
        logger.warning("eigenvalues still moved after %d passes", PASSES)
    gap(w)
    last = np.vstack([basis @ tried[-1][3], np.zeros((L * m, tried[-1][3].shape[1]))])
    return w, stepped(state, None, last).select("id", F.col("new").alias("v"))


def fused_clusters(
    views: DataFrame, weights: Sequence[float], n_algos: int, ks: Sequence[int], n_rows: int, seed: int = 42, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """``(k, id, label)`` of spectral clustering on the weighted kernel, for every candidate k. Copies are one weighted row."""
    ks, block = list(ks), fused_block(list(weights), n_algos)
    profiles = cut(view_profiles(views))
    largest = profiles.count()
    rows = profiles.select(F.lit(0).alias("g"), "*")
    if largest <= tile_rows:
        def local(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            lab = kernels.spectral_labels(block(pdf, pdf), pdf["w"].to_numpy(float), ks, seed, 0, pdf["id"].tolist())
            return pd.DataFrame({"g": 0, "id": pdf["id"].to_numpy(), "labels": list(lab.T)})

        out = rows.groupBy("g").applyInPandas(local, "g int, id string, labels array<int>")
    else:
        n_blocks = block_count(largest, tile_rows)
        own = tile_product(rows, block, n_blocks, lambda b: b["w"].to_numpy(float)[:, None], 1).select("id", F.element_at("y", 2).alias("own"), F.element_at("y", 1).alias("sum"))
        degree = F.col("sum") - F.col("own")
        scaled = profiles.join(own, "id").withColumn("scale", F.when(degree > 0, F.sqrt(degree)).otherwise(1.0))
        scaled = cut(scaled.withColumn("f", F.sqrt("w") / F.col("scale")).withColumn("loop", F.col("own") / F.pow("scale", F.lit(2))))
        one = np.ones(1)
        _, vecs = _search_in_basis(scaled.drop("w", "own", "sum", "scale"), [block], lambda gap: gap(one) and one, largest, max(ks) - 1, n_blocks)
        emb = scaled.join(vecs, "id").select(F.lit(0).alias("g"), "id", "w", F.expr("transform(v, e -> e / (sqrt(w) * scale))").alias("v"))
        out = lloyd_rows(cut(emb), ks, seed, 10, False, largest, use_dims=True)
    sigs = [c for c in views.columns if c != "id"]
    named = profiles.select(F.col("id").alias("pid"), *sigs).join(out.select(F.col("id").alias("pid"), "labels"), "pid")
    return views.join(named, sigs).select("id", F.posexplode("labels").alias("q", "label")).select(
        F.get(F.lit(ks), F.col("q")).cast("int").alias("k"), "id", "label"
    )


def guess_k(cluster_counts: DataFrame, n_rows: int) -> int:
    """Median number of clusters over layers ``(layer, n)``, clamped to [2, n - 1]."""
    m = cluster_counts.agg(F.floor(F.median("n")).alias("m")).first()["m"]
    return max(2, min(int(m), n_rows - 1))
