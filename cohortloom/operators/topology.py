"""Persistent homology of a bounded random subsample (Hamming, Vietoris-Rips).

The subsample size is the operator's own parameter, so the group handed to the
kernel is bounded by it, whatever the layer's size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import kernels
from cohortloom.operators.resample import ranked
from cohortloom.operators.tiles import pack_bits, unpack_bits, width


def component_bars(d: np.ndarray) -> list[tuple[float, float]]:
    """Dimension 0: minimum spanning tree edges of positive length, and one infinite bar."""
    n = len(d)
    if n == 0:
        return []
    near, seen, out = d[0].copy(), np.zeros(n, bool), []
    seen[0] = True
    for _ in range(n - 1):
        j = int(np.argmin(np.where(seen, np.inf, near)))
        if near[j] > 0:
            out.append((0.0, float(near[j])))
        seen[j] = True
        near = np.minimum(near, d[j])
    return sorted(out, key=lambda b: b[1]) + [(0.0, np.inf)]


def loop_bars(d: np.ndarray) -> list[tuple[float, float]]:
    """Dimension 1 by reducing coboundary columns of edges, latest edge first.

    Edges above the enclosing radius cannot matter; tree edges are cleared.
    """
    n = len(d)
    if n < 3:
        return []
    reach = d.max(1).min()
    i, j = np.triu_indices(n, 1)
    keep = d[i, j] <= reach
    edges = sorted(zip(d[i, j][keep].tolist(), i[keep].tolist(), j[keep].tolist()))
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    cycles = []
    for e in edges:
        a, b = find(e[1]), find(e[2])
        if a == b:
            cycles.append(e)
        root[a] = b

    def coboundary(e):
        w = np.maximum(e[0], np.maximum(d[e[1]], d[e[2]]))
        return [(float(w[k]), *sorted((e[1], e[2], k))) for k in np.nonzero(w <= reach)[0].tolist() if k not in (e[1], e[2])]

    owner, bars = {}, []
    for e in reversed(cycles):
        heap = coboundary(e)
        heapq.heapify(heap)
        parts, low = [e], None
        while heap:
            low = heapq.heappop(heap)
            if heap and heap[0] == low:
                heapq.heappop(heap)
                low = None
                continue
            if low not in owner:
                break
            for f in owner[low]:
                parts.append(f)
                for t in coboundary(f):
                    heapq.heappush(heap, t)
            heapq.heappush(heap, low)
            low = None
        if low is None:
            bars.append((e[0], np.inf))
            continue
        owner[low] = parts
        if low[0] > e[0]:
            bars.append((e[0], low[0]))
    return sorted(bars)


def persistence_diagram(rows: DataFrame, max_dim: int = 1, n_sub: int = 200, seed: int = 42) -> DataFrame:
    """``(Dim, Birth, Death)`` bars of at most ``n_sub`` hash-sampled rows of ``(id, x)``."""
    if max_dim > 1:
        raise ValueError("dimensions above 1 are not supported")
    p = width(rows)
    pick = ranked(rows.select("id"), 1, seed).where(F.col("rnk") <= n_sub).select("id")
    part = rows.join(pick, "id", "left_semi").select(F.lit(0).alias("g"), "id", pack_bits("x").alias("bits"))

    def bars(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack_bits(pdf.sort_values("id")["bits"], p)
        d = kernels.mean_hamming(x, np.ones(len(x)))
        np.fill_diagonal(d, 0)
        d = np.round(d, 12)
        found = [(0, *b) for b in component_bars(d)]
        if max_dim >= 1:
            found += [(1, *b) for b in loop_bars(d)]
        return pd.DataFrame(found, columns=["Dim", "Birth", "Death"])

    return part.groupBy("g").applyInPandas(bars, "Dim int, Birth double, Death double")


def topology_summary(diagram: DataFrame) -> DataFrame:
    """``Dim, Betti, Total_Persistence, Persistence_Entropy``: finite bars, nats."""
    finite = F.col("Death") < float("inf")
    life = F.when(finite & (F.col("Death") > F.col("Birth")), F.col("Death") - F.col("Birth"))
    t = diagram.withColumn("life", life).groupBy("Dim").agg(
        F.count_if(finite).alias("Betti"),
        F.coalesce(F.sum("life"), F.lit(0.0)).alias("Total_Persistence"),
        F.sum(F.col("life") * F.log("life")).alias("xl"),
    )
    tp = F.col("Total_Persistence")
    entropy = F.when(tp > 0, F.log(tp) - F.col("xl") / tp).otherwise(0.0)
    return t.select("Dim", "Betti", "Total_Persistence", F.greatest(F.lit(0.0), entropy).alias("Persistence_Entropy"))
