"""Prediction-strength proxy: compactness of the clusters found in random test halves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.linkage import agglomerate_rows
from cohortloom.operators.resample import half_split
from cohortloom.operators.tiles import TILE_ROWS, pack_bits, width
from cohortloom.session import cut


def prediction_strength(
    rows: DataFrame, ks: Sequence[int], n_splits: int = 25, seed: int = 42, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """``k, PS_mean, PS_ci_lo, PS_ci_hi, B`` of ``(id, x)`` rows.

    A cluster's mean Hamming distance over all ordered member pairs, self pairs
    included, is ``mean_f 2 q (1 - q)`` of its prevalences, so clusters are scored
    from their centroids.
    """
    ks = sorted(ks)
    p = width(rows)
    base = rows.select(F.col("id").cast("string").alias("id"), "x", pack_bits("x").alias("bits")).withColumn("pid", F.md5("bits"))
    half = half_split(base.select("id"), n_splits, seed)
    sizes = half.groupBy("run").agg(F.count_if(F.col("half") == "train").alias("a"), F.count_if(F.col("half") == "test").alias("t"))
    test = half.where("half = 'test'").select("run", "id").join(base.select("id", "pid"), "id")
    profiles = base.groupBy("pid").agg(F.max("bits").alias("bits"), F.max("x").alias("x"))
    work = (
        test.groupBy(F.col("run").alias("g"), "pid")
        .agg(F.count("*").alias("w"))
        .join(profiles, "pid")
        .select("g", F.col("pid").alias("id"), "w", "bits", "x")
    )
    work = cut(work)
    lab = cut(agglomerate_rows(work.select("g", "id", "w", "bits"), p, ks, tile_rows))
    lab = lab.select("g", "id", F.posexplode("labels").alias("q", "label")).withColumn("k", F.get(F.lit(ks), F.col("q")))
    size = lab.join(work.select("g", "id", "w"), ["g", "id"]).groupBy("g", "k", "label").agg(F.sum("w").alias("n"))
    ones = (
        lab.join(work.select("g", "id", "w", "x"), ["g", "id"])
        .select("g", "k", "label", "w", F.posexplode("x").alias("f", "v"))
        .groupBy("g", "k", "label", "f")
        .agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    )
    q = F.col("s") / F.col("n")
    score = (
        ones.join(size, ["g", "k", "label"])
        .where(F.col("n") >= 2)
        .groupBy("g", "k", "label")
        .agg((1 - F.avg(2 * q * (1 - q))).alias("ps"))
        .groupBy("g", "k")
        .agg(F.min("ps").alias("ps"))
        .join(sizes.withColumnRenamed("run", "g"), "g")
        .where((F.col("a") >= F.col("k")) & (F.col("t") >= F.col("k")))
    )
    return score.groupBy("k").agg(
        F.avg("ps").alias("PS_mean"),
        F.percentile("ps", F.lit(0.025)).alias("PS_ci_lo"),
        F.percentile("ps", F.lit(0.975)).alias("PS_ci_hi"),
        F.count("*").alias("B"),
    )
