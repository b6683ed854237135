"""ID set algebra over any number of datasets from one membership pass.

Each id is reduced to a bit mask (as many words as needed) of the datasets that contain it; unions,
intersections, pairwise overlaps and coverages are then sums over the few
distinct masks. The shuffle is one partial-aggregated group-by on id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE_HINT = "mic"  # fixed value: dataset name preferred as coverage reference
BITS = 62  # datasets per word of a mask


def id_masks(datasets: dict[str, DataFrame]) -> DataFrame:
    """``(id, mask)`` for frames with an ``id`` column, ``mask`` an array of words; NULL ids are ignored."""
    words = range(-(-len(datasets) // BITS))
    parts = [
        df.select(
            F.col("id").cast("string").alias("id"),
            *(F.lit(1 << i % BITS if i // BITS == w else 0).cast("bigint").alias(f"m{w}") for w in words),
        )
        for i, df in enumerate(datasets.values())
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.array(*(F.bit_or(f"m{w}") for w in words)).alias("mask"))
    )


def id_union(datasets: dict[str, DataFrame]) -> DataFrame:
    return id_masks(datasets).select("id")


def id_intersection(datasets: dict[str, DataFrame]) -> DataFrame:
    n = len(datasets)
    full = [(1 << min(BITS, n - w)) - 1 for w in range(0, n, BITS)]
    return id_masks(datasets).where(F.col("mask") == F.array(*(F.lit(m).cast("bigint") for m in full))).select("id")


def id_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of ``left`` absent from ``right`` (clustered ids missing in a tree)."""
    return left.select("id").distinct().join(right.select("id"), "id", "left_anti")


def _mask_counts(datasets) -> DataFrame:
    return id_masks(datasets).groupBy("mask").agg(F.count("*").alias("n"))


def _has(i: str | int) -> Column:
    """Whether dataset number ``i`` (a column or a literal) is in the mask."""
    return F.expr(f"(shiftright(mask[cast({i} div {BITS} as int)], cast({i} % {BITS} as int)) & 1) = 1")


def pairwise_overlap(datasets: dict[str, DataFrame]) -> DataFrame:
    names = list(datasets)
    pairs = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("dataset_a"), F.lit(b).alias("dataset_b")
        )
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i < j
    ]
    has_a, has_b = _has("i"), _has("j")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    counts = (
        _mask_counts(datasets)
        .select("mask", "n", F.explode(F.array(*pairs)).alias("q"))
        .select("mask", "n", "q.*")
        .groupBy("dataset_a", "dataset_b")
        .agg(
            total(has_a).alias("n_ids_a"),
            total(has_b).alias("n_ids_b"),
            total(has_a & has_b).alias("intersection"),
            total(has_a | has_b).alias("union"),
        )
    )
    i = F.col("intersection")
    return (
        counts.withColumn("jaccard", F.when(F.col("union") > 0, i / F.col("union")))
        .withColumn("recall_a_in_b", F.when(F.col("n_ids_a") > 0, i / F.col("n_ids_a")))
        .withColumn("recall_b_in_a", F.when(F.col("n_ids_b") > 0, i / F.col("n_ids_b")))
    )


def reference_dataset(names: list[str], explicit: str | None = None) -> str:
    if explicit is not None:
        return explicit
    exact = [n for n in names if n.lower() == REFERENCE_HINT]
    partial = [n for n in names if REFERENCE_HINT in n.lower()]
    return (exact[-1:] + partial + names)[0]


def coverage_against_reference(
    datasets: dict[str, DataFrame], reference: str | None = None
) -> DataFrame:
    names = list(datasets)
    ref = reference_dataset(names, reference)
    each = [F.struct(F.lit(i).alias("i"), F.lit(n).alias("dataset")) for i, n in enumerate(names)]
    mine, theirs = _has("i"), _has(names.index(ref))

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    return (
        _mask_counts(datasets)
        .select("mask", "n", F.explode(F.array(*each)).alias("q"))
        .select("mask", "n", "q.*")
        .groupBy("dataset")
        .agg(
            total(mine).alias("n_dataset"),
            total(theirs).alias("n_reference"),
            total(mine & theirs).alias("intersection"),
        )
        .select(
            "dataset",
            F.lit(ref).alias("reference"),
            "n_dataset",
            "n_reference",
            "intersection",
            F.when(F.col("n_reference") > 0, F.col("intersection") / F.col("n_reference")).alias(
                "coverage_vs_reference"
            ),
        )
    )
