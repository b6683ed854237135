"""Enrichment tests, multiple-testing correction and effect sizes per feature x cluster.

Inputs are the (feature, label) count tables of ``information``; cluster-versus-
rest numbers come from totals minus the cluster, so no second pass over samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.special import abs_quantile_of_half_p, fisher_p, normal_two_sided

MIN_CLUSTER_FOR_Z = 30  # fixed value
Z_PREVALENCE = (0.05, 0.95)  # fixed values


def with_rest(counts: DataFrame) -> DataFrame:
    """Add feature totals ``n_all``, ``ones`` to ``(feature, label, n, n1)``."""
    totals = counts.groupBy("feature").agg(F.sum("n").alias("n_all"), F.sum("n1").alias("ones"))
    return counts.join(totals, "feature")


def enrichment_tests(counts: DataFrame) -> DataFrame:
    """Unadjusted rows ``feature, label, Prev_Global, Prev_Cluster, Z, P, Test``."""
    t = (
        with_rest(counts)
        .withColumn("pg", F.col("ones") / F.col("n_all"))
        .withColumn("pc", F.col("n1") / F.col("n"))
    )
    use_z = (F.col("n") >= MIN_CLUSTER_FOR_Z) & F.col("pg").between(*Z_PREVALENCE)
    se = F.sqrt(F.col("pg") * (1 - F.col("pg")) / F.col("n"))
    t = t.withColumn("Test", F.when(use_z, "z").otherwise("fisher"))
    t = t.withColumn("z0", F.when(use_z, (F.col("pc") - F.col("pg")) / se))
    a = F.rint(F.col("n1"))
    c = F.greatest(F.lit(0.0), F.rint(F.col("ones")) - a)
    d = F.greatest(F.lit(0.0), F.col("n_all") - F.col("n") - c)
    # two branches, so the exact test only runs on the rows that need it
    z_rows = t.where(use_z).withColumn("P", normal_two_sided("z0")).withColumn("z1", F.col("z0"))
    exact = t.where(~use_z).withColumn("P", fisher_p(a, F.col("n") - a, c, d))
    sign = F.when(F.col("pc") >= F.col("pg"), 1.0).otherwise(-1.0)
    exact = exact.withColumn(
        "z1", F.when(F.col("P") > 0, sign * abs_quantile_of_half_p("P")).otherwise(0.0)
    )
    return z_rows.unionByName(exact).select(
        F.col("feature").alias("Feature"),
        F.col("label").alias("Cluster"),
        F.bround("pg", 4).alias("Prev_Global"),
        F.bround("pc", 4).alias("Prev_Cluster"),
        F.bround("z1", 4).alias("Z"),
        "P",
        "Test",
    )


def enrichment(counts: DataFrame, alpha: float = 0.05, method: str = "fdr_bh") -> DataFrame:
    out = adjust_p(enrichment_tests(counts), "P", method)
    return out.withColumn("Significant", F.coalesce(F.col("P_adj") < alpha, F.lit(False)))


# ------------------------------------------------- multiple-testing correction


def _p_bucket(p: Column) -> Column:
    """Value bucket, higher for smaller p: 2048 even steps, then 64 per e-fold below 1e-3."""
    tail = 2048 + F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * 64)
    return F.when(p >= 1e-3, F.floor((1 - p) * 2048)).otherwise(tail).cast("int")


def _ranked_p(tests: DataFrame, p_col: str) -> DataFrame:
    """``(p, bucket, upto, before, m)``: cumulative test counts at each distinct p.

    Tied P-values share one row. Counts are accumulated inside value buckets and
    shifted by bucket totals, so no task ever sorts the whole table.
    """
    d = (
        tests.where(F.col(p_col).isNotNull())
        .groupBy(F.col(p_col).alias("p"))
        .agg(F.count("*").alias("c"))
        .withColumn("bucket", _p_bucket(F.col("p")))
    )
    # at most ~50 000 buckets whatever the number of tests
    w = Window.orderBy(F.col("bucket").desc())
    shift = (
        d.groupBy("bucket")
        .agg(F.sum("c").alias("bc"))
        .select(
            "bucket",
            (F.sum("bc").over(w) - F.col("bc")).alias("offset"),
            F.sum("bc").over(Window.partitionBy()).alias("m"),
        )
    )
    inside = F.sum("c").over(Window.partitionBy("bucket").orderBy("p"))
    return (
        d.withColumn("cum", inside)
        .join(shift, "bucket")
        .select(
            "p", "bucket", "m",
            (F.col("offset") + F.col("cum")).alias("upto"),
            (F.col("offset") + F.col("cum") - F.col("c")).alias("before"),
        )
    )


def _running(d: DataFrame, value: Column, from_large: bool) -> DataFrame:
    """Running min from the largest p (step-up) or max from the smallest p (step-down)."""
    agg = F.min if from_large else F.max
    v = d.withColumn("v", value)
    p_order = F.col("p").desc() if from_large else F.col("p").asc()
    b_order = F.col("bucket").asc() if from_large else F.col("bucket").desc()
    earlier = Window.orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = v.groupBy("bucket").agg(agg("v").alias("bv")).select("bucket", agg("bv").over(earlier).alias("carry"))
    inside = agg("v").over(Window.partitionBy("bucket").orderBy(p_order))
    pick = F.least if from_large else F.greatest
    return v.withColumn("run", inside).join(carry, "bucket").select(
        "p", F.least(F.lit(1.0), pick("run", F.coalesce("carry", F.col("run")))).alias("P_adj")
    )


def _any_of(p: Column, n: Column) -> Column:
    """Odds that the least of ``n`` independent P is at most ``p``."""
    return F.when(p >= 1, F.lit(1.0)).otherwise(-F.expm1(n * F.log1p(-p)))


# Other names of the correction methods.
METHOD_ALIASES = {
    "b": "bonferroni", "bonf": "bonferroni", "s": "sidak", "h": "holm", "hs": "holm-sidak", "sh": "simes-hochberg",
    "fdr_i": "fdr_bh", "fdr_p": "fdr_bh", "fdri": "fdr_bh", "fdrp": "fdr_bh",
    "fdr_n": "fdr_by", "fdr_c": "fdr_by", "fdrn": "fdr_by", "fdrcorr": "fdr_by",
    "fdr_2sbh": "fdr_tsbh", "fdr_2sbky": "fdr_tsbky", "fdr_twostage": "fdr_tsbky",
}


def _two_stage(d: DataFrame, alpha: float, widen: float) -> DataFrame:
    """Step-up P shrunk by the share of tests that a first pass at level ``alpha / widen`` leaves, times ``widen``."""
    first = _running(d, F.col("p") * F.col("m") / F.col("upto"), True)
    hits = F.sum(F.when(F.col("P_adj") <= alpha / widen, F.col("upto") - F.col("before")).otherwise(0))
    seen = first.join(d, "p").agg(hits.alias("r"), F.max("m").alias("m"))
    left = F.when((F.col("r") > 0) & (F.col("r") < F.col("m")), 1 - F.col("r") / F.col("m")).otherwise(1.0)
    share = seen.select((widen * F.coalesce(left, F.lit(1.0))).alias("share")).scalar()
    return first.select("p", F.least(F.lit(1.0), F.col("P_adj") * share).alias("P_adj"))


def adjust_p(tests: DataFrame, p_col: str = "P", method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """Add ``P_adj`` over all non-null P of the table; only the two-stage methods depend on ``alpha``."""
    method = METHOD_ALIASES.get(method.lower(), method.lower())
    p, m = F.col("p"), F.col("m").cast("double")
    single = {
        "bonferroni": lambda p, m: F.least(F.lit(1.0), p * m),
        "sidak": _any_of,
    }
    if method in single:
        n = tests.agg(F.count(p_col).alias("n")).scalar()
        return tests.withColumn("P_adj", single[method](F.col(p_col), n.cast("double")))
    d = _ranked_p(tests, p_col)
    if method == "fdr_bh":
        adj = _running(d, p * m / F.col("upto"), True)
    elif method == "fdr_by":
        harmonic = F.expr("aggregate(sequence(1L, greatest(m, 1L)), 0D, (s, i) -> s + 1D / i)")
        total = d.agg(F.max("m").alias("m")).select(harmonic.alias("h")).scalar()
        adj = _running(d, p * m / F.col("upto") * total, True)
    elif method == "simes-hochberg":
        adj = _running(d, (m - F.col("upto") + 1) * p, True)
    elif method == "holm":
        adj = _running(d, (m - F.col("before")) * p, False)
    elif method == "holm-sidak":
        adj = _running(d, _any_of(p, m - F.col("before")), False)
    elif method == "fdr_gbs":
        # Odds of P, weighted by the tests above it against those up to it; equal P take the place of the first of them.
        odds = F.when(p < 1, p / (1 - p)).otherwise(F.lit(float("inf")))
        adj = _running(d, (m - F.col("before")) / (F.col("before") + 1) * odds, False)
    elif method == "fdr_tsbh":
        adj = _two_stage(d, alpha, 1.0)
    elif method == "fdr_tsbky":
        adj = _two_stage(d, alpha, 1.0 + alpha)
    else:
        raise ValueError(f"unsupported correction method: {method}")
    adj = adj.withColumnRenamed("p", "__p")
    return tests.join(adj, F.col(p_col) == F.col("__p"), "left").drop("__p")


# ------------------------------------------------------------- effect sizes

MAGNITUDES = ((0.474, "large"), (0.33, "medium"), (0.147, "small"))  # fixed values


def magnitude(delta: Column) -> Column:
    out = F
    for bound, name in MAGNITUDES:
        out = out.when(F.abs(delta) >= bound, name)
    return out.otherwise("negligible")


def cliff_delta(counts: DataFrame) -> DataFrame:
    """Cliff's delta of cluster versus rest: for 0/1 data the difference of prevalences."""
    t = with_rest(counts)
    n_out, ones_out = F.col("n_all") - F.col("n"), F.col("ones") - F.col("n1")
    delta = F.when(n_out > 0, F.col("n1") / F.col("n") - ones_out / n_out).otherwise(0.0)
    return t.select(
        F.col("feature").alias("Feature"),
        F.col("label").alias("Cluster"),
        F.col("n").alias("n_in"),
        F.col("n1").alias("ones_in"),
        n_out.alias("n_out"),
        ones_out.alias("ones_out"),
        delta.alias("delta"),
    )


def cliff_delta_table(
    counts: DataFrame, n_boot: int = 500, conf: float = 0.95, seed: int = 42
) -> DataFrame:
    """Delta with a percentile bootstrap interval.

    Resampling 0/1 rows with replacement makes the resampled prevalences binomial,
    so each (feature, cluster) row draws 2 x n_boot binomials instead of rows.
    """
    tail = (1 - conf) / 2 * 100

    @F.pandas_udf("lo double, hi double")
    def interval(
        key: pd.Series, n_in: pd.Series, one_in: pd.Series, n_out: pd.Series, one_out: pd.Series
    ) -> pd.DataFrame:
        rows = []
        for k, ni, oi, no, oo in zip(key, n_in, one_in, n_out, one_out):
            if no <= 0 or ni <= 0:
                rows.append((0.0, 0.0))
                continue
            rng = np.random.default_rng(int(k) & 0x7FFFFFFFFFFFFFFF)
            draws = rng.binomial(int(ni), oi / ni, n_boot) / ni - rng.binomial(int(no), oo / no, n_boot) / no
            rows.append(tuple(np.percentile(draws, [tail, 100 - tail])))
        return pd.DataFrame(rows, columns=["lo", "hi"])

    key = F.xxhash64(F.lit(seed), F.col("Feature").cast("string"), F.col("Cluster").cast("string"))
    return (
        cliff_delta(counts)
        .withColumn("ci", interval(key, "n_in", "ones_in", "n_out", "ones_out"))
        .select(
            "Feature",
            "Cluster",
            F.bround("delta", 4).alias("Delta"),
            F.bround("ci.lo", 4).alias("CI_Lo"),
            F.bround("ci.hi", 4).alias("CI_Hi"),
            magnitude(F.col("delta")).alias("Magnitude"),
        )
    )
