"""The synthetic benchmark workload: Bernoulli traits, prevalence QC, phi of all feature pairs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.tiles import phi_pairs

PREVALENCE, ROWS, WIDTHS = 0.08, 300, (1000, 5000, 20000)  # fixed values


def bernoulli_rows(spark: SparkSession, n: int, p: int, seed: int = 123) -> DataFrame:
    cell = f"transform(sequence(0, {p - 1}), f -> cast(pmod(xxhash64({seed}, id, f), 1000000) < {int(PREVALENCE * 1e6)} as tinyint))"
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.expr(cell).alias("x"))


def run(spark: SparkSession, n_rows: int = ROWS, widths=WIDTHS, seed: int = 123) -> dict:
    out = []
    for p in widths:
        rows = bernoulli_rows(spark, n_rows, p, seed).persist()
        rows.count()
        t = time.perf_counter()
        prev = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("p"))
        informative = prev.where((F.col("p") > 0.01) & (F.col("p") < 0.99)).count()
        qc = time.perf_counter() - t
        t = time.perf_counter()
        r = phi_pairs(rows).agg(F.count("*").alias("n"), F.sum("phi").alias("s")).first()
        out.append(
            {"n_rows": n_rows, "p": p, "informative_features": informative, "qc_sec": round(qc, 4),
             "assoc_sec": round(time.perf_counter() - t, 4), "pairs_eval": r["n"], "checksum": round(r["s"], 6)}
        )
        rows.unpersist()
    return {"tool": "cohortloom", "results": out}
