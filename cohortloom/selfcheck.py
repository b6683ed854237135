"""Installation check: imports, numeric sanity, a Spark smoke query."""

from __future__ import annotations

import importlib
import math

from cohortloom import __version__


def run_self_check(report_path: str | None = None) -> dict:
    checks = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow", "yaml"):
        try:
            checks[f"import {name}"] = bool(importlib.import_module(name))
        except ImportError:
            checks[f"import {name}"] = False
    from cohortloom.functions.special import fisher_two_sided

    checks["exact test"] = math.isclose(fisher_two_sided(3, 1, 1, 3), 34 / 70, rel_tol=1e-9)
    from cohortloom.operators.agreement import contingency, partition_metrics
    from cohortloom.session import get_spark

    spark = get_spark()
    df = spark.createDataFrame([(i, i % 3, i % 3) for i in range(9)], "id int, a int, b int")
    r = partition_metrics(contingency(df, "a", "b")).first()
    checks["identical partitions"] = math.isclose(r["ari"], 1.0) and abs(r["vi"]) < 1e-9
    report = {"tool": "cohortloom", "version": __version__, "status": "PASS" if all(checks.values()) else "FAIL", "checks": checks}
    if report_path:
        from cohortloom.sources import sinks

        sinks.save_json(report, report_path)
    return report
