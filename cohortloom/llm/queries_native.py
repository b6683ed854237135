"""Queries of the operators made of DataFrame functions only."""

from __future__ import annotations

from cohortloom.llm import common as C
from cohortloom.llm.decontaminate import contamination
from cohortloom.llm.fingerprints import fingerprints
from cohortloom.llm.licenses import scan_licenses
from cohortloom.plans.catalog import query


@query("op4_decontaminate")
def op4(spark, sf):
    return contamination(C.documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op7_licenses")
def op7(spark, sf):
    return scan_licenses(C.documents(spark, sf))


@query("op10_fingerprints")
def op10(spark, sf):
    return fingerprints(C.documents(spark, sf))
