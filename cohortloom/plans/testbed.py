"""Binary layers and partitions derived from the given tables (whole tables only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.layers import TraitLayer, cells_layer, positive_list, wide_layer


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb_rows(spark, sf) -> DataFrame:
    """``(id, x, label)``: sign bits of the embeddings with their planted class."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.transform("embedding", lambda v: (v > 0).cast("tinyint")).alias("x"),
        F.col("label").cast("int").alias("label"),
    )


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))


def brand_hits(spark, sf) -> DataFrame:
    """Detections ``(o_custkey, p_brand)``: brands a customer has ordered."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "p_brand")
    )


def brand_layer(spark, sf) -> TraitLayer:
    return positive_list("brand", brand_hits(spark, sf), "o_custkey", "p_brand", None, customers(spark, sf))


def priority_layer(spark, sf) -> TraitLayer:
    return positive_list(
        "priority", table(spark, sf, "orders"), "o_custkey", "o_orderpriority", None, customers(spark, sf)
    )


def event_layer(spark, sf) -> TraitLayer:
    return positive_list("ev", table(spark, sf, "events"), "user_id", "event_type", "value")


def supplier_layer(spark, sf) -> TraitLayer:
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    hits = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    return positive_list("supp", hits, "l_suppkey", "p_brand", None, ids)


def label_layer(spark, sf) -> TraitLayer:
    """Wide layer with partial coverage: quality and toxicity flags of documents."""
    return wide_layer("lab", table(spark, sf, "labels"), "doc_id", documents(spark, sf))


def embedding_layer(spark, sf) -> TraitLayer:
    cells = emb_rows(spark, sf).select("id", F.posexplode("x").alias("f", "value")).select(
        "id", F.format_string("bit_%02d", "f").alias("feature"), "value"
    )
    return cells_layer("emb", cells)
