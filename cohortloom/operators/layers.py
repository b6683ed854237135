"""Trait layers: loading semantics, coercion, coverage and feature/sample QC.

A layer is kept long. ``cells(id, feature, value)`` holds explicit cells only;
for positive lists the zeros of observed ids are implied, so a sparse list is
never densified. NULL means "missing" and is never read as 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.scalar import binary_token, numeric_or_null


@dataclass(frozen=True)
class TraitLayer:
    name: str
    cells: DataFrame  # id STRING, feature STRING, value TINYINT (NULL = missing)
    ids: DataFrame  # id STRING, observed BOOLEAN
    features: DataFrame  # feature STRING
    implicit_zero: bool  # observed ids have 0 where no cell is stored
    fmt: str = "wide"


BROADCAST_LEVELS = 200_000  # distinct category levels up to which their table is broadcast
SALTS = 64


# ------------------------------------------------------------------ loading


def id_text(c: str):
    return F.col(c).cast("string")


def is_long_format(df: DataFrame, id_col: str) -> bool:
    """Positive-list heuristic: repeated ids plus (text) or (text, number) columns."""
    others = [c for c in df.columns if c != id_col]
    if id_col not in df.columns or len(others) not in (1, 2):
        return False

    def text_cells(c):  # cells that are neither missing, numeric nor boolean
        low = F.lower(F.col(c).cast("string"))
        return F.count_if(
            F.col(c).isNotNull() & numeric_or_null(low).isNull() & ~low.isin("true", "false", "nan")
        )

    row = df.agg(
        F.count("*").alias("n"),
        F.count_distinct(F.coalesce(id_text(id_col), F.lit("nan"))).alias("d"),
        *[text_cells(c).alias(f"t{i}") for i, c in enumerate(others)],
    ).first()
    if row["d"] >= row["n"] or row["t0"] == 0:
        return False
    return len(others) == 1 or row["t1"] == 0


def _within(cells: DataFrame, seen: DataFrame, universe: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Cells and ``(id, observed)`` restricted and expanded to an id universe.

    ``seen(id, observed)`` lists the ids of the file. Cells are joined, not semi-joined:
    a semi-join would be pushed below the cell aggregation and keep its shuffle from
    being shared with the branches that read all cells.
    """
    if universe is None:
        return cells, seen
    universe = universe.select("id").distinct()
    ids = universe.join(seen, "id", "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    return cells.join(universe, "id"), ids


def positive_list(
    name: str,
    rows: DataFrame,
    id_col: str,
    feature_col: str,
    value_col: str | None = None,
    universe: DataFrame | None = None,
) -> TraitLayer:
    """Layer from detections ``(id, feature[, value])``.

    With a value column, rows whose value is missing or not numeric are removed
    first; an id left without rows is unobserved, an id with only values <= 0 is
    observed and all zero.
    """
    base = rows.select(
        id_text(id_col).alias("id"),
        F.col(feature_col).cast("string").alias("feature"),
        *([numeric_or_null(F.col(value_col).cast("string")).alias("v")] if value_col else []),
    ).where(F.col("id").isNotNull() & F.col("feature").isNotNull())
    if value_col:
        base = base.where(F.col("v").isNotNull())
        present = F.max((F.col("v") > 0).cast("tinyint"))
    else:
        present = F.max(F.lit(1).cast("tinyint"))
    cells = base.groupBy("id", "feature").agg(present.alias("value"))
    # every branch reads (id, feature, value), so they share one shuffle of the detections
    features = cells.groupBy("feature").agg(F.max("value").alias("v")).select("feature")
    seen = cells.groupBy("id").agg(F.max(F.col("value").isNotNull()).alias("observed"))
    cells, ids = _within(cells, seen, universe)
    return TraitLayer(name, cells, ids, features, True, "long")


def coerce_binary_wide(df: DataFrame, id_col: str) -> DataFrame:
    """Wide table to explicit cells ``(id, feature, value)``.

    0/1 and boolean columns stay one feature; other numbers and text become one
    feature per value, and a missing cell is NULL in every feature of its column.
    The column kind is decided from one aggregate over (column, value) counts.
    """
    cols = [c for c in df.columns if c != id_col]
    if not cols:
        return df.sparkSession.createDataFrame([], "id string, feature string, value tinyint")
    values = df.select(
        id_text(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in cols]
    ).unpivot("id", cols, "source", "raw")
    low = F.lower("raw")
    values = values.withColumn(
        "num",
        F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0)).otherwise(numeric_or_null("raw")),
    )
    distinct = values.groupBy("source", "raw", "num").agg(F.count("*").alias("c"))
    kinds = distinct.groupBy("source").agg(
        F.when(F.count("raw") == 0, "empty")
        .when(F.count("num") == 0, "text")
        .when(
            F.count_if(F.col("num").isNotNull() & ~F.round("num", 12).isin(0.0, 1.0)) == 0, "binary"
        )
        .otherwise("number")
        .alias("kind")
    )
    whole = F.col("num") == F.floor("num")
    number_text = F.when(whole, F.col("num").cast("decimal(38,0)").cast("string")).otherwise(
        F.col("num").cast("string")
    )
    level = (
        F.when(F.col("kind") == "text", F.col("raw"))
        .when(F.col("kind") == "number", number_text)
    )
    # one row per column of the table
    typed = values.join(F.broadcast(kinds), "source").withColumn("level", level)
    plain = typed.where(F.col("kind").isin("binary", "empty")).select(
        "id",
        F.col("source").alias("feature"),
        F.when(F.col("kind") == "binary", (F.col("num") > 0).cast("tinyint")).alias("value"),
    )
    levels = (
        distinct.join(F.broadcast(kinds), "source")
        .withColumn("level", level)
        .where(F.col("level").isNotNull())
        .select("source", F.col("level").alias("cat"))
        .distinct()
    )
    coded = typed.where(F.col("kind").isin("text", "number")).select("id", "source", "level")
    if levels.count() <= BROADCAST_LEVELS:
        coded = coded.join(F.broadcast(levels), "source")
    else:  # few, huge join keys: spread each column's rows over salts
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        salted = levels.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        coded = coded.withColumn("salt", salt).join(salted, ["source", "salt"])
    dummies = (
        coded.select(
            "id",
            F.concat_ws("_", "source", "cat").alias("feature"),
            (F.col("level") == F.col("cat")).cast("tinyint").alias("value"),
        )
    )
    return plain.unionByName(dummies)


def wide_layer(
    name: str, df: DataFrame, id_col: str, universe: DataFrame | None = None
) -> TraitLayer:
    """Layer from a wide table; an id is observed when any of its cells is not missing."""
    return cells_layer(name, coerce_binary_wide(df, id_col), universe)


def cells_layer(name: str, cells: DataFrame, universe: DataFrame | None = None) -> TraitLayer:
    features = cells.select("feature").distinct()
    seen = cells.groupBy("id").agg(F.max(F.col("value").isNotNull()).alias("observed"))
    cells, ids = _within(cells, seen, universe)
    return TraitLayer(name, cells, ids, features, False, "wide")


def pivot_wide(layer: TraitLayer) -> DataFrame:
    """Wide view ``id, <feature...>``: NULL for unobserved ids, 0 for implied absences."""
    names = [r["feature"] for r in layer.features.orderBy("feature").collect()]
    wide = layer.cells.groupBy("id").pivot("feature", names).agg(F.max("value"))
    out = layer.ids.join(wide, "id", "left")
    if layer.implicit_zero:
        zero = F.lit(0).cast("tinyint")
        out = out.select(
            "id",
            "observed",
            *[F.when(F.col("observed"), F.coalesce(F.col(f"`{n}`"), zero)).alias(n) for n in names],
        )
    return out.drop("observed")


def normalize_binary_like(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Presence/absence spellings to 1/0 and everything else to a number or NULL."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name == id_col:
            out.append(c)
        elif isinstance(field.dataType, T.StringType):
            out.append(binary_token(c).alias(field.name))
        else:
            out.append(c.cast("double").alias(field.name))
    return df.select(*out)


def edit_columns(
    df: DataFrame, rename: dict[str, str] | None = None, recode: dict | None = None, drop: list[str] | None = None
) -> DataFrame:
    """Table edits before a run: drop columns, recode values ``{column: {old: new}}``, rename."""
    out = df.drop(*(drop or []))
    for c, mapping in (recode or {}).items():
        out = out.replace(mapping, subset=[c])
    return out.withColumnsRenamed(rename or {})


# ------------------------------------------------------- coverage and QC


def feature_stats(layer: TraitLayer) -> DataFrame:
    """``feature, n_obs, valid_n, n_pos`` over observed rows, one aggregate per layer."""
    n_obs = layer.ids.agg(F.count_if("observed").alias("n_obs")).scalar()
    stats = layer.cells.groupBy("feature").agg(
        F.count("value").alias("valid_n"), F.sum(F.col("value").cast("bigint")).alias("n_pos")
    )
    stats = layer.features.join(stats, "feature", "left").withColumn("n_obs", n_obs)
    valid = F.col("n_obs") if layer.implicit_zero else F.coalesce("valid_n", F.lit(0))
    return stats.select(
        "feature",
        F.col("n_obs").cast("bigint").alias("n_obs"),
        valid.cast("bigint").alias("valid_n"),
        F.coalesce("n_pos", F.lit(0)).cast("bigint").alias("n_pos"),
    )


def layer_coverage(layer: TraitLayer) -> DataFrame:
    n_feat = layer.features.agg(F.count("*").alias("n")).scalar()
    filled = layer.cells.agg(F.count("value").alias("n")).scalar()
    out = layer.ids.agg(
        F.count("*").alias("N_total"), F.count_if("observed").alias("N_observed")
    ).select(
        F.lit(layer.name).alias("Layer"),
        F.lit(layer.fmt).alias("Format"),
        "N_total",
        "N_observed",
        F.round(F.col("N_observed") / F.greatest("N_total", F.lit(1)), 4).alias("Coverage"),
        n_feat.alias("N_features"),
    )
    if layer.implicit_zero:
        missing = (F.col("N_total") - F.col("N_observed")) * F.col("N_features")
    else:
        missing = F.col("N_total") * F.col("N_features") - filled
    return out.withColumn("Missing_cells", missing.cast("bigint"))


def feature_qc(
    layer: TraitLayer,
    min_prev: float = 0.01,
    max_prev: float = 0.99,
    max_missing_frac: float = 0.0,
) -> DataFrame:
    """QC report; the reported reason is the last rule that applies."""
    prev = F.when(F.col("valid_n") > 0, F.col("n_pos") / F.col("valid_n"))
    miss = (F.col("n_obs") - F.col("valid_n")) / F.col("n_obs")
    rep = feature_stats(layer).where(F.col("n_obs") > 0).select(
        F.lit(layer.name).alias("Layer"),
        F.col("feature").alias("Feature"),
        F.col("valid_n").alias("Valid_N"),
        prev.alias("Prevalence"),
        miss.alias("Missing_Frac"),
    )
    keep = F.coalesce(
        (F.col("Valid_N") > 0)
        & F.col("Prevalence").between(min_prev, max_prev)
        & (F.col("Missing_Frac") <= max_missing_frac),
        F.lit(False),
    )
    reason = (
        F.when(F.col("Keep"), "")
        .when(F.col("Missing_Frac") > max_missing_frac, "too_many_missing")
        .when(F.col("Prevalence") > max_prev, "too_common")
        .when(F.col("Prevalence") < min_prev, "too_rare")
        .when(F.col("Valid_N") == 0, "all_missing")
        .otherwise("")
    )
    return rep.withColumn("Keep", keep).withColumn("Dropped_reason", reason)


def keep_features(layer: TraitLayer, report: DataFrame) -> TraitLayer:
    kept = report.where("Keep").select(F.col("Feature").alias("feature"))
    return replace(
        layer,
        cells=layer.cells.join(kept, "feature", "left_semi"),
        features=kept,
    )


def sample_filter(layer: TraitLayer, max_missing: float = 0.0) -> TraitLayer:
    """Keep observed ids with a non-missing cell and a missing fraction within bounds."""
    observed = layer.ids.where("observed")
    n_feat = layer.features.agg(F.count("*").alias("n")).scalar()
    if layer.implicit_zero:
        kept = observed.withColumn("p", n_feat).where(F.col("p") > 0).select("id", "observed")
        cells = layer.cells
    else:
        filled = (
            layer.cells.groupBy("id")
            .agg(F.count("value").alias("k"))
            .withColumn("p", n_feat)
            .where((F.col("k") > 0) & ((F.col("p") - F.col("k")) / F.col("p") <= max_missing))
        )
        kept = observed.join(filled, "id", "left_semi")
        cells = layer.cells.join(kept, "id", "left_semi")
    return replace(layer, cells=cells, ids=kept)


def feature_missing_filter(layer: TraitLayer, max_missing: float = 0.0) -> TraitLayer:
    if layer.implicit_zero:
        return layer
    n = layer.ids.agg(F.count("*").alias("n")).scalar()
    kept = (
        layer.features.join(
            layer.cells.groupBy("feature").agg(F.count("value").alias("k")), "feature", "left"
        )
        .withColumn("n", n)
        .where((F.col("n") - F.coalesce("k", F.lit(0))) / F.col("n") <= max_missing)
        .select("feature")
    )
    return replace(
        layer, cells=layer.cells.join(kept, "feature", "left_semi"), features=kept
    )


def complete_cases(layer: TraitLayer) -> TraitLayer:
    """Drop ids that still have a missing cell."""
    if layer.implicit_zero:
        return layer
    n_feat = layer.features.agg(F.count("*").alias("n")).scalar()
    full = (
        layer.cells.groupBy("id")
        .agg(F.count("value").alias("k"))
        .withColumn("p", n_feat)
        .where(F.col("k") == F.col("p"))
        .select("id")
    )
    return replace(
        layer,
        cells=layer.cells.join(full, "id", "left_semi"),
        ids=layer.ids.join(full, "id", "left_semi"),
    )


def mean_impute(layer: TraitLayer) -> DataFrame:
    """``(id, feature, value DOUBLE)`` with missing cells set to the feature mean."""
    means = layer.cells.groupBy("feature").agg(F.avg("value").alias("mean"))
    return layer.cells.join(means, "feature").select(
        "id", "feature", F.coalesce(F.col("value").cast("double"), F.col("mean")).alias("value")
    )


def row_vectors(layer: TraitLayer) -> DataFrame:
    """``(id, x ARRAY<TINYINT>)`` over the sorted features, for complete layers.

    A record holds one sample's p features, so p is bounded by the row size
    before this is ever called; n is not bounded.
    """
    order = Window.orderBy("feature")
    index = layer.features.select("feature", (F.row_number().over(order) - 1).alias("f"))
    n_feat = layer.features.agg(F.count("*").alias("n")).scalar()
    ones = (
        layer.cells.where(F.col("value") == 1)
        .join(index, "feature")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("f")).alias("ones"))
    )
    rows = layer.ids.where("observed").join(ones, "id", "left").withColumn("p", n_feat)
    return rows.select("id", dense_row(F.coalesce("ones", F.array().cast("array<int>")), F.col("p").cast("int")).alias("x"))


@F.pandas_udf(T.ArrayType(T.ByteType()))
def dense_row(ones: pd.Series, p: pd.Series) -> pd.Series:
    width = int(p.iloc[0]) if len(p) else 0
    out = np.zeros((len(ones), width), dtype=np.int8)
    lengths = [len(o) for o in ones]
    if sum(lengths):
        out[np.repeat(np.arange(len(ones)), lengths), np.concatenate(list(ones)).astype(int)] = 1
    return pd.Series(list(out))
