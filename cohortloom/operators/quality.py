"""Data-quality preflight: informativeness, degeneracy, preflight counts, gate, mini-runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.scalar import binary_entropy_bits, binary_token, numeric_or_null, xlogx
from cohortloom.operators.resample import subsample


# --------------------------------------------------------- value profiles


def _dtype_class(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    return "number" if isinstance(t, T.NumericType) else "text"


LONG_TEXT = 64  # longer cells are counted under their digest


def value_counts(df: DataFrame, id_col: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """``(keys..., feature, dtype, value, b, c)`` for every column but the id, in one pass.

    ``b`` is the binary/numeric reading of the cell. Long texts are hashed whole before
    they become a grouping key, so the shuffle carries digests and partial counts.
    """
    keys = keys or []
    feats = [f for f in df.schema.fields if f.name != id_col and f.name not in keys]
    cells = []
    for f in feats:
        kind, v = _dtype_class(f.dataType), F.col(f"`{f.name}`").cast("string")
        if kind == "number":
            b, key = numeric_or_null(v), v
        else:
            b = binary_token(v)
            key = F.when(F.length(v) > LONG_TEXT, F.md5(v.cast("binary"))).otherwise(v)
        cells.append(
            F.struct(F.lit(f.name).alias("feature"), F.lit(kind).alias("dtype"), key.alias("value"), b.alias("b"))
        )
    return (
        df.select(*keys, F.explode(F.array(*cells)).alias("q"))
        .groupBy(*keys, "q.feature", "q.dtype", "q.value", "q.b")
        .agg(F.count("*").alias("c"))
    )


def informativeness_from_counts(
    counts: DataFrame,
    keys: list[str] | None = None,
    floor: float = 0.02,
    ceiling: float = 0.98,
) -> DataFrame:
    """Per-feature type, prevalence, entropy (bits), flags and score from value counts."""
    keys = keys or []
    group = [*keys, "feature", "dtype"]
    # Non-binary numbers are counted on their value rounded to 6 places.
    v = counts.withColumn(
        "level",
        F.when(F.col("dtype") == "number", F.round("b", 6).cast("string")).otherwise(F.col("value")),
    )
    levels = v.groupBy(*group, "level").agg(
        F.sum("c").alias("c"),
        F.sum(F.when(F.col("b").isNotNull(), F.col("c"))).alias("c_num"),
        F.sum(F.when(F.round("b", 6) == 1, F.col("c"))).alias("c_one"),
        F.sum(F.when(F.round("b", 6) == 0, F.col("c"))).alias("c_zero"),
        F.sum(F.when(F.col("b").isNotNull() & ~F.round("b", 6).isin(0.0, 1.0), F.col("c"))).alias("c_other"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("c"))).alias("c_valid"),
    )
    zero = F.lit(0).cast("bigint")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), zero)

    t = levels.groupBy(*group).agg(
        total("c").alias("n_total"),
        total("c_valid").alias("n_valid"),
        total("c_num").alias("n_num"),
        total("c_one").alias("one"),
        total("c_zero").alias("zero"),
        total("c_other").alias("other"),
        F.count(F.when(F.col("level").isNotNull(), 1)).alias("levels"),
        F.sum(F.when(F.col("level").isNotNull(), xlogx("c", "2"))).alias("xl"),
        F.sum(F.when(F.col("level").isNotNull(), F.col("c"))).alias("n_level"),
    )
    is_binary = (F.col("n_num") > 0) & (F.col("other") == 0)
    kind = (
        F.when(F.col("n_valid") == 0, "unknown")
        .when(is_binary, "binary")
        .when(F.col("dtype") == "number", "numeric")
        .otherwise("categorical")
    )
    t = t.withColumn("feature_type", kind)
    binary = F.col("feature_type") == "binary"
    t = t.withColumn("prev", F.when(binary, F.col("one") / (F.col("one") + F.col("zero"))))
    entropy = (
        F.when(binary, binary_entropy_bits(F.col("prev")))
        .when(F.col("n_level") > 0, F.log2(F.col("n_level").cast("double")) - F.col("xl") / F.col("n_level"))
    )
    unique = (
        F.when(F.col("n_valid") == 0, zero)
        .when(binary, (F.col("one") > 0).cast("bigint") + (F.col("zero") > 0).cast("bigint"))
        .otherwise(F.col("levels"))
    )
    t = t.withColumn("entropy_bits", F.greatest(F.lit(0.0), entropy)).withColumn("n_unique", unique.cast("bigint"))
    t = t.withColumn("missing_fraction", 1 - F.col("n_valid") / F.col("n_total"))
    const = F.col("n_unique") <= 1
    return t.select(
        *keys,
        "feature",
        "feature_type",
        "n_total",
        "n_valid",
        "n_unique",
        "missing_fraction",
        F.when(binary, F.col("one")).otherwise(zero).alias("n_present"),
        F.when(binary, F.col("zero")).otherwise(zero).alias("n_absent"),
        F.col("prev").alias("prevalence_present"),
        "entropy_bits",
        const.alias("constant_feature"),
        (const | F.coalesce((F.col("prev") < floor) | (F.col("prev") > ceiling), F.lit(False))).alias(
            "low_informativeness_flag"
        ),
        (F.coalesce("entropy_bits", F.lit(0.0)) * F.greatest(F.lit(0.0), 1 - F.col("missing_fraction"))).alias(
            "informativeness_score"
        ),
    )


def feature_informativeness(
    df: DataFrame, id_col: str | None = None, floor: float = 0.02, ceiling: float = 0.98
) -> DataFrame:
    out = informativeness_from_counts(value_counts(df, id_col), None, floor, ceiling)
    return out.orderBy(F.col("low_informativeness_flag").asc(), F.col("informativeness_score").desc(), "feature")


# -------------------------------------------------------------- degeneracy


def _judged(counts: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """``counts`` with ``codes`` (level, code) of the rules that hold, and ``status``, the worst level."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(l).alias("level"), F.lit(r).alias("code"))) for r, l, c in rules]))
    out = counts.withColumn("codes", hits)
    # FAIL < WARN in alphabetical order too
    return out.withColumn("status", F.coalesce(F.array_min(F.transform("codes", lambda e: e["level"])), F.lit("PASS")))


def _feature_findings(df: DataFrame, id_col: str | None, min_samples: int) -> DataFrame:
    n_rows = df.agg(F.count("*").alias("n")).scalar()
    n_features = len([c for c in df.columns if c != id_col])
    if n_features:
        info = feature_informativeness_counts(df, id_col)
    else:
        info = df.limit(0).select(
            F.lit("unknown").alias("feature_type"), F.lit(True).alias("constant_feature"), F.lit(0).alias("n_valid")
        )
    counts = info.agg(
        F.count_if(F.col("feature_type") == "binary").alias("binary_like_feature_count"),
        F.count_if(F.col("constant_feature") & (F.col("n_valid") > 0)).alias("constant_feature_count"),
        F.count_if(F.col("n_valid") == 0).alias("all_missing_feature_count"),
    ).select(
        n_rows.alias("n_samples"),
        F.lit(n_features).cast("bigint").alias("n_features"),
        "*",
    )
    p, same = F.col("n_features"), F.col("constant_feature_count")
    return _judged(
        counts,
        [
            ("few_samples", "FAIL", F.col("n_samples") < min_samples),
            ("no_features", "FAIL", p == 0),
            ("only_constant_features", "FAIL", (p > 0) & (same == p)),
            ("mostly_constant_features", "WARN", (same < p) & (same > 0.8 * p)),
            ("empty_features", "WARN", F.col("all_missing_feature_count") > 0),
        ],
    )


def _label_findings(labels: DataFrame, label: str = "label") -> DataFrame:
    counts = labels.agg(
        F.count(label).alias("n_labels_non_missing"), F.count_distinct(label).alias("n_unique_labels")
    )
    n, u = F.col("n_labels_non_missing"), F.col("n_unique_labels")
    return _judged(
        counts,
        [
            ("no_labels", "FAIL", n == 0),
            ("single_label", "FAIL", u == 1),
            ("fragmented_labels", "WARN", (u > 1) & (u > 0.5 * n)),
        ],
    )


def feature_degeneracy(df: DataFrame, id_col: str | None, min_samples: int = 10) -> DataFrame:
    """One row of counts and the PASS/WARN/FAIL status of a feature table."""
    return _feature_findings(df, id_col, min_samples).drop("codes")


def feature_informativeness_counts(df: DataFrame, id_col: str | None) -> DataFrame:
    return informativeness_from_counts(value_counts(df, id_col))


def label_degeneracy(labels: DataFrame, label: str = "label") -> DataFrame:
    return _label_findings(labels, label).drop("codes")


def check_degeneracy(
    labels: DataFrame | None = None,
    features: DataFrame | None = None,
    id_col: str | None = None,
    min_samples: int = 10,
) -> dict:
    """Counts, status and reason codes of a feature table, a label table or both."""
    found = []
    if features is not None:
        found.append(_feature_findings(features, id_col, min_samples))
    if labels is not None:
        found.append(_label_findings(labels))
    checks, codes = {}, []
    for one in found:
        row = one.first().asDict(recursive=True)
        codes += row.pop("codes")
        row.pop("status")
        checks.update(row)
    by = {level: [c["code"] for c in codes if c["level"] == level] for level in ("FAIL", "WARN")}
    status = next((level for level, hit in by.items() if hit), "PASS")
    return {"status": status, "checks": checks, "warnings": by["WARN"], "failures": by["FAIL"]}


# ------------------------------------------------------- preflight and gate


@dataclass
class DatasetPreflight:
    name: str
    path: str
    rows: int
    cols: int
    id_col: str | None
    n_unique_ids: int
    missing_id_rows: int
    duplicate_id_rows: int
    sha256: str


def preflight_counts(df: DataFrame, id_col: str) -> DataFrame:
    """``rows, cols, n_unique_ids, missing_id_rows, duplicate_id_rows`` in one aggregate."""
    c = F.col(id_col).cast("string")
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("cols"),
        F.count_distinct(c).alias("n_unique_ids"),
        F.count_if(c.isNull()).alias("missing_id_rows"),
        (F.count(c) - F.count_distinct(c)).alias("duplicate_id_rows"),
    )


GATE_DEFAULTS = {  # fixed values
    "min_jaccard_warn": 0.20,
    "min_jaccard_fail": 0.05,
    "max_missing_id_fraction_warn": 0.05,
    "max_duplicate_id_fraction_warn": 0.05,
}


def _gate_findings(preflights: DataFrame, overlap: DataFrame, thresholds: dict | None) -> DataFrame:
    """``check, status, codes``: a row per dataset and one for the overlaps."""
    t = {**GATE_DEFAULTS, **(thresholds or {})}
    share = lambda c: F.coalesce(F.try_divide(c, "rows"), F.lit(0.0))
    per = _judged(
        preflights.withColumnRenamed("dataset", "check"),
        [
            ("no_rows", "FAIL", F.col("rows") == 0),
            ("missing_ids", "WARN", share("missing_id_rows") > t["max_missing_id_fraction_warn"]),
            ("duplicate_ids", "WARN", share("duplicate_id_rows") > t["max_duplicate_id_fraction_warn"]),
            ("single_column", "WARN", F.col("cols") <= 1),
        ],
    )
    low, fail, warn = F.col("low"), t["min_jaccard_fail"], t["min_jaccard_warn"]
    over = _judged(
        overlap.agg(F.min("jaccard").alias("low")).withColumn("check", F.lit("id_overlap")),
        [("nearly_disjoint_ids", "FAIL", low < fail), ("weak_id_overlap", "WARN", (low >= fail) & (low < warn))],
    )
    return per.select("check", "status", "codes").unionByName(over.select("check", "status", "codes"))


def gate_rows(
    preflights: DataFrame, overlap: DataFrame, thresholds: dict | None = None
) -> DataFrame:
    """Gate decision per dataset plus one row for the overlaps, as a plan.

    ``preflights(dataset, rows, cols, missing_id_rows, duplicate_id_rows)``,
    ``overlap(jaccard)``. ``check`` names the object, ``status`` is its verdict.
    """
    return _gate_findings(preflights, overlap, thresholds).drop("codes")


def quality_gate(
    preflights: list[DatasetPreflight],
    overlap: list[dict],
    config: dict | None = None,
    degeneracy: dict[str, dict] | None = None,
) -> dict:
    """Gate report: the findings of ``gate_rows`` on the per-dataset records, with those of the degeneracy checks."""
    spark = SparkSession.active()
    t = {k: float((config or {}).get(k, v)) for k, v in GATE_DEFAULTS.items()}
    flights = spark.createDataFrame(
        [(p.name, p.rows, p.cols, p.missing_id_rows, p.duplicate_id_rows) for p in preflights],
        "dataset string, rows long, cols long, missing_id_rows long, duplicate_id_rows long",
    )
    shared = spark.createDataFrame([(r["jaccard"],) for r in overlap], "jaccard double")
    rows = _gate_findings(flights, shared, t).select("check", F.explode("codes").alias("c")).select("check", "c.*").collect()
    found = [(r["level"], f"{r['check']}: {r['code']}") for r in rows]
    for name, report in (degeneracy or {}).items():
        found += [("FAIL", f"{name}: {c}") for c in report["failures"]] + [("WARN", f"{name}: {c}") for c in report["warnings"]]
    by = {level: [text for at, text in found if at == level] for level in ("FAIL", "WARN")}
    return {
        "status": next((level for level, hit in by.items() if hit), "PASS"),
        "thresholds": t,
        "warnings": by["WARN"],
        "failures": by["FAIL"],
        "datasets": [asdict(p) for p in preflights],
        "n_dataset_layers": len(preflights),
        "n_pairwise_overlap_checks": len(overlap),
    }


# --------------------------------------------------------------- mini-runs


def sensitivity_miniruns(
    df: DataFrame, id_col: str, n_runs: int = 10, fraction: float = 0.8, seed: int = 42
) -> DataFrame:
    """Entropy and prevalence stability under row subsampling, all runs in one plan.

    ``df`` has one row per ``id_col``. Subsampled rows are joined back once and
    reduced to (run, feature, value) counts before the shuffle.
    """
    from cohortloom.operators.layers import normalize_binary_like

    tidy = normalize_binary_like(df, id_col).withColumn("id", F.col(id_col).cast("string"))
    picks = subsample(tidy.select("id"), n_runs, fraction, seed, rounding="round")
    body = tidy.drop(id_col) if id_col != "id" else tidy
    sampled = picks.join(body, "id").drop("id")
    info = informativeness_from_counts(value_counts(sampled, None, ["run"]), ["run"])
    return info.groupBy("run").agg(
        F.max("n_total").alias("n_rows"),
        F.avg("entropy_bits").alias("mean_entropy"),
        F.median("prevalence_present").alias("median_prevalence"),
        F.avg(F.col("constant_feature").cast("double")).alias("constant_feature_fraction"),
    ).withColumn("run", F.col("run") + 1)
