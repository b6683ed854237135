"""Overlap, coverage, informativeness, degeneracy, gate and resampling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import overlap as O
from cohortloom.operators import quality as Q
from cohortloom.operators import resample as R
from cohortloom.plans import testbed as B
from cohortloom.plans.catalog import query


def _id_sets(spark, sf) -> dict[str, DataFrame]:
    def ids(name, col):
        return B.table(spark, sf, name).select(F.col(col).cast("string").alias("id"))

    return {
        "customer": ids("customer", "c_custkey"),
        "orders": ids("orders", "o_custkey"),
        "events": ids("events", "user_id"),
        "documents": ids("documents", "doc_id"),
        "labels": ids("labels", "doc_id"),
    }


SETS_SQL = """s AS (SELECT DISTINCT 0 AS o, 'customer' AS d, CAST(c_custkey AS VARCHAR) AS id FROM customer UNION
  SELECT DISTINCT 1, 'orders', CAST(o_custkey AS VARCHAR) FROM orders UNION
  SELECT DISTINCT 2, 'events', CAST(user_id AS VARCHAR) FROM events UNION
  SELECT DISTINCT 3, 'documents', CAST(doc_id AS VARCHAR) FROM documents UNION
  SELECT DISTINCT 4, 'labels', CAST(doc_id AS VARCHAR) FROM labels)"""


@query("id_union", f"WITH {SETS_SQL} SELECT DISTINCT id FROM s WHERE id IS NOT NULL")
def id_union(spark, sf):
    return O.id_union(_id_sets(spark, sf))


@query("id_intersection", f"WITH {SETS_SQL} SELECT id FROM s WHERE id IS NOT NULL GROUP BY id HAVING count(*) = 5")
def id_intersection(spark, sf):
    return O.id_intersection(_id_sets(spark, sf))


@query("id_difference", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents EXCEPT SELECT CAST(doc_id AS VARCHAR) FROM labels")
def id_difference(spark, sf):
    s = _id_sets(spark, sf)
    return O.id_difference(s["documents"], s["labels"])


@query(
    "id_overlap_pairs",
    f"""WITH {SETS_SQL}, n AS (SELECT o, d, count(*) AS c FROM s GROUP BY 1, 2),
  i AS (SELECT a.o AS oa, b.o AS ob, count(*) AS c FROM s a JOIN s b ON a.id = b.id AND a.o < b.o GROUP BY 1, 2)
  SELECT a.d AS dataset_a, b.d AS dataset_b, a.c::BIGINT AS n_ids_a, b.c::BIGINT AS n_ids_b, coalesce(i.c, 0)::BIGINT AS intersection,
  (a.c + b.c - coalesce(i.c, 0))::BIGINT AS "union", round(coalesce(i.c, 0)::DOUBLE / (a.c + b.c - coalesce(i.c, 0)), 6) AS jaccard,
  round(coalesce(i.c, 0)::DOUBLE / a.c, 6) AS recall_a_in_b, round(coalesce(i.c, 0)::DOUBLE / b.c, 6) AS recall_b_in_a
  FROM n a JOIN n b ON a.o < b.o LEFT JOIN i ON i.oa = a.o AND i.ob = b.o""",
)
def id_overlap_pairs(spark, sf):
    df = O.pairwise_overlap(_id_sets(spark, sf))
    rounded = ("jaccard", "recall_a_in_b", "recall_b_in_a")
    return df.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in df.columns])


@query(
    "coverage_vs_reference",
    f"""WITH {SETS_SQL}, r AS (SELECT id FROM s WHERE d = 'customer'), m AS (SELECT count(*) AS c FROM r)
  SELECT d AS dataset, 'customer' AS reference, count(*)::BIGINT AS n_dataset, m.c::BIGINT AS n_reference, count(r.id)::BIGINT AS intersection,
  round(count(r.id)::DOUBLE / m.c, 6) AS coverage_vs_reference FROM s LEFT JOIN r ON r.id = s.id, m GROUP BY d, m.c""",
)
def coverage_vs_reference(spark, sf):
    df = O.coverage_against_reference(_id_sets(spark, sf))
    return df.withColumn("coverage_vs_reference", F.round("coverage_vs_reference", 6))


# ------------------------------------------------------------ informativeness


def _info(df):
    rounded = ("missing_fraction", "prevalence_present", "entropy_bits", "informativeness_score")
    return df.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in df.columns])


def _info_sql(table: str, binary: list[str], numeric: list[str], text: list[str]) -> str:
    """SQL of the index for columns whose type class is known."""
    parts = []
    for c in binary:
        parts.append(
            f"""SELECT '{c}' AS feature, 'binary' AS feature_type, count(*)::BIGINT AS n_total, count({c})::BIGINT AS n_valid,
      count(DISTINCT {c})::BIGINT AS n_unique, round(1 - count({c})::DOUBLE / count(*), 6) AS missing_fraction,
      count(CASE WHEN {c} = 1 THEN 1 END)::BIGINT AS n_present, count(CASE WHEN {c} = 0 THEN 1 END)::BIGINT AS n_absent,
      round(avg({c}), 6) AS prevalence_present,
      CASE WHEN avg({c}) IN (0, 1) THEN 0.0 ELSE -(avg({c}) * log2(avg({c})) + (1 - avg({c})) * log2(1 - avg({c}))) END AS e,
      (avg({c}) < 0.02 OR avg({c}) > 0.98) AS rare FROM {table}"""
        )
    for c in numeric + text:
        kind = "numeric" if c in numeric else "categorical"
        v = f"round({c}, 6)" if c in numeric else c
        parts.append(
            f"""SELECT '{c}', '{kind}', sum(c)::BIGINT, coalesce(sum(c) FILTER (v IS NOT NULL), 0)::BIGINT, count(v)::BIGINT,
      round(1 - coalesce(sum(c) FILTER (v IS NOT NULL), 0)::DOUBLE / sum(c), 6), 0::BIGINT, 0::BIGINT, NULL::DOUBLE,
      log2(sum(c) FILTER (v IS NOT NULL)) - sum(c * log2(c)) FILTER (v IS NOT NULL) / sum(c) FILTER (v IS NOT NULL), false
      FROM (SELECT {v} AS v, count(*)::DOUBLE AS c FROM {table} GROUP BY 1)"""
        )
    return (
        "WITH u(feature, feature_type, n_total, n_valid, n_unique, missing_fraction, n_present, n_absent, prevalence_present, e, rare) AS ("
        + " UNION ALL ".join(parts)
        + """) SELECT feature, feature_type, n_total, n_valid, n_unique, missing_fraction, n_present, n_absent, prevalence_present,
  round(greatest(e, 0.0), 6) AS entropy_bits, n_unique <= 1 AS constant_feature, (n_unique <= 1 OR rare) AS low_informativeness_flag,
  round(greatest(e, 0.0) * n_valid / n_total, 6) AS informativeness_score FROM u"""
    )


@query("informativeness_documents", _info_sql("documents", [], ["n_chars"], ["lang", "source", "text"]))
def informativeness_documents(spark, sf):
    df = B.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", "text")
    return _info(Q.feature_informativeness(df, "doc_id"))


@query("informativeness_labels", _info_sql("labels", ["quality", "toxic"], [], []))
def informativeness_labels(spark, sf):
    return _info(Q.feature_informativeness(B.table(spark, sf, "labels"), "doc_id"))


@query("informativeness_events", _info_sql("events", [], ["user_id", "value"], ["event_type"]))
def informativeness_events(spark, sf):
    df = B.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return _info(Q.feature_informativeness(df, "event_id"))


@query(
    "informativeness_embeddings",
    """WITH c AS (SELECT unnest(range(64)) AS f, unnest(embedding) AS v FROM embeddings), m AS (SELECT f, count(*) AS n, sum((v > 0)::INT) AS o FROM c GROUP BY 1),
  q AS (SELECT f, n, o, o::DOUBLE / n AS p FROM m)
  SELECT 'bit_' || lpad(CAST(f AS VARCHAR), 2, '0') AS feature, n::BIGINT AS n_valid, o::BIGINT AS n_present, round(p, 6) AS prevalence_present,
  round(CASE WHEN p IN (0, 1) THEN 0.0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END, 6) AS entropy_bits FROM q""",
)
def informativeness_embeddings(spark, sf):
    rows = B.emb_rows(spark, sf).select("id", *[F.get("x", i).alias(f"bit_{i:02d}") for i in range(64)])
    return _info(Q.feature_informativeness(rows, "id")).select("feature", "n_valid", "n_present", "prevalence_present", "entropy_bits")


@query(
    "degeneracy_supplier",
    """WITH h AS (SELECT DISTINCT l_suppkey AS id, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey),
  n AS (SELECT count(*) AS n FROM supplier), b AS (SELECT f, count(*) AS o FROM h JOIN supplier ON s_suppkey = id GROUP BY 1),
  t AS (SELECT (SELECT n FROM n) AS n_samples, count(*) AS n_features, count(CASE WHEN o = (SELECT n FROM n) THEN 1 END) AS k FROM b)
  SELECT n_samples::BIGINT AS n_samples, n_features::BIGINT AS n_features, n_features::BIGINT AS binary_like_feature_count,
  k::BIGINT AS constant_feature_count, 0::BIGINT AS all_missing_feature_count,
  CASE WHEN n_samples < 10 OR k = n_features THEN 'FAIL' WHEN k::DOUBLE / n_features > 0.8 THEN 'WARN' ELSE 'PASS' END AS status FROM t""",
)
def degeneracy_supplier(spark, sf):
    from cohortloom.operators.layers import pivot_wide

    return Q.feature_degeneracy(pivot_wide(B.supplier_layer(spark, sf)), "id")


@query(
    "degeneracy_labels",
    """SELECT count(label)::BIGINT AS n_labels_non_missing, count(DISTINCT label)::BIGINT AS n_unique_labels,
  CASE WHEN count(DISTINCT label) <= 1 THEN 'FAIL' WHEN count(DISTINCT label)::DOUBLE / count(label) > 0.5 THEN 'WARN' ELSE 'PASS' END AS status FROM embeddings""",
)
def degeneracy_labels(spark, sf):
    return Q.label_degeneracy(B.emb_rows(spark, sf))


def _preflights(spark, sf):
    keys = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id", "documents": "doc_id", "labels": "doc_id"}
    return reduce(
        DataFrame.unionByName,
        [Q.preflight_counts(B.table(spark, sf, t), c).withColumn("dataset", F.lit(t)) for t, c in keys.items()],
    )


def _preflight_sql(t: str, c: str, cols: int) -> str:
    return f"""SELECT '{t}' AS dataset, count(*)::BIGINT AS "rows", {cols}::BIGINT AS cols, count(DISTINCT {c})::BIGINT AS n_unique_ids,
  count(CASE WHEN {c} IS NULL THEN 1 END)::BIGINT AS missing_id_rows, (count({c}) - count(DISTINCT {c}))::BIGINT AS duplicate_id_rows FROM {t}"""


PREFLIGHT_SQL = " UNION ALL ".join(
    _preflight_sql(*a)
    for a in (("customer", "c_custkey", 5), ("orders", "o_custkey", 6), ("events", "user_id", 6), ("documents", "doc_id", 5), ("labels", "doc_id", 3))
)


@query("preflight_counts", PREFLIGHT_SQL)
def preflight_counts(spark, sf):
    return _preflights(spark, sf)


@query(
    "quality_gate",
    f"""WITH {SETS_SQL}, p AS ({PREFLIGHT_SQL}), n AS (SELECT o, count(*) AS c FROM s GROUP BY 1),
  i AS (SELECT a.o AS oa, b.o AS ob, count(*) AS c FROM s a JOIN s b ON a.id = b.id AND a.o < b.o GROUP BY 1, 2),
  j AS (SELECT coalesce(i.c, 0)::DOUBLE / (a.c + b.c - coalesce(i.c, 0)) AS j FROM n a JOIN n b ON a.o < b.o LEFT JOIN i ON i.oa = a.o AND i.ob = b.o)
  SELECT dataset AS "check", CASE WHEN "rows" = 0 THEN 'FAIL' WHEN missing_id_rows::DOUBLE / "rows" > 0.05 OR duplicate_id_rows::DOUBLE / "rows" > 0.05 OR cols <= 1
    THEN 'WARN' ELSE 'PASS' END AS status FROM p UNION ALL
  SELECT 'id_overlap', CASE WHEN min(j) < 0.05 THEN 'FAIL' WHEN min(j) < 0.2 THEN 'WARN' ELSE 'PASS' END FROM j""",
)
def quality_gate(spark, sf):
    return Q.gate_rows(_preflights(spark, sf), O.pairwise_overlap(_id_sets(spark, sf)))


@query(
    "sensitivity_minirun",
    """WITH r AS (SELECT unnest(range(5)) AS run), n AS (SELECT count(*) AS n FROM labels),
  d AS (SELECT run, quality, toxic, row_number() OVER (PARTITION BY run ORDER BY md5('42:' || run || ':' || doc_id), CAST(doc_id AS VARCHAR)) AS k FROM labels, r),
  s AS (SELECT run, quality, toxic FROM d, n WHERE k <= least(n, greatest(2, round_even(n * 0.8, 0)))),
  u AS (SELECT run, 'quality' AS f, quality AS v FROM s UNION ALL SELECT run, 'toxic', toxic FROM s),
  q AS (SELECT run, f, count(*) AS n, avg(v) AS p, count(DISTINCT v) AS k FROM u GROUP BY 1, 2)
  SELECT (run + 1)::BIGINT AS run, max(n)::BIGINT AS n_rows,
  round(avg(CASE WHEN p IN (0, 1) THEN 0.0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END), 6) AS mean_entropy,
  round(median(p), 6) AS median_prevalence, round(avg((k <= 1)::INT), 6) AS constant_feature_fraction FROM q GROUP BY run""",
)
def sensitivity_minirun(spark, sf):
    df = Q.sensitivity_miniruns(B.table(spark, sf, "labels"), "doc_id", n_runs=5)
    rounded = ("mean_entropy", "median_prevalence", "constant_feature_fraction")
    return df.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in df.columns])


# ---------------------------------------------------------------- resampling

RANK_SQL = """r AS (SELECT unnest(range(4)) AS run), d AS (SELECT run, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS label,
  row_number() OVER (PARTITION BY run ORDER BY md5('7:' || run || ':' || c_custkey), CAST(c_custkey AS VARCHAR)) AS k, count(*) OVER (PARTITION BY run) AS n FROM customer, r)"""


@query("hash_subsample", f"WITH {RANK_SQL} SELECT run::BIGINT AS run, id FROM d WHERE k <= greatest(2, floor(n * 0.8))")
def hash_subsample(spark, sf):
    return R.subsample(B.customers(spark, sf), 4, 0.8, 7)


@query(
    "half_split",
    f"WITH {RANK_SQL} SELECT run::BIGINT AS run, id, CASE WHEN k <= n // 2 THEN 'train' ELSE 'test' END AS half FROM d",
)
def half_split(spark, sf):
    return R.half_split(B.customers(spark, sf), 4, 7)


@query(
    "permute_labels",
    f"""WITH {RANK_SQL}, l AS (SELECT c_mktsegment AS label, row_number() OVER (ORDER BY c_mktsegment) AS k FROM customer)
  SELECT run::BIGINT AS run, d.id, l.label FROM d JOIN l ON l.k = d.k""",
)
def permute_labels(spark, sf):
    df = B.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("label"))
    return R.permute_labels(df, 4, 7)
