"""Layer loading, coercion, coverage, QC and missingness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import layers as L
from cohortloom.plans import testbed as B
from cohortloom.plans.catalog import query

BRAND_SQL = """
hits AS (SELECT DISTINCT o_custkey AS id, p_brand AS feature FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
obs AS (SELECT count(*) AS n_obs FROM (SELECT DISTINCT id FROM hits) h JOIN customer ON c_custkey = h.id)
"""

QC_CASE = """CASE WHEN v > 0 AND prev BETWEEN 0.01 AND 0.99 AND miss <= 0 THEN '' WHEN miss > 0 THEN 'too_many_missing'
  WHEN prev > 0.99 THEN 'too_common' WHEN prev < 0.01 THEN 'too_rare' WHEN v = 0 THEN 'all_missing' ELSE '' END"""


def _qc(df):
    return df.select(
        "Layer", "Feature", F.col("Valid_N").cast("bigint").alias("Valid_N"),
        F.round("Prevalence", 6).alias("Prevalence"), F.round("Missing_Frac", 6).alias("Missing_Frac"), "Keep", "Dropped_reason",
    )


@query(
    "brand_qc",
    f"""WITH {BRAND_SQL}, s AS (SELECT feature, count(*) AS n FROM hits JOIN customer ON c_custkey = id GROUP BY 1),
  q AS (SELECT feature, n_obs AS v, n::DOUBLE / n_obs AS prev, 0.0::DOUBLE AS miss FROM s, obs)
  SELECT 'brand' AS "Layer", feature AS "Feature", v::BIGINT AS "Valid_N", round(prev, 6) AS "Prevalence",
  miss AS "Missing_Frac", (v > 0 AND prev BETWEEN 0.01 AND 0.99) AS "Keep", {QC_CASE} AS "Dropped_reason" FROM q""",
)
def brand_qc(spark, sf):
    return _qc(L.feature_qc(B.brand_layer(spark, sf)))


@query(
    "brand_coverage",
    f"""WITH {BRAND_SQL}, t AS (SELECT count(*) AS n_total FROM customer),
  f AS (SELECT count(DISTINCT feature) AS n_feat FROM hits)
  SELECT 'brand' AS "Layer", 'long' AS "Format", n_total::BIGINT AS "N_total", n_obs::BIGINT AS "N_observed",
  round(n_obs::DOUBLE / greatest(n_total, 1), 4) AS "Coverage", n_feat::BIGINT AS "N_features",
  ((n_total - n_obs) * n_feat)::BIGINT AS "Missing_cells" FROM obs, t, f""",
)
def brand_coverage(spark, sf):
    return L.layer_coverage(B.brand_layer(spark, sf))


@query(
    "priority_pivot_presence",
    """WITH h AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS f FROM orders)
  SELECT CAST(c_custkey AS VARCHAR) AS id, """
    + ", ".join(
        f"CASE WHEN count(h.f) > 0 THEN count(CASE WHEN h.f = '{v}' THEN 1 END)::BIGINT END AS {a}"
        for v, a in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "unspecified"), ("5-LOW", "low"))
    )
    + " FROM customer LEFT JOIN h ON h.k = c_custkey GROUP BY c_custkey",
)
def priority_pivot_presence(spark, sf):
    wide = L.pivot_wide(B.priority_layer(spark, sf))
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    none = F.lit(None).cast("bigint")
    return wide.select("id", *[(F.col(f"`{k}`").cast("bigint") if k in wide.columns else none).alias(a) for k, a in names.items()])


@query(
    "event_value_presence",
    """SELECT CAST(user_id AS VARCHAR) AS id, event_type AS feature, max(CASE WHEN value > 0 THEN 1 ELSE 0 END)::BIGINT AS present
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2""",
)
def event_value_presence(spark, sf):
    return B.event_layer(spark, sf).cells.select("id", "feature", F.col("value").cast("bigint").alias("present"))


@query(
    "event_qc",
    f"""WITH c AS (SELECT user_id AS id, event_type AS feature, max(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS x
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2), o AS (SELECT count(DISTINCT id) AS n_obs FROM c),
  q AS (SELECT feature, n_obs AS v, sum(x)::DOUBLE / n_obs AS prev, 0.0::DOUBLE AS miss FROM c, o GROUP BY feature, n_obs)
  SELECT 'ev' AS "Layer", feature AS "Feature", v::BIGINT AS "Valid_N", round(prev, 6) AS "Prevalence", miss AS "Missing_Frac",
  (prev BETWEEN 0.01 AND 0.99) AS "Keep", {QC_CASE} AS "Dropped_reason" FROM q""",
)
def event_qc(spark, sf):
    return _qc(L.feature_qc(B.event_layer(spark, sf)))


@query(
    "label_observed_coverage",
    """WITH o AS (SELECT count(DISTINCT l.doc_id) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL OR l.toxic IS NOT NULL),
  c AS (SELECT count(quality) + count(toxic) AS filled FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
  t AS (SELECT count(*) AS n_total FROM documents)
  SELECT 'lab' AS "Layer", 'wide' AS "Format", n_total::BIGINT AS "N_total", n::BIGINT AS "N_observed",
  round(n::DOUBLE / greatest(n_total, 1), 4) AS "Coverage", 2::BIGINT AS "N_features", (2 * n_total - filled)::BIGINT AS "Missing_cells" FROM o, c, t""",
)
def label_observed_coverage(spark, sf):
    return L.layer_coverage(B.label_layer(spark, sf))


@query(
    "label_qc_missing",
    f"""WITH c AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
  o AS (SELECT count(*) AS n_obs FROM c WHERE quality IS NOT NULL OR toxic IS NOT NULL),
  s AS (SELECT 'quality' AS feature, count(quality) AS v, avg(quality) AS prev FROM c UNION ALL
        SELECT 'toxic', count(toxic), avg(toxic) FROM c),
  q AS (SELECT feature, v, prev, (n_obs - v)::DOUBLE / n_obs AS miss FROM s, o)
  SELECT 'lab' AS "Layer", feature AS "Feature", v::BIGINT AS "Valid_N", round(prev, 6) AS "Prevalence", round(miss, 6) AS "Missing_Frac",
  (v > 0 AND prev BETWEEN 0.01 AND 0.99 AND miss <= 0) AS "Keep", {QC_CASE} AS "Dropped_reason" FROM q""",
)
def label_qc_missing(spark, sf):
    return _qc(L.feature_qc(B.label_layer(spark, sf)))


def _cells(df):
    return df.select("id", "feature", F.col("value").cast("bigint").alias("value"))


@query(
    "segment_onehot",
    """WITH v AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment IS NOT NULL)
  SELECT CAST(c_custkey AS VARCHAR) AS id, 'c_mktsegment_' || s AS feature,
  CASE WHEN c_mktsegment IS NULL THEN NULL WHEN c_mktsegment = s THEN 1 ELSE 0 END::BIGINT AS value FROM customer, v""",
)
def segment_onehot(spark, sf):
    return _cells(L.coerce_binary_wide(B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey"))


@query(
    "document_onehot",
    """WITH a AS (SELECT doc_id, 'lang' AS col, lang AS val FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
  v AS (SELECT DISTINCT col, val FROM a WHERE val IS NOT NULL)
  SELECT CAST(doc_id AS VARCHAR) AS id, a.col || '_' || v.val AS feature,
  CASE WHEN a.val IS NULL THEN NULL WHEN a.val = v.val THEN 1 ELSE 0 END::BIGINT AS value FROM a JOIN v USING (col)""",
)
def document_onehot(spark, sf):
    return _cells(L.coerce_binary_wide(B.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id"))


@query(
    "part_size_onehot_prevalence",
    """WITH v AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), t AS (SELECT count(*) AS m FROM part)
  SELECT 'p_size_' || CAST(p_size AS VARCHAR) AS feature, m::BIGINT AS valid_n, n::BIGINT AS n_pos FROM v, t""",
)
def part_size_onehot_prevalence(spark, sf):
    layer = L.wide_layer("size", B.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return L.feature_stats(layer).select("feature", "valid_n", "n_pos")


@query(
    "token_normalize",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id,
  CASE lower(trim(flag)) WHEN 'present' THEN 1.0 WHEN 'absent' THEN 0.0 WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0
    WHEN 't' THEN 1.0 WHEN 'f' THEN 0.0 WHEN '+' THEN 1.0 WHEN '-' THEN 0.0 ELSE try_cast(lower(trim(flag)) AS DOUBLE) END AS flag,
  o_totalprice AS price
  FROM (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 6 WHEN 0 THEN ' Present ' WHEN 1 THEN 'no' WHEN 2 THEN '+' WHEN 3 THEN 'F'
    WHEN 4 THEN '7' ELSE o_orderstatus || 'x' END AS flag FROM orders)""",
)
def token_normalize(spark, sf):
    m = F.col("o_orderkey") % 6
    flag = (
        F.when(m == 0, " Present ").when(m == 1, "no").when(m == 2, "+").when(m == 3, "F").when(m == 4, "7")
        .otherwise(F.concat("o_orderstatus", F.lit("x")))
    )
    df = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), flag.alias("flag"), F.col("o_totalprice").alias("price"))
    return L.normalize_binary_like(df, "id")


@query(
    "label_sample_filter",
    """SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND quality IS NOT NULL AND toxic IS NOT NULL""",
)
def label_sample_filter(spark, sf):
    return L.complete_cases(L.sample_filter(B.label_layer(spark, sf))).ids.select("id")


@query(
    "label_feature_missing_filter",
    """WITH u AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  s AS (SELECT 'quality' AS feature, 1 - count(quality)::DOUBLE / count(*) AS miss FROM u UNION ALL
        SELECT 'toxic', 1 - count(toxic)::DOUBLE / count(*) FROM u)
  SELECT feature FROM s WHERE miss <= 0.7""",
)
def label_feature_missing_filter(spark, sf):
    return L.feature_missing_filter(B.label_layer(spark, sf), 0.7).features


@query(
    "label_mean_impute",
    """WITH u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels),
  m AS (SELECT avg(quality) AS mq, avg(toxic) AS mt FROM u)
  SELECT CAST(doc_id AS VARCHAR) AS id, 'quality' AS feature, round(coalesce(quality, mq), 6) AS value FROM u, m UNION ALL
  SELECT CAST(doc_id AS VARCHAR), 'toxic', round(coalesce(toxic, mt), 6) FROM u, m""",
)
def label_mean_impute(spark, sf):
    df = B.table(spark, sf, "labels").withColumn("quality", F.when(F.col("doc_id") % 5 != 0, F.col("quality")))
    layer = L.wide_layer("lab", df.select("doc_id", "quality", "toxic"), "doc_id")
    return L.mean_impute(layer).select("id", "feature", F.round("value", 6).alias("value"))


@query(
    "qc_filtered_cells",
    f"""WITH {BRAND_SQL}, s AS (SELECT feature, count(*) AS n FROM hits JOIN customer ON c_custkey = id GROUP BY 1),
  k AS (SELECT feature FROM s, obs WHERE n::DOUBLE / n_obs BETWEEN 0.01 AND 0.75)
  SELECT feature, count(*)::BIGINT AS n_ids FROM hits JOIN customer ON c_custkey = id WHERE feature IN (SELECT feature FROM k) GROUP BY 1""",
)
def qc_filtered_cells(spark, sf):
    layer = B.brand_layer(spark, sf)
    kept = L.keep_features(layer, L.feature_qc(layer, 0.01, 0.75))
    return kept.cells.groupBy("feature").agg(F.count("*").alias("n_ids"))


@query(
    "layers_long_concat",
    f"""WITH {BRAND_SQL}
  SELECT 'brand' AS layer, feature, count(*)::BIGINT AS n FROM hits JOIN customer ON c_custkey = id GROUP BY 2
  UNION ALL SELECT 'priority', o_orderpriority, count(DISTINCT o_custkey)::BIGINT FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 2""",
)
def layers_long_concat(spark, sf):
    parts = [l.cells.withColumn("layer", F.lit(l.name)) for l in (B.brand_layer(spark, sf), B.priority_layer(spark, sf))]
    return parts[0].unionByName(parts[1]).groupBy("layer", "feature").agg(F.count("*").alias("n"))
