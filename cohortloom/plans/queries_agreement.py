"""Partition agreement, information, description length, enrichment and effect sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import agreement as A
from cohortloom.operators import enrichment as E
from cohortloom.operators import information as I
from cohortloom.plans import testbed as B
from cohortloom.plans.catalog import query


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in cols else c for c in df.columns])


# ------------------------------------------------------------ label tables


@query(
    "entropy_labels",
    """WITH c AS (SELECT p_brand AS l, count(*)::DOUBLE AS c FROM part GROUP BY 1)
  SELECT sum(c)::BIGINT AS n, count(*)::BIGINT AS n_labels, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS entropy FROM c""",
)
def entropy_labels(spark, sf):
    return _round(A.label_entropy(B.table(spark, sf, "part"), "p_brand"), "entropy")


@query(
    "contingency_lang_source",
    "SELECT lang AS label_a, source AS label_b, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2",
)
def contingency_lang_source(spark, sf):
    return A.contingency(B.table(spark, sf, "documents"), "lang", "source")


def metrics_sql(table_cte: str, keys: list[str]) -> str:
    """SQL of the partition metrics of ``ct(keys..., a, b, n)``."""
    k = "".join(f"{x}, " for x in keys)
    on = " AND ".join(f"x.{x} = y.{x}" for x in keys) or "TRUE"
    using = lambda s: f"USING ({k}{s})"
    group = f"GROUP BY {k[:-2]}" if keys else ""
    cols = "".join(f"x.{c}, " for c in keys)
    return f"""{table_cte}, ra AS (SELECT {k}a, sum(n)::DOUBLE AS ma FROM ct GROUP BY {k}a), rb AS (SELECT {k}b, sum(n)::DOUBLE AS mb FROM ct GROUP BY {k}b),
  c1 AS (SELECT {k}sum(n)::DOUBLE AS n, sum(n * ln(n)) AS xc, sum(n * (n - 1) / 2.0) AS pc, sum(n::DOUBLE * n / (ma * mb)) AS chi
         FROM ct JOIN ra {using('a')} JOIN rb {using('b')} {group}),
  c2 AS (SELECT {k}sum(ma * ln(ma)) AS xa, sum(ma * (ma - 1) / 2) AS pa, count(*)::DOUBLE AS ka FROM ra {group}),
  c3 AS (SELECT {k}sum(mb * ln(mb)) AS xb, sum(mb * (mb - 1) / 2) AS pb, count(*)::DOUBLE AS kb FROM rb {group}),
  m AS (SELECT {cols}x.*{' EXCLUDE (' + k[:-2] + ')' if keys else ''}, y.xa, y.pa, y.ka, z.xb, z.pb, z.kb FROM c1 x JOIN c2 y ON {on} JOIN c3 z ON {on.replace('y.', 'z.')}),
  h AS (SELECT *, ln(n) - xa / n AS ha, ln(n) - xb / n AS hb, greatest(0, ln(n) - xa / n - xb / n + xc / n) AS mi FROM m),
  g AS (SELECT *, CASE WHEN pc = pa AND pc = pb THEN 1.0 ELSE (pc - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) END AS ari,
    CASE WHEN ka = 1 AND kb = 1 THEN 1.0 WHEN mi <= 2.220446049250313e-16 THEN 0.0 ELSE 2 * mi / (ha + hb) END AS nmi, greatest(0, ha + hb - 2 * mi) AS vi,
    greatest(0, chi - 1 - (ka - 1) * (kb - 1) / (n - 1)) AS phi2,
    least(ka - (ka - 1) ** 2 / (n - 1) - 1, kb - (kb - 1) ** 2 / (n - 1) - 1) AS den FROM h),
  r AS (SELECT {k}n::BIGINT AS n, round(ari, 6) + 0.0 AS ari, round(nmi, 6) + 0.0 AS nmi, round(mi, 6) + 0.0 AS mi, round(vi, 6) + 0.0 AS vi,
    round(vi / ln(greatest(n, 2)), 6) + 0.0 AS nvi, round(CASE WHEN den <= 0 THEN 0.0 ELSE sqrt(phi2 / den) END, 6) + 0.0 AS cramers_v_bc FROM g)"""


METRICS = ("ari", "nmi", "mi", "vi", "nvi", "cramers_v_bc")


@query(
    "partition_metrics_lang_source",
    "WITH ct AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2)"
    + metrics_sql("", [])
    + " SELECT * FROM r",
)
def partition_metrics_lang_source(spark, sf):
    """VI, NVI, ARI, NMI, MI and Cramer's V of two document partitions."""
    return _round(A.partition_metrics(A.contingency(B.table(spark, sf, "documents"), "lang", "source")), *METRICS)


@query(
    "partition_metrics_class_signbits",
    "WITH ct AS (SELECT label AS a, (embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT AS b, count(*) AS n FROM embeddings GROUP BY 1, 2)"
    + metrics_sql("", [])
    + " SELECT * FROM r",
)
def partition_metrics_class_signbits(spark, sf):
    rows = B.emb_rows(spark, sf).withColumn("q", F.get("x", 0) * 2 + F.get("x", 1))
    return _round(A.partition_metrics(A.contingency(rows, "label", "q")), *METRICS)


def _layer_labels(spark, sf) -> DataFrame:
    """Four labelings of customers: segment, nation, account sign and order activity."""
    c = B.table(spark, sf, "customer")
    o = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    parts = [
        c.select(F.lit("a_segment").alias("layer"), F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("label")),
        c.select(F.lit("b_nation"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")),
        c.select(F.lit("c_sign"), F.col("c_custkey").cast("string"), (F.col("c_acctbal") > 0).cast("int").cast("string")),
        o.select(F.lit("d_orders"), F.col("o_custkey").cast("string"), F.least(F.floor(F.col("n") / 5), F.lit(4)).cast("string")),
    ]
    return reduce(DataFrame.union, parts)


LAYERS_SQL = """l AS (SELECT 'a_segment' AS layer, c_custkey AS id, c_mktsegment AS label FROM customer UNION ALL
  SELECT 'b_nation', c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL
  SELECT 'c_sign', c_custkey, CAST((c_acctbal > 0)::INT AS VARCHAR) FROM customer UNION ALL
  SELECT 'd_orders', o_custkey, CAST(least(count(*) // 5, 4) AS VARCHAR) FROM orders GROUP BY o_custkey)"""
PAIRS_SQL = "SELECT x.layer AS la, y.layer AS lb, x.label AS a, y.label AS b, count(*) AS n FROM l x JOIN l y ON x.id = y.id AND x.layer < y.layer GROUP BY 1, 2, 3, 4"


@query(
    "layer_concordance",
    f"WITH {LAYERS_SQL}, ct AS ({PAIRS_SQL})"
    + metrics_sql("", ["la", "lb"])
    + ' SELECT la AS "Layer_A", lb AS "Layer_B", n AS "N_shared", ari AS "ARI", nmi AS "NMI", vi AS "VI" FROM r WHERE n >= 4',
)
def layer_concordance(spark, sf):
    return _round(A.layer_concordance(_layer_labels(spark, sf)), "ARI", "NMI", "VI")


@query(
    "tool_consistency",
    f"WITH {LAYERS_SQL}, ct AS ({PAIRS_SQL})"
    + metrics_sql("", ["la", "lb"])
    + " SELECT la AS tool_a, lb AS tool_b, n AS n_overlap, ari, nmi, cramers_v_bc FROM r",
)
def tool_consistency(spark, sf):
    lab = _layer_labels(spark, sf)
    tables = {n: lab.where(F.col("layer") == n).select("id", "label") for n in ("a_segment", "b_nation", "c_sign", "d_orders")}
    return _round(A.compare_labelings(tables), "ari", "nmi", "cramers_v_bc")


@query(
    "label_overlap_matrix",
    f"WITH {LAYERS_SQL} SELECT la AS layer_a, lb AS layer_b, a AS label_a, b AS label_b, n::BIGINT AS n FROM ({PAIRS_SQL})",
)
def label_overlap_matrix(spark, sf):
    return A.layer_pair_table(_layer_labels(spark, sf))


@query("label_matching")
def label_matching(spark, sf):
    """Best one-to-one label mapping of every layer pair (optimality is tested against brute force)."""
    return A.match_labels(A.layer_pair_table(_layer_labels(spark, sf)), ["layer_a", "layer_b"])


# ------------------------------------------------- information and MDL

EMB_COUNTS_SQL = """u AS (SELECT label, unnest(range(64)) AS f, unnest(embedding) > 0 AS v FROM embeddings),
  fc AS (SELECT f AS feature, label, count(*)::DOUBLE AS n, sum(v::INT)::DOUBLE AS n1 FROM u GROUP BY 1, 2)"""
BITS_SQL = "-(q * log2(q) + (1 - q) * log2(1 - q))"


def _emb_counts(spark, sf):
    return I.vector_label_counts(B.emb_rows(spark, sf))


@query(
    "feature_partition_nmi",
    f"""WITH {EMB_COUNTS_SQL}, x AS (SELECT feature, n, n1 AS c1, n - n1 AS c0 FROM fc),
  s AS (SELECT feature, sum(n) AS n, sum(c1) AS one, sum(n * ln(n)) AS xl, sum(CASE WHEN c1 > 0 THEN c1 * ln(c1) ELSE 0 END + CASE WHEN c0 > 0 THEN c0 * ln(c0) ELSE 0 END) AS xc FROM x GROUP BY 1),
  h AS (SELECT *, ln(n) - xl / n AS hl, ln(n) - (one * ln(one) + (n - one) * ln(n - one)) / n AS hv FROM s WHERE n >= 5 AND one > 0 AND one < n),
  m AS (SELECT *, greatest(0, hl + hv - (ln(n) - xc / n)) AS mi FROM h)
  SELECT feature::BIGINT AS "Feature", n::BIGINT AS "N", round(CASE WHEN mi <= 2.220446049250313e-16 THEN 0.0 ELSE 2 * mi / (hl + hv) END, 6) AS "NMI_C_feature", round(mi, 6) AS "MI" FROM m""",
)
def feature_partition_nmi(spark, sf):
    df = I.feature_partition_nmi(_emb_counts(spark, sf))
    return _round(df.withColumn("Feature", F.col("Feature").cast("bigint")), "NMI_C_feature", "MI")


@query(
    "unexplained_bits",
    f"""WITH {EMB_COUNTS_SQL}, q AS (SELECT *, greatest(1e-9, least(1 - 1e-9, n1 / n)) AS q FROM fc)
  SELECT round(sum(n * {BITS_SQL}), 4) AS "Partition_Unexplained_Bits" FROM q""",
)
def unexplained_bits(spark, sf):
    return I.unexplained_bits(_emb_counts(spark, sf)).select(F.round("Partition_Unexplained_Bits", 4).alias("Partition_Unexplained_Bits"))


@query(
    "unexplained_bits_missing",
    f"""WITH c AS (SELECT l.doc_id, d.lang, CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels l JOIN documents d USING (doc_id)),
  u AS (SELECT lang, 'quality' AS f, quality AS v FROM c UNION ALL SELECT lang, 'toxic', toxic FROM c),
  q AS (SELECT f, lang, count(v) AS n, greatest(1e-9, least(1 - 1e-9, avg(v))) AS q FROM u GROUP BY 1, 2 HAVING count(v) > 0),
  k AS (SELECT f FROM q GROUP BY f HAVING sum(n) >= 2)
  SELECT round(sum(n * {BITS_SQL}), 6) AS "Partition_Unexplained_Bits" FROM q WHERE f IN (SELECT f FROM k)""",
)
def unexplained_bits_missing(spark, sf):
    from cohortloom.operators.layers import wide_layer

    df = B.table(spark, sf, "labels").withColumn("quality", F.when(F.col("doc_id") % 3 != 0, F.col("quality")))
    layer = wide_layer("lab", df.select("doc_id", "quality", "toxic"), "doc_id")
    lang = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("label"))
    return _round(I.unexplained_bits(I.label_counts(layer.cells, lang)), "Partition_Unexplained_Bits")


MDL_COLS = """round(ld + lm, 4) AS "MDL", round(ld, 4) AS "L_data", round(lm, 4) AS "L_model", k::BIGINT AS k, nn::BIGINT AS n, 64::BIGINT AS p"""


@query(
    "mdl_partition",
    f"""WITH {EMB_COUNTS_SQL}, t AS (SELECT count(*) AS nn FROM embeddings), q AS (SELECT *, greatest(1e-9, least(1 - 1e-9, n1 / n)) AS q FROM fc),
  d AS (SELECT sum(n * {BITS_SQL}) AS ld, count(DISTINCT label) AS k FROM q), m AS (SELECT *, k * 64 * log2(greatest(nn, 2)) AS lm FROM d, t)
  SELECT {MDL_COLS} FROM m""",
)
def mdl_partition(spark, sf):
    n = B.table(spark, sf, "embeddings").agg(F.count("*").alias("n")).scalar()
    return _mdl_round(I.mdl(_emb_counts(spark, sf), n, 64))


def _mdl_round(df):
    return df.select(*[F.round(c, 4).alias(c) if c in ("MDL", "L_data", "L_model", "Delta_to_min") else c for c in df.columns])


@query(
    "mdl_path",
    f"""WITH t AS (SELECT count(*) AS nn FROM embeddings), c AS (SELECT unnest(range(2, 7)) AS k_req),
  u AS (SELECT k_req, label % k_req AS label, unnest(range(64)) AS f, unnest(embedding) > 0 AS v FROM embeddings, c),
  fc AS (SELECT k_req, f, label, count(*)::DOUBLE AS n, sum(v::INT)::DOUBLE AS n1 FROM u GROUP BY 1, 2, 3),
  q AS (SELECT *, greatest(1e-9, least(1 - 1e-9, n1 / n)) AS q FROM fc),
  d AS (SELECT k_req, sum(n * {BITS_SQL}) AS ld, count(DISTINCT label) AS k FROM q GROUP BY 1), m AS (SELECT *, k * 64 * log2(greatest(nn, 2)) AS lm FROM d, t)
  SELECT k_req::BIGINT AS k_req, {MDL_COLS}, round(ld + lm - min(ld + lm) OVER (), 4) AS "Delta_to_min" FROM m""",
)
def mdl_path(spark, sf):
    rows = B.emb_rows(spark, sf).withColumn("k_req", F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(6).cast("bigint"))))
    rows = rows.withColumn("label", F.col("label") % F.col("k_req"))
    n = B.table(spark, sf, "embeddings").agg(F.count("*").alias("n")).scalar()
    return _mdl_round(I.mdl_path(I.mdl(I.vector_label_counts(rows, ["k_req"]), n, 64, ["k_req"])))


# ------------------------------------------------- enrichment and effects

SEG_COUNTS_SQL = """hits AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS feature FROM orders JOIN customer ON c_custkey = o_custkey),
  lab AS (SELECT c_custkey AS id, c_mktsegment AS label FROM customer WHERE c_custkey IN (SELECT id FROM hits)),
  sz AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), fs AS (SELECT DISTINCT feature FROM hits),
  pc AS (SELECT feature, label, count(*) AS n1 FROM hits JOIN lab USING (id) GROUP BY 1, 2),
  fc AS (SELECT feature, label, n, coalesce(n1, 0) AS n1 FROM fs CROSS JOIN sz LEFT JOIN pc USING (feature, label)),
  g AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n1) OVER (PARTITION BY feature) AS ones FROM fc)"""


def _segment_counts(spark, sf):
    seg = B.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("label"))
    return I.implied_label_counts(B.priority_layer(spark, sf), seg)


@query(
    "enrichment_counts",
    f"WITH {SEG_COUNTS_SQL} SELECT feature, label, n::BIGINT AS n, n1::DOUBLE AS n1, nn::BIGINT AS n_all, ones::DOUBLE AS ones FROM g",
)
def enrichment_counts(spark, sf):
    return E.with_rest(_segment_counts(spark, sf))


@query(
    "enrichment_z",
    f"""WITH {EMB_COUNTS_SQL}, g AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n1) OVER (PARTITION BY feature) AS ones FROM fc),
  r AS (SELECT feature, label, ones / nn AS pg, n1 / n AS pc, n FROM g)
  SELECT feature::BIGINT AS "Feature", label::BIGINT AS "Cluster", round_even(pg, 4) AS "Prev_Global", round_even(pc, 4) AS "Prev_Cluster",
  round_even((pc - pg) / sqrt(pg * (1 - pg) / n), 4) + 0.0 AS z FROM r WHERE n >= 30 AND pg BETWEEN 0.05 AND 0.95""",
)
def enrichment_z(spark, sf):
    df = E.enrichment_tests(_emb_counts(spark, sf)).where("Test = 'z'")
    return df.select(
        F.col("Feature").cast("bigint").alias("Feature"), F.col("Cluster").cast("bigint").alias("Cluster"),
        "Prev_Global", "Prev_Cluster", (F.col("Z") + F.lit(0.0)).alias("z"),
    )


@query(
    "fisher_exact",
    """WITH k AS (SELECT p_brand AS feature, p_type AS label, count(*) AS a FROM part GROUP BY 1, 2),
  t AS (SELECT k.*, (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM part p WHERE p.p_brand = k.feature) AS c1, (SELECT count(*) FROM part p WHERE p.p_type = k.label) AS r1 FROM k),
  s AS (SELECT *, unnest(range(greatest(0, r1 + c1 - n)::BIGINT, least(r1, c1)::BIGINT + 1)) AS x FROM t),
  l AS (SELECT *, lgamma(r1 + 1) + lgamma(n - r1 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1)
    - lgamma(x + 1) - lgamma(c1 - x + 1) - lgamma(r1 - x + 1) - lgamma(n - r1 - c1 + x + 1) AS lp FROM s),
  o AS (SELECT *, max(CASE WHEN x = a THEN lp END) OVER (PARTITION BY feature, label) AS l0 FROM l)
  SELECT feature, label, a::BIGINT AS a, round(least(1.0, sum(CASE WHEN lp <= l0 + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM o GROUP BY 1, 2, 3""",
)
def fisher_exact(spark, sf):
    from cohortloom.functions.special import fisher_p

    part = B.table(spark, sf, "part")
    k = part.groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("label")).agg(F.count("*").alias("a"))
    c = part.groupBy(F.col("p_brand").alias("feature")).agg(F.count("*").alias("c1"))
    r = part.groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("r1"))
    n = part.agg(F.count("*").alias("n")).scalar()
    t = k.join(c, "feature").join(r, "label").withColumn("n", n)
    p = fisher_p("a", F.col("r1") - F.col("a"), F.col("c1") - F.col("a"), F.col("n") - F.col("r1") - F.col("c1") + F.col("a"))
    return t.select("feature", "label", "a", F.round(p, 6).alias("p"))


def _adjust_sql(method: str) -> str:
    base = """WITH t AS (SELECT p_partkey AS id, (p_retailprice - floor(p_retailprice)) * (p_size / 50.0) + 0.0001 AS p FROM part),
  r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM t)"""
    expr = {
        "fdr_bh": "min(p * m / k) OVER (ORDER BY k DESC)",
        "fdr_by": "min(p * m / k * (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) FROM part) + 1) s(i))) OVER (ORDER BY k DESC)",
        "holm": "max((m - k + 1) * p) OVER (ORDER BY k)",
        "simes-hochberg": "min((m - k + 1) * p) OVER (ORDER BY k DESC)",
        "bonferroni": "p * m",
        "sidak": "1 - pow(1 - p, m)",
        "holm-sidak": "max(1 - pow(1 - p, m - k + 1)) OVER (ORDER BY k)",
        "fdr_gbs": "max((m + 1 - k) / k * p / (1 - p)) OVER (ORDER BY k)",
        "fdr_tsbh": "b * (SELECT CASE WHEN count(*) BETWEEN 1 AND max(o.m) - 1 THEN 1 - count(*) / max(o.m) ELSE 1 END FROM q o WHERE o.b <= 0.05)",
        "fdr_tsbky": "1.05 * b * (SELECT CASE WHEN count(*) BETWEEN 1 AND max(o.m) - 1 THEN 1 - count(*) / max(o.m) ELSE 1 END FROM q o WHERE o.b <= 0.05 / 1.05)",
    }[method]
    if method.startswith("fdr_ts"):
        return f"{base}, q AS (SELECT *, min(p * m / k) OVER (ORDER BY k DESC) AS b FROM r) SELECT id::BIGINT AS id, round(least(1.0, {expr}), 6) AS p_adj FROM q"
    return f"{base} SELECT id::BIGINT AS id, round(least(1.0, {expr}), 6) AS p_adj FROM r"


def _adjusted(method):
    def run(spark, sf):
        price = F.col("p_retailprice")
        t = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((price - F.floor(price)) * (F.col("p_size") / F.lit(50.0)) + F.lit(0.0001)).alias("P"))
        return E.adjust_p(t, "P", method).select("id", F.round("P_adj", 6).alias("p_adj"))

    return run


for _m in ("fdr_bh", "fdr_by", "holm", "simes-hochberg", "bonferroni", "sidak", "holm-sidak", "fdr_gbs", "fdr_tsbh", "fdr_tsbky"):
    query("adjust_" + _m.replace("-", "_"), _adjust_sql(_m))(_adjusted(_m))


@query("enrichment_full")
def enrichment_full(spark, sf):
    """Enrichment with P, corrected P and significance (normal tail and exact tests have no SQL form)."""
    return E.enrichment(_segment_counts(spark, sf))


@query(
    "cliff_delta",
    f"""WITH {SEG_COUNTS_SQL} SELECT feature AS "Feature", label AS "Cluster", n::BIGINT AS n_in, (nn - n)::BIGINT AS n_out,
  round(n1::DOUBLE / n - (ones - n1)::DOUBLE / (nn - n), 6) + 0.0 AS delta,
  CASE WHEN abs(n1::DOUBLE / n - (ones - n1)::DOUBLE / (nn - n)) >= 0.474 THEN 'large' WHEN abs(n1::DOUBLE / n - (ones - n1)::DOUBLE / (nn - n)) >= 0.33 THEN 'medium'
  WHEN abs(n1::DOUBLE / n - (ones - n1)::DOUBLE / (nn - n)) >= 0.147 THEN 'small' ELSE 'negligible' END AS magnitude FROM g""",
)
def cliff_delta(spark, sf):
    df = E.cliff_delta(_segment_counts(spark, sf))
    return df.select("Feature", "Cluster", "n_in", "n_out", (F.round("delta", 6) + F.lit(0.0)).alias("delta"), E.magnitude(F.col("delta")).alias("magnitude"))


@query("cliff_delta_interval")
def cliff_delta_interval(spark, sf):
    return E.cliff_delta_table(_segment_counts(spark, sf))


# ------------------------------------------------------------- NVI summaries


@query(
    "nvi_summary",
    "WITH ct AS (SELECT n_chars % 3 + 2 AS k, doc_id % 5 AS split, lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2, 3, 4)"
    + metrics_sql("", ["k", "split"]).replace("round(vi / ln(greatest(n, 2)), 6) + 0.0 AS nvi", "vi / ln(greatest(n, 2)) AS nvi")
    + """ SELECT k::BIGINT AS k, round(avg(nvi), 6) AS "NVI_Mean", round(stddev_pop(nvi), 6) AS "NVI_Std",
  round(quantile_cont(nvi, 0.025), 6) AS "NVI_CI_Lo", round(quantile_cont(nvi, 0.975), 6) AS "NVI_CI_Hi" FROM r GROUP BY 1""",
)
def nvi_summary(spark, sf):
    """Mean, deviation and percentile interval of split-wise NVI, per k."""
    from cohortloom.operators.consensus import summarise_nvi

    d = B.table(spark, sf, "documents").withColumn("k", F.col("n_chars") % 3 + 2).withColumn("split", F.col("doc_id") % 5)
    draws = A.partition_metrics(A.contingency(d, "lang", "source", ["k", "split"]), ["k", "split"])
    return _round(summarise_nvi(draws), "NVI_Mean", "NVI_Std", "NVI_CI_Lo", "NVI_CI_Hi")
