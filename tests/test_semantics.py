"""Hand-computed micro-fixtures for loading, QC, statistics and resampling rules."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.special import fisher_two_sided
from cohortloom.operators import agreement as A
from cohortloom.operators import enrichment as E
from cohortloom.operators import layers as L
from cohortloom.operators import overlap as O
from cohortloom.operators import phylo as P
from cohortloom.operators import quality as Q
from cohortloom.operators import resample as R
from cohortloom.operators import topology as T
from cohortloom.operators.fusion import ascend, to_simplex


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_positive_list_observed_rules(spark):
    rows = spark.createDataFrame(
        [("A", "f1", "1"), ("B", "f2", "0"), ("C", "f1", None), ("C", "f2", "x")], "id string, f string, v string"
    )
    layer = L.positive_list("m", rows, "id", "f", "v", ids(spark, "ABCD"))
    wide = {r["id"]: (r["f1"], r["f2"]) for r in L.pivot_wide(layer).collect()}
    assert wide == {"A": (1, 0), "B": (0, 0), "C": (None, None), "D": (None, None)}
    cov = L.layer_coverage(layer).first()
    assert (cov["N_total"], cov["N_observed"], cov["Missing_cells"], cov["Format"]) == (4, 2, 4, "long")


def test_wide_keeps_missing_and_one_hot(spark):
    df = spark.createDataFrame(
        [("S1", "1", None, "3.0", "red"), ("S2", None, "true", "4.5", None), ("S3", "0", "false", None, "blue")],
        "id string, a string, b string, c string, d string",
    )
    got = {(r["id"], r["feature"]): r["value"] for r in L.coerce_binary_wide(df, "id").collect()}
    assert [got[(s, "a")] for s in ("S1", "S2", "S3")] == [1, None, 0]
    assert [got[(s, "b")] for s in ("S1", "S2", "S3")] == [None, 1, 0]
    assert [got[(s, "c_3")] for s in ("S1", "S2", "S3")] == [1, 0, None]
    assert [got[(s, "c_4.5")] for s in ("S1", "S2", "S3")] == [0, 1, None]
    assert [got[(s, "d_red")] for s in ("S1", "S2", "S3")] == [1, None, 0]
    salted = {}
    keep, L.BROADCAST_LEVELS = L.BROADCAST_LEVELS, 0
    try:
        salted = {(r["id"], r["feature"]): r["value"] for r in L.coerce_binary_wide(df, "id").collect()}
    finally:
        L.BROADCAST_LEVELS = keep
    assert salted == got


def test_qc_reason_precedence(spark):
    data = [(f"S{i}", 1 if i == 0 else 0, 1, None, (1 if i % 2 else 0) if i else None) for i in range(200)]
    df = spark.createDataFrame(data, "id string, rare int, common int, gone int, part int")
    layer = L.wide_layer("x", df, "id")
    rep = {r["Feature"]: r for r in L.feature_qc(layer).collect()}
    assert {k: v["Dropped_reason"] for k, v in rep.items()} == {
        "rare": "too_rare", "common": "too_common", "gone": "too_many_missing", "part": "too_many_missing"
    }
    loose = {r["Feature"]: r["Dropped_reason"] for r in L.feature_qc(layer, max_missing_frac=1.0).collect()}
    assert loose["gone"] == "all_missing" and loose["part"] == ""
    assert L.keep_features(layer, L.feature_qc(layer, max_missing_frac=0.5)).features.collect()[0]["feature"] == "part"


def test_long_detection(spark):
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert L.is_long_format(mk([("a", "x"), ("a", "y")], "id string, f string"), "id")
    assert not L.is_long_format(mk([("a", "x"), ("b", "y")], "id string, f string"), "id")
    assert not L.is_long_format(mk([("a", "1"), ("a", "2")], "id string, f string"), "id")
    assert L.is_long_format(mk([("a", "x", "1"), ("a", "y", None)], "id string, f string, v string"), "id")
    assert not L.is_long_format(mk([("a", "x", "z"), ("a", "y", "q")], "id string, f string, v string"), "id")


def test_overlap_edge_cases(spark):
    d = {"a": ids(spark, "xyz"), "b": ids(spark, "xyz"), "c": ids(spark, "w"), "e": ids(spark, "w").limit(0)}
    got = {(r["dataset_a"], r["dataset_b"]): r for r in O.pairwise_overlap(d).collect()}
    assert got[("a", "b")]["jaccard"] == 1.0 and got[("a", "c")]["jaccard"] == 0.0
    assert got[("c", "e")]["recall_b_in_a"] is None and got[("a", "e")]["union"] == 3
    assert O.reference_dataset(["AMR", "my_mic_2"]) == "my_mic_2" and O.reference_dataset(["mic2", "MIC"]) == "MIC"


def test_partition_metrics_known_values(spark):
    def metrics(a, b):
        df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
        return A.partition_metrics(A.contingency(df, "a", "b")).first()

    same = metrics([0, 0, 1, 1, 2, 2], [5, 5, 6, 6, 7, 7])
    assert math.isclose(same["ari"], 1) and math.isclose(same["nmi"], 1) and same["vi"] < 1e-12
    cross = metrics([0, 0, 1, 1], [0, 1, 0, 1])
    assert math.isclose(cross["vi"], 2 * math.log(2)) and cross["cramers_v_bc"] == 0 and math.isclose(cross["ari"], -0.5)
    perfect = metrics([0, 1, 2] * 20, [0, 1, 2] * 20)
    n, k = 60, 3
    phi = 2 - 4 / (n - 1)
    assert math.isclose(perfect["cramers_v_bc"], math.sqrt(phi / (k - 4 / (n - 1) - 1)))
    assert metrics([1, 1, 1], [2, 2, 2])["cramers_v_bc"] == 0.0


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for shape in ((4, 4), (3, 5), (5, 3)):
        w = rng.integers(0, 9, shape)
        got = sum(w[i, j] for i, j in A.max_overlap_assignment(w.tolist()))
        t = w if shape[0] <= shape[1] else w.T
        want = max(sum(t[i, p[i]] for i in range(len(t))) for p in itertools.permutations(range(t.shape[1]), len(t)))
        assert got == want


def test_fisher_and_enrichment_signal(spark):
    assert math.isclose(fisher_two_sided(3, 1, 1, 3), 34 / 70)
    assert math.isclose(fisher_two_sided(8, 2, 1, 5), 0.03496503496503495)
    assert fisher_two_sided(10**8, 10**8, 10**8, 10**8) == 1.0
    counts = spark.createDataFrame(
        [("f", 0, 50, 45.0), ("f", 1, 100, 5.0), ("g", 0, 50, 20.0), ("g", 1, 100, 40.0)], "feature string, label int, n long, n1 double"
    )
    r = {(x["Feature"], x["Cluster"]): x for x in E.enrichment(counts).collect()}
    assert r[("f", 0)]["Significant"] and r[("f", 0)]["Z"] > 5 and not r[("g", 0)]["Significant"]
    c = {(x["Feature"], x["Cluster"]): x for x in E.cliff_delta_table(counts, 200).collect()}
    assert c[("f", 0)]["Delta"] == 0.85 and c[("f", 0)]["Magnitude"] == "large" and c[("g", 0)]["Magnitude"] == "negligible"
    assert c[("f", 0)]["CI_Lo"] < 0.85 < c[("f", 0)]["CI_Hi"]


def test_correction_with_ties(spark):
    p = [0.01, 0.01, 0.04, 0.04, 0.04, 0.5, 1.0, 1.0, 1.0, 1e-9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(99, None)], "i int, P double")
    got = {r["i"]: r["P_adj"] for r in E.adjust_p(df).collect()}
    order = np.argsort(p, kind="stable")
    want, low = {}, 1.0
    for rank in range(len(p), 0, -1):
        low = min(low, p[order[rank - 1]] * len(p) / rank)
        want[int(order[rank - 1])] = low
    assert got[99] is None and all(math.isclose(got[i], want[i]) for i in want)


def test_informativeness_and_degeneracy(spark):
    df = spark.createDataFrame(
        [(f"S{i}", "Present" if i < 5 else "absent", None, "same", float(i % 4)) for i in range(20)],
        "id string, flag string, gone string, const string, num double",
    )
    r = {x["feature"]: x for x in Q.feature_informativeness(df, "id").collect()}
    assert r["flag"]["feature_type"] == "binary" and r["flag"]["prevalence_present"] == 0.25
    assert r["gone"]["feature_type"] == "unknown" and r["gone"]["constant_feature"] and r["gone"]["informativeness_score"] == 0
    assert r["num"]["feature_type"] == "numeric" and math.isclose(r["num"]["entropy_bits"], 2.0)
    assert r["const"]["constant_feature"] and r["const"]["low_informativeness_flag"]
    rep = Q.check_degeneracy(features=df, id_col="id")
    assert rep["status"] == "WARN" and rep["checks"]["all_missing_feature_count"] == 1
    assert rep["warnings"] == ["empty_features"] and rep["failures"] == []
    short = Q.check_degeneracy(features=df.limit(3), id_col="id")
    assert short["status"] == "FAIL" and "few_samples" in short["failures"]
    one = spark.createDataFrame([("a",), ("a",)], "label string")
    assert Q.check_degeneracy(labels=one)["failures"] == ["single_label"]
    assert Q.check_degeneracy(labels=one.limit(0))["failures"] == ["no_labels"]


def test_gate_codes(spark):
    flights = [Q.DatasetPreflight("a", "a", 100, 3, "id", 90, 0, 10, ""), Q.DatasetPreflight("b", "b", 0, 1, "id", 0, 0, 0, "")]
    gate = Q.quality_gate(flights, [{"jaccard": 0.1}, {"jaccard": None}])
    assert gate["status"] == "FAIL" and gate["failures"] == ["b: no_rows"]
    assert sorted(gate["warnings"]) == ["a: duplicate_ids", "b: single_column", "id_overlap: weak_id_overlap"]
    assert Q.quality_gate(flights[:1], [], {"max_duplicate_id_fraction_warn": 0.2})["status"] == "PASS"


def test_correction_names_and_certain_p(spark):
    t = spark.createDataFrame([(0.01,), (0.2,), (1.0,), (None,)], "P double")
    for short, full in (("s", "sidak"), ("hs", "holm-sidak"), ("fdrp", "fdr_bh")):
        a, b = ({r["P"]: r["P_adj"] for r in E.adjust_p(t, "P", m).collect()} for m in (short, full))
        assert a == b and a[1.0] == 1.0 and a[None] is None


def test_long_cells_are_read(spark):
    df = spark.createDataFrame([("a", "1." + "0" * 80), ("b", "0")], "id string, v string")
    assert Q.feature_informativeness(df, "id").first()["feature_type"] == "binary"


def test_resampling_ignores_partitioning(spark):
    d = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("label"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(R.subsample(d, 3, 0.8, 1)) == key(R.subsample(d.repartition(5), 3, 0.8, 1))
    s = R.subsample(d, [4, 9], 0.8, 1)
    assert {r["run"]: r["c"] for r in s.groupBy("run").agg(F.count_distinct("id").alias("c")).collect()} == {4: 800, 9: 800}
    perm = R.permute_labels(d, 2, 5)
    for run in (0, 1):
        got = {r["label"]: r["count"] for r in perm.where(F.col("run") == run).groupBy("label").count().collect()}
        assert got == {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert key(perm) == key(R.permute_labels(d.repartition(3), 2, 5))
    assert R.subsample(d.limit(2), 1, 0.1, 1).count() == 2


def test_permuted_labels_by_buckets_of_positions(spark):
    n = 100_000
    many = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("label"))  # all labels distinct
    got = R.permute_labels(many, 1, 5)
    assert got.agg(F.count("label"), F.count_distinct("label"), F.count_distinct("id")).first() == (n, n, n)
    assert got.join(R.ranked(many.select("id"), 1, 5), ["run", "id"]).where("label != rnk - 1").count() == 0
    hot = spark.range(300).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 200, "hot").when(F.col("id") < 290, F.col("id").cast("string")).alias("label"))
    perm = R.permute_labels(hot, 2, 5)
    counts = {(r["run"], r["label"]): r["count"] for r in perm.groupBy("run", "label").count().collect()}
    assert counts[0, "hot"] == counts[1, "hot"] == 200 and counts[0, None] == counts[1, None] == 10
    assert R.permute_labels(hot.limit(0), 2, 5).collect() == []


def test_tree_distances(spark):
    rng = random.Random(4)
    parent = {0: None, 60: None} | {i: rng.randrange(i) for i in range(1, 60)} | {i: 60 for i in range(61, 64)}  # two roots
    length = {i: rng.random() for i in parent}
    tree = spark.createDataFrame(
        [(f"n{i}", None if p is None else f"n{p}", length[i], f"t{i}" if i % 3 else None) for i, p in parent.items()],
        "node string, parent string, length double, name string",
    )
    name = {i: f"t{i}" if i % 3 else f"n{i}" for i in parent}

    def path(i):
        out = [i]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    want = {}
    for i in parent:
        for j in parent:
            a, b = path(i), path(j)
            if a[-1] == b[-1]:
                want[name[i], name[j]] = sum(length[v] for v in set(a) ^ set(b))
    pairs = spark.createDataFrame([(name[i], name[j]) for i in parent for j in parent] + [("t1", "nobody")], "a string, b string")
    got = {(r["a"], r["b"]): r["dist"] for r in P.tree_distances(tree, pairs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    loop = spark.createDataFrame([("a", "b", 1.0, None), ("b", "a", 1.0, None)], tree.schema)
    with pytest.raises(ValueError, match="cycle"):
        P.jump_levels(loop)


def test_tree_distances_on_a_deep_ladder(spark):
    n = 100_000
    tree = spark.range(n).select(
        F.col("id").cast("string").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).cast("string").alias("parent"),
        F.lit(1.0).alias("length"), F.lit(None).cast("string").alias("name"),
    )
    pairs = spark.createDataFrame([("0", str(n - 1)), ("17", "70000"), ("5", "5"), ("99999", "99998")], "a string, b string")
    assert sorted(r["dist"] for r in P.tree_distances(tree, pairs).collect()) == [0.0, 1.0, 69983.0, n - 1.0]


def test_newick_and_purity(spark):
    rows = P.parse_newick("((A:1,'B b':2)x:3,(C:1,D:1):0.5)[note];")
    assert [(n[3], n[2]) for n in rows if n[3]] == [("x", 3.0), ("A", 1.0), ("B b", 2.0), ("C", 1.0), ("D", 1.0)]
    tree = spark.createDataFrame(
        [(str(n), None if p is None else str(p), l, name) for n, p, l, name in P.parse_newick("((A:1,B:2):3,(C:1,D:1):0.5);")],
        "node string, parent string, length double, name string",
    )
    anc = P.ancestors(tree)
    names = "ABCD"
    pairs = spark.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string")
    d = {(r["a"], r["b"]): r["dist"] for r in P.patristic(tree, anc, pairs).collect()}
    assert d == {("A", "B"): 3.0, ("A", "C"): 5.5, ("A", "D"): 5.5, ("B", "C"): 6.5, ("B", "D"): 6.5, ("C", "D"): 2.0}
    lab = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2), ("D", 2)], "id string, label int")
    r = P.phylo_purity(tree, anc, lab, 5, 1).first()
    assert math.isclose(r["Purity_between_over_within"], 6.0 / 2.5) and 0 < r["Perm_P"] <= 1 and r["N"] == 4


def test_persistence_of_a_ring_and_components():
    n = 12
    step = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    ring = np.minimum(step, n - step).astype(float)
    assert T.loop_bars(ring) == [(1.0, 4.0)]
    assert T.component_bars(ring) == [(0.0, 1.0)] * (n - 1) + [(0.0, math.inf)]
    line = step.astype(float)
    assert T.loop_bars(line) == []


def test_weight_search_improves_on_uniform():
    a, b = np.array([2.0, -1.0]), np.array([0.5, 0.5])
    gap = lambda w: (float(a @ w), a)
    w = ascend(gap, b)
    assert math.isclose(w.sum(), 1) and a @ w > 0.9
    assert np.allclose(to_simplex(np.array([0.2, 0.3, 0.5])), [0.2, 0.3, 0.5])
    assert pytest.approx(to_simplex(np.array([3.0, 0.0]))) == [1.0, 0.0]


def test_overlap_of_many_datasets(spark):
    from cohortloom.operators import overlap as O

    sets = {f"d{i}": spark.createDataFrame([("all",), (f"own{i}",), (None,)], "id string") for i in range(70)}
    assert [r["id"] for r in O.id_intersection(sets).collect()] == ["all"]
    got = {(r["dataset_a"], r["dataset_b"]): (r["n_ids_a"], r["n_ids_b"], r["intersection"], r["union"]) for r in O.pairwise_overlap(sets).collect()}
    assert len(got) == 70 * 69 // 2 and set(got.values()) == {(2, 2, 1, 3)}


def test_two_stage_corrections(spark):
    p = [0.0002, 0.001, 0.001, 0.004, 0.02, 0.03, 0.2, 0.5, 0.5, 0.9, 1.0, None]
    n = 11
    got = {m: [r.P_adj for r in E.adjust_p(spark.createDataFrame(list(enumerate(p)), "i int, P double"), method=m).orderBy("i").collect()] for m in ("fdr_bh", "fdr_tsbh", "fdr_tsbky", "fdr_gbs")}
    for method, widen in (("fdr_tsbh", 1.0), ("fdr_2sbky", 1.05)):
        hits = sum(b <= 0.05 / widen for b in got["fdr_bh"][:n])
        assert 0 < hits < n
        rows = E.adjust_p(spark.createDataFrame(list(enumerate(p)), "i int, P double"), method=method).orderBy("i").collect()
        want = [min(1.0, b * widen * (n - hits) / n) for b in got["fdr_bh"][:n]]
        assert [r.P_adj for r in rows[:n]] == pytest.approx(want) and rows[n].P_adj is None
    top, want = 0.0, []
    for k, x in enumerate(p[:n], 1):
        top = max(top, (n + 1 - k) / k * x / (1 - x) if x < 1 else float("inf"))
        want.append(min(1.0, top))
    want[2], want[8] = want[1], want[7]
    assert got["fdr_gbs"][:n] == pytest.approx(want)
    none = E.adjust_p(spark.createDataFrame([(0, 0.4), (1, 0.9)], "i int, P double"), method="fdr_tsbky").orderBy("i").collect()
    assert [r.P_adj for r in none] == pytest.approx([0.84, 0.945])
    assert E.adjust_p(spark.createDataFrame([], "i int, P double"), method="fdr_tsbh").count() == 0


def test_few_labels_are_permuted_without_ranks(spark, monkeypatch):
    """Labels cut from the draws equal labels met by ranks, nulls included, and bring carried columns along."""
    data = [(f"r{i}", None if i % 11 == 0 else "abc"[i % 7 % 3], i) for i in range(400)]
    d = spark.createDataFrame(data, "id string, label string, extra int").repartition(5)
    key = lambda t: sorted((r["run"], r["id"], r["label"] or "") for r in t.collect())
    monkeypatch.setattr(R, "FEW_LABELS", 0)
    want = key(R.permute_labels(d, 3, 5))
    monkeypatch.undo()

    def refuse(*a):
        raise AssertionError("ranks of all rows")

    monkeypatch.setattr(R, "ranked", refuse)
    got = R.permute_labels(d, 3, 5, ["extra"])
    assert key(got) == want
    assert got.where("id != concat('r', extra)").isEmpty()
