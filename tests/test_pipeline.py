import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from conftest import planted
from cohortloom import cli
from cohortloom.config import Config
from cohortloom.plans import preflight
from cohortloom.plans.pipeline import Pipeline
from cohortloom.sources import tables


def write_csv(path, header, rows):
    path.write_text("\n".join([",".join(header)] + [",".join(str(v) for v in r) for r in rows]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    x, y = planted(12)
    ids = [f"S{i:03d}" for i in range(len(x))]
    wide = write_csv(d / "amr.csv", [f"feat_{j}" for j in range(12)] + ["Strain_ID"], [[*r, i] for r, i in zip(x, ids)])
    z, _ = planted(12, seed=3)
    hits = [(i, f"gene{j}") for i, r in zip(ids[:-1], z) for j in np.nonzero(r)[0]]
    hits += hits[:5]
    long = write_csv(d / "mge.csv", ["Strain_ID", "element"], hits)
    tree = d / "t.nwk"
    clade = lambda part: "(" + ",".join(f"{i}:1" for i in part) + "):2"
    tree.write_text("(" + ",".join(clade(ids[g * 12 : g * 12 + 12]) for g in range(3)) + ");")
    return d, wide, long, str(tree), y


def test_full_run(spark, inputs, tmp_path):
    d, wide, long, tree, y = inputs
    cfg = {
        "schema_version": "1.1",
        "layers": [{"name": "AMR", "path": wide}, {"name": "MGE", "path": long}],
        "output_dir": str(tmp_path / "out"),
        "consensus": {"algorithms": ["agglomerative_hamming"], "k_range": [2, 3], "n_consensus_runs": 10, "n_stability_splits": 2},
        "profiling": {"shap_enabled": False, "tda_enabled": True, "tda_n_subsample": 20, "effect_size_bootstrap": 20},
        "phylo_validation": {"enabled": True, "tree_path": tree, "n_perm": 5},
        "seed": 0,
    }
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(cfg))
    assert cli.main(["--config", str(path)]) == 0
    out = tmp_path / "out"
    expected = [
        "integrated_clusters.csv", "run_manifest.json", "config_used.yaml", "config_validation.json", "layer_coverage.csv",
        "feature_qc.csv", "AMR/clusters.csv", "AMR/stability_path.csv", "AMR/consensus_matrix.parquet", "AMR/assignment_confidence.csv",
        "AMR/enrichment_z.csv", "AMR/cliff_delta.csv", "AMR/persistence_diagram.csv", "AMR/tda_summary.csv", "AMR/phylo_purity.csv",
        "MGE/clusters.csv", "layer_concordance.csv", "layer_label_matching.csv", "cka_matrix.csv", "layer_weights.csv",
        "fused_mode_summary.csv", "fused_mdl_path.csv", "fused_clusters.csv", "prediction_strength.csv", "partition_info.csv",
        "AMR_feature_partition_nmi.csv",
    ]
    assert [e for e in expected if not (out / e).exists()] == []
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(str(out / n))
    integrated = read("integrated_clusters.csv")
    assert integrated.count() == 36 and set(integrated.columns) == {"Strain_ID", "AMR_Cluster", "MGE_Cluster"}
    assert integrated.where(F.col("MGE_Cluster").isNull()).count() == 1  # the id without detections stays missing
    w = read("layer_weights.csv").toPandas()
    assert np.isclose(w["Weight"].sum(), 1, atol=1e-4)
    assert read("AMR/phylo_purity.csv").first()["N"] == 36
    manifest = json.loads((out / "run_manifest.json").read_text())
    assert manifest["algorithms_used"] == ["agglomerative_hamming"]


def test_config_round_trip_and_unknown_keys(tmp_path, monkeypatch):
    cfg = Config.from_dict({"qc": {"min_prev": 0.2, "odd": 1}, "layers": [{"name": "a", "path": "p", "x": 1}], "zzz": 2})
    assert cfg.feature_qc.min_prev == 0.2
    assert cfg.validation["unknown_keys"] == ["feature_qc.odd", "layers[0].x", "zzz"]
    cfg.to_yaml(str(tmp_path / "c.yaml"))
    assert Config.from_yaml(str(tmp_path / "c.yaml")) == cfg
    with pytest.raises(ValueError):
        Config.from_dict({"config_strict": True, "zzz": 2})


def test_preflight_and_consistency(spark, inputs, tmp_path):
    d, wide, long, _, y = inputs
    gate = preflight.run_preflight(
        spark, {"amr": wide, "mge": long}, str(tmp_path / "r"), {}, {"amr": "Strain_ID", "mge": "Strain_ID"}
    )
    assert gate["status"] == "WARN" and any("duplicate" in w for w in gate["warnings"])
    assert gate["n_pairwise_overlap_checks"] == 1
    for n in ("quality_gate.json", "analysis_validity_warnings.json", "run_manifest.json", "pairwise_id_overlap.csv"):
        assert (tmp_path / "r" / n).exists()
    assert set(preflight.load_warning_payload(str(tmp_path / "r"))) == {"quality_gate.json", "analysis_validity_warnings.json", "run_manifest.json"}
    one = write_csv(tmp_path / "a.csv", ["id", "cluster"], [(f"S{i:03d}", v) for i, v in enumerate(y)])
    two = write_csv(tmp_path / "b.csv", ["id", "other"], [(f"S{i:03d}", v + 5) for i, v in enumerate(y)])
    flat = write_csv(tmp_path / "c.csv", ["id", "label"], [(f"S{i:03d}", 1) for i in range(9)])
    rep = preflight.consistency_report(
        spark,
        {"a": {"path": one, "label_col": "cluster"}, "b": {"path": two, "label_col": "cluster"}, "c": {"path": flat}, "d": {"path": "nope.csv"}},
    )
    assert rep["status"] == "PASS" and rep["tools_compared"] == ["a", "b"]
    assert {k: v["reason"] for k, v in rep["tools_skipped"].items()} == {"c": "degenerate_labels", "d": "file_missing"}
    assert np.isclose(rep["pairwise_metrics"][0]["ari"], 1.0)


def test_scans(spark, tmp_path):
    p = tmp_path / "semi.csv"
    p.write_text("sample;v\n007;1\n008;NA\n")
    df = tables.read_table(spark, str(p))
    assert [tuple(r) for r in df.orderBy("sample").collect()] == [("007", "1"), ("008", None)]
    assert tables.detect_id_column(df) == "sample"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.foo")
    dup = write_csv(tmp_path / "dup.csv", ["Strain_ID", "a", "b", "c"], [("x", 1, 0, 1), ("x", 0, 1, 1)])
    with pytest.raises(ValueError):
        tables.load_layer(spark, "dup", dup)
    assert cli.main(["--self-check", "--self-check-report", str(tmp_path / "s.json")]) == 0
