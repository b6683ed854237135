"""Command line: full run, preflight, consistency, self-check, benchmark."""

from __future__ import annotations

import argparse
import json
import sys

from cohortloom import __version__


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cohortloom", description="Consensus clustering of binary trait layers on Spark")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--config", help="YAML run configuration")
    p.add_argument("--self-check", action="store_true")
    p.add_argument("--self-check-report")
    p.add_argument("--benchmark", action="store_true")
    p.add_argument("--benchmark-report")
    p.add_argument("--reliability-config")
    p.add_argument("--reliability-only", action="store_true")
    p.add_argument("--reliability-outdir")
    p.add_argument("--consistency-spec")
    p.add_argument("--consistency-out")
    p.add_argument("--dataset", action="append", default=[], metavar="NAME=PATH", help="ad-hoc preflight dataset")
    p.add_argument("--id-col", action="append", default=[], metavar="NAME=COLUMN")
    p.add_argument("--reference-layer")
    p.add_argument("--min-samples", type=int)
    p.add_argument("--run-sensitivity", action="store_true")
    p.add_argument("--tool-name", default="cohortloom")
    p.add_argument("--tool-version", default=__version__)
    return p


def _mapping(items: list[str]) -> dict[str, str]:
    out = {}
    for item in items:
        name, sep, value = item.partition("=")
        if not sep or not name or not value:
            raise SystemExit(f"expected NAME=VALUE, got {item!r}")
        out[name] = value
    return out


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    from cohortloom.session import get_spark
    from cohortloom.sources import sinks

    if a.self_check:
        from cohortloom.selfcheck import run_self_check

        report = run_self_check(a.self_check_report)
        print(json.dumps(report, indent=2))
        return 0 if report["status"] == "PASS" else 1
    if a.benchmark:
        from cohortloom.plans import workload

        report = workload.run(get_spark())
        if a.benchmark_report:
            sinks.save_json(report, a.benchmark_report)
        print(json.dumps(report, indent=2))
        return 0
    from cohortloom.plans import preflight

    if a.consistency_spec:
        report = preflight.consistency_from_spec(get_spark(), a.consistency_spec, a.consistency_out)
        return 0 if report["status"] in ("PASS", "WARN") else 1
    settings = preflight.load_settings(a.reliability_config)
    if a.min_samples is not None:
        settings["min_samples"] = a.min_samples
    if a.run_sensitivity:
        settings["sensitivity"] = {**(settings.get("sensitivity") or {}), "enabled": True}
    if a.dataset:
        gate = preflight.run_preflight(
            get_spark(), _mapping(a.dataset), a.reliability_outdir or "reliability", settings, _mapping(a.id_col),
            a.tool_name, a.tool_version, a.reference_layer,
        )
        return 0 if gate["status"] in ("PASS", "WARN") else 1
    if not a.config:
        build_parser().print_help()
        return 2
    from cohortloom.config import Config
    from cohortloom.plans.pipeline import Pipeline

    cfg = Config.from_yaml(a.config)
    sinks.save_json(cfg.validation, f"{cfg.output_dir}/config_validation.json")
    spark = get_spark()
    if a.reliability_only or a.reliability_config:
        gate = preflight.preflight_for_config(spark, cfg, settings, a.reliability_outdir)
        if a.reliability_only:
            return 0 if gate["status"] in ("PASS", "WARN") else 1
    Pipeline(cfg, spark).run()
    return 0


if __name__ == "__main__":
    sys.exit(main())
