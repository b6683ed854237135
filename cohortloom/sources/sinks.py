"""Result sinks and provenance files."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import platform
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_csv(df: DataFrame, path: str) -> None:
    """CSV folder with a header, floating columns rounded to 6 places."""
    cols = [
        F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def save_parquet(df: DataFrame, path: str) -> None:
    """Matrix segments and other wide results."""
    df.write.mode("overwrite").parquet(path)


def _plain(o: Any) -> Any:
    if dataclasses.is_dataclass(o):
        return dataclasses.asdict(o)
    if isinstance(o, Path):
        return str(o)
    if hasattr(o, "asDict"):
        return o.asDict()
    if hasattr(o, "item"):
        return o.item()
    return str(o)


def save_json(data: Any, path: str | Path) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, default=_plain))
    return str(path)


def sha256_file(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def file_record(path: str | Path) -> dict:
    p = Path(path)
    if not p.is_file():
        return {"path": str(p), "exists": False}
    return {"path": str(p), "sha256": sha256_file(p), "size_bytes": p.stat().st_size}


def run_manifest(tool: str, version: str, inputs: dict[str, str], config: Any, output_dir: str, **extra) -> dict:
    import numpy
    import pandas
    import pyspark

    return {
        "tool_name": tool,
        "tool_version": version,
        "python": sys.version.split()[0],
        "platform": platform.platform(),
        "package_versions": {"numpy": numpy.__version__, "pandas": pandas.__version__, "pyspark": pyspark.__version__},
        "output_dir": str(output_dir),
        "config_snapshot": config,
        "input_files": {k: file_record(p) for k, p in inputs.items()},
        **extra,
    }
