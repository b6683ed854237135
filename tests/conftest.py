import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cohortloom.session import get_spark

    s = get_spark("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    return s


def planted(n_per=50, groups=3, per=4, signal=0.85, noise=0.08, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n_per * groups, per * groups))
    p = np.full(x.shape, noise)
    for g in range(groups):
        p[g * n_per : (g + 1) * n_per, g * per : (g + 1) * per] = signal
    return (x < p).astype(int), np.repeat(np.arange(groups), n_per)


def rows_frame(spark, x, labels=None):
    data = [(f"S{i:04d}", [int(v) for v in r]) + ((int(labels[i]),) if labels is not None else ()) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id string, x array<tinyint>" + (", label int" if labels is not None else ""))


def same_partition(a, b):
    """Equal up to renaming of labels."""
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))
