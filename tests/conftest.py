import numpy as np
import pandas as pd
import pytest

from chronolink.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "6g")


@pytest.fixture(scope="session")
def network(spark):
    """Five variables, X0 -> X1 -> X2 and X0 -> X3 -> X4, all at lag 1."""
    rng = np.random.default_rng(0)
    x = np.zeros((600, 5))
    for t in range(1, 600):
        e = rng.normal(size=5)
        x[t] = [0.5 * x[t - 1, 0] + e[0], 0.7 * x[t - 1, 0] + e[1], 0.7 * x[t - 1, 1] + e[2], 0.7 * x[t - 1, 0] + e[3], 0.7 * x[t - 1, 3] + e[4]]
    pdf = pd.DataFrame(x, columns=[f"X{i}" for i in range(5)])
    pdf.insert(0, "t_idx", range(600))
    pdf.insert(0, "unit_id", "all")
    return spark.createDataFrame(pdf)


TRUE = {("X0", "X1"), ("X1", "X2"), ("X0", "X3"), ("X3", "X4")}


@pytest.fixture(scope="session")
def true_edges():
    return TRUE
