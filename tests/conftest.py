import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from shelfmark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """``evaluate([values], expression)``: results of an expression over rows, in order."""

    def run(values, *exprs):
        rows = [(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values)]
        width = len(rows[0]) - 1
        df = spark.createDataFrame(rows, ["n", *"abcd"[:width]])
        out = df.select("n", *[e.alias(f"x{i}") for i, e in enumerate(exprs)]).orderBy("n").collect()
        return [r[1] if len(exprs) == 1 else tuple(r)[1:] for r in out]

    return run
