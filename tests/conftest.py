import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hirelens.session import checkpoint_dir, get_session
    s = get_session("local[4]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="hirelens-test-")})
    checkpoint_dir(s)
    yield s
    s.stop()


def one_col(spark, values, expr_fn, name="x"):
    """Evaluate ``expr_fn(col)`` over a single-column table of strings, in order."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    rows = df.select("i", expr_fn(F.col(name)).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]
