"""Every query with SQL gives DuckDB's rows."""

import pandas as pd
import pytest

from tests.conftest import DATA
from tidewell.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_grid_estimate_is_close(spark):
    exact = registry.queries()["exact_chamfer"](spark, DATA).first()["chamfer"]
    assert abs(registry.queries()["grid_tree_estimate"](spark, DATA).first()["estimate"] / exact - 1) < 0.1


def test_entry_runs(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
