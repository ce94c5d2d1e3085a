"""A sample of registered queries against their DuckDB oracle at sf0.001."""
import math

import duckdb
import pytest

from tests.conftest import SF

KEYS = ["profile_missing", "describe_numeric", "describe_categorical", "dedup_rows", "impute_numeric",
        "impute_categorical", "one_hot_encode", "standard_scale", "correlation_matrix", "correlation_selection",
        "split_stratified", "split_random", "metric_f1", "metric_roc_auc", "classification_report",
        "leaderboard_regression", "feature_importance", "select_tuned", "clf_knn", "clf_gaussian_nb"]


def _canon(df):
    cols = sorted(df.columns)

    def n(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    rows = [tuple(n(r[c]) for c in cols) for r in df.to_dict("records")]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    from tabsmith.sources.fixtures import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    import __spark_entry__ as E
    got = _canon(E.queries()[key](spark, SF).toPandas())
    want = _canon(con.sql(E.oracle_sql()[key]).df())
    assert got == want
