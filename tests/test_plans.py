"""Pass-count checks on physical plans: one scan per fused operator, filters
and column pruning reach the Parquet reader."""
from tabsmith.operators import evaluate as V
from tabsmith.operators import profile as A
from tabsmith.sources import fixtures as X
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fused_profiles_scan_once(spark):
    li = X.table(spark, SF, "lineitem")
    for df in [A.profile_missing(li), A.describe_numeric(li, exact=False), A.profile_bytes(li)]:
        assert _plan(df).count("FileScan parquet") == 1
    plan = _plan(A.describe_categorical(li))
    assert plan.count("FileScan parquet") == 1
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string" in plan  # pruned to the two strings


def test_metrics_from_one_prediction_scan(spark):
    p = X.fixed_predictions(spark, SF, "binary")
    # three rule models: each reads orders once; exchanges: confusion counts,
    # per-class counts, per-model sums (the last two on a few rows)
    plan = _plan(V.classification_metrics(p))
    assert plan.count("FileScan parquet") == 3 and plan.count("Exchange hashpartitioning") == 3


def test_sample_fraction_is_narrow(spark):
    from tabsmith.sources.readers import sample_fraction
    plan = _plan(sample_fraction(X.table(spark, SF, "orders"), ["o_orderkey"], 20))
    assert "Exchange" not in plan


def test_correlations_from_one_scan_without_a_shuffle_of_rows(spark):
    from tabsmith.operators import scale as N
    li = X.table(spark, SF, "lineitem").select("l_quantity", "l_discount", "l_tax")
    seen = []
    plan = type(li).mapInArrow

    def kept(self, *a, **k):
        seen.append(_plan(self))
        return plan(self, *a, **k)
    try:
        type(li).mapInArrow = kept
        N.correlation_pairs(li, li.columns, N.moments(li, li.columns))
    finally:
        type(li).mapInArrow = plan
    assert len(seen) == 1 and "Exchange" not in seen[0] and seen[0].count("FileScan parquet") == 1
