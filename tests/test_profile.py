from tabsmith.operators import profile as A
from tabsmith.plans import automl
from tabsmith.plans.profile import categorical_columns, numeric_columns, profile_table


def test_kinds_by_type(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True, [1.0])], "i int, d double, s string, b boolean, v array<double>")
    assert numeric_columns(df) == ["i", "d"]
    assert categorical_columns(df) == ["s", "b"]          # arrays are not features
    kinds = {r["column"]: r["kind"] for r in A.profile_types(df).collect()}
    assert kinds == {"i": "numeric", "d": "numeric", "s": "categorical", "b": "categorical", "v": "other"}


def test_nan_counts_as_missing(spark):
    from tabsmith.functions.expr import nan_to_null
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double"))
    assert {r["column"]: r["missing"] for r in A.profile_missing(df).collect()} == {"x": 2}
    p = profile_table(df)
    assert p.columns["x"].nulls == 2 and p.columns["x"].mean == 1.0


def test_duplicates_count_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "x int, y string")
    assert A.profile_duplicates(df).first()[0] == 3


def test_metric_lists_per_problem_type():
    assert automl.METRIC_OPTIONS["classification"] == ["Accuracy", "Precision", "Recall", "F1 Score", "ROC-AUC"]
    assert automl.PRIMARY_METRIC == {"classification": "Accuracy", "regression": "R2"}
    assert automl.LEADERBOARD_METRICS["regression"] == ["R2", "RMSE"]


def test_levels_are_exact_at_any_count(spark, monkeypatch):
    """3,000 levels are counted as 3,000; few levels are listed; long values go by their digest."""
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame
    from tabsmith.operators import encode as E
    from tabsmith.plans.profile import KEPT_LEVELS
    long = [f"{'x' * 100}{i}" for i in range(3)]
    df = spark.range(9000).select(
        F.concat(F.lit("v"), F.col("id") % 3000).alias("many"), F.concat(F.lit("w"), F.col("id") % 3000, F.lit("y" * 90)).alias("wide"),
        F.element_at(F.array(*[F.lit(v) for v in long]), (F.col("id") % 3 + 1).cast("int")).alias("long"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") < 5, F.lit("b")).when(F.col("id") < 10, F.lit("a")).otherwise(F.concat(F.lit("z"), F.col("id") % 4000)).alias("tied")).cache()
    fetched, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: fetched.append(collect(self)) or fetched[-1])
    prof = profile_table(df)
    assert max(map(len, fetched)) <= KEPT_LEVELS * 5
    got = {c: prof.columns[c].distinct for c in prof.order}
    want = df.agg(*[F.count_distinct(c).alias(c) for c in prof.order]).first().asDict()
    assert got == want and got["many"] == 3000
    assert prof.columns["long"].levels == sorted(long) and prof.columns["flag"].levels == ["false", "true"]
    assert prof.columns["many"].levels is None and prof.columns["flag"].mode == "false"
    assert prof.columns["tied"].mode == "a" and prof.columns["tied"].mode_count == 5      # five each: the smallest
    assert ("many", 3000, "leftover") in E.encoding_plan(prof, prof.order) and ("long", 3, "one_hot") in E.encoding_plan(prof, prof.order)


def test_mode_of_long_values(spark):
    from tabsmith.operators import impute as M
    v = ["p" * 80 + c for c in "cab"]
    df = spark.createDataFrame([(v[0],)] * 3 + [(v[1],)] * 3 + [(v[2],), (None,)], "t string")
    assert M.categorical_fill_plan(profile_table(df), None, df) == {"t": (v[1], "Mode")}
