import pytest
from pyspark.sql import functions as F

from tabsmith.operators import clean as C
from tabsmith.operators import encode as E
from tabsmith.operators import impute as M
from tabsmith.plans.profile import profile_table


def test_clean_names_and_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`  A  b `: int, `c\tD`: int")
    assert C.clean_column_names(df).columns == ["a_b", "c_d"]
    bad = spark.createDataFrame([(1, 2)], "`A b`: int, `a  b`: int")
    with pytest.raises(C.ColumnNameCollision):
        C.clean_column_names(bad)


def test_dedup_and_empty_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, None)], "x int, y string")
    d = C.remove_duplicate_rows(df)
    assert d.count() == 3
    assert C.remove_empty_rows(d).count() == 2


def test_cardinality_boundary_is_strict(spark):
    # 3 distinct of 20 rows = 0.15 exactly: kept; 4 of 20 = 0.2: dropped
    rows = [(f"v{i % 3}", f"w{i % 4}") for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string")
    prof = profile_table(df)
    assert C.high_cardinality_columns(prof, skip=[]) == ["b"]


def test_decisions_protect_target_and_ids(spark):
    df = spark.createDataFrame([(i, None, f"n{i}", "y" if i % 2 else "n") for i in range(10)],
                               "id int, empty string, note string, target string")
    prof = profile_table(df)
    dec = dict(C.cleaning_decisions(prof, ["target"]))
    assert dec["empty"].startswith("Removed (Empty")
    assert dec["id"].startswith("Removed (Identifier")
    assert dec["note"].startswith("Removed (Unique")
    assert "target" not in dec


def test_outliers_choose_median_else_mean(spark):
    rows = [(float(v), float(v)) for v in range(1, 11)] + [(1000.0, 5.0), (None, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    prof = profile_table(df)
    plan = M.numeric_fill_plan(prof)
    assert plan["a"][1] == M.MEDIAN_TEXT and plan["a"][0] == pytest.approx(6.0)
    assert plan["b"][1] == M.MEAN_TEXT and plan["b"][0] == pytest.approx(60 / 11)
    filled = M.apply_fills(df, plan, prof)
    assert filled.where(F.col("a").isNull()).count() == 0


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    prof = profile_table(df)
    assert M.categorical_fill_plan(prof)["c"][0] == "a"


def test_encoding_levels(spark):
    rows = [(f"x{i % 2}", f"y{i % 3}", f"z{i % 10}", f"w{i % 11}") for i in range(110)]
    df = spark.createDataFrame(rows, "two string, three string, ten string, eleven string")
    prof = profile_table(df)
    plan = {c: m for c, _, m in E.encoding_plan(prof, df.columns)}
    assert plan == {"two": "label", "three": "one_hot", "ten": "one_hot", "eleven": "leftover"}
    enc = E.apply_encoding(df, prof, E.encoding_plan(prof, df.columns))
    assert "three_y0" not in enc.columns and "three_y1" in enc.columns
    total = enc.select(sum(F.col(c) for c in ["three_y1", "three_y2"]).alias("s")).agg(F.max("s")).first()[0]
    assert total <= 1
    assert sorted(r[0] for r in enc.select("two").distinct().collect()) == [0, 1]


def test_problem_type_boundary(spark):
    twenty = spark.createDataFrame([(float(i % 20),) for i in range(100)], "y double")
    twenty_one = spark.createDataFrame([(float(i % 21),) for i in range(100)], "y double")
    assert E.infer_problem_type(twenty, "y") == "classification"
    assert E.infer_problem_type(twenty_one, "y") == "regression"
