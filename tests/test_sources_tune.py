import os
import tempfile

import pytest

from tabsmith.operators import tune as G
from tabsmith.sources import readers as S


def test_csv_round_trip_and_formats(spark):
    d = tempfile.mkdtemp(prefix="t-csv-", dir="/tmp")
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "x int, y double, z string")
    df.coalesce(1).write.option("header", True).csv(os.path.join(d, "t.csv"))
    back = S.load_table(spark, os.path.join(d, "t.csv"))
    assert back.count() == 2 and set(back.columns) == {"x", "y", "z"}
    with pytest.raises(S.UnsupportedFormatError):
        S.load_table(spark, "/tmp/x.xlsx")


def test_grid_sizes_match_reference():
    cls = [G.grid_size(g) for g in G.CLASSIFICATION_GRIDS.values()]
    reg = [G.grid_size(g) for g in G.REGRESSION_GRIDS.values()]
    assert cls == [16, 72, 48, 16, 12, 3, 8, 72, 24]
    assert reg == [2, 108, 24, 16, 12, 8, 72, 36]


def test_random_settings_repeatable():
    g = G.CLASSIFICATION_GRIDS["XGBoost"]
    assert G.random_settings(g) == G.random_settings(g)
    assert len(G.random_settings(g)) == 5
    with pytest.raises(ValueError):
        G.tune_model(None, g, None, "classification", "bayes")


def test_sample_exact_n_is_the_n_smallest_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tabsmith.functions.expr import hash_hex
    from tabsmith.operators import split as D
    monkeypatch.setattr(D, "FINAL_BUCKET_ROWS", 20)   # force several radix levels
    df = spark.range(5000).withColumnRenamed("id", "k").cache()
    got = {r["k"] for r in S.sample_exact_n(df, ["k"], 777).collect()}
    want = {r["k"] for r in df.orderBy(hash_hex("k", seed=42)).limit(777).collect()}
    assert got == want
    assert S.sample_exact_n(df, ["k"], 10_000).count() == 5000
    frac = S.sample_fraction(df, ["k"], 20).count()
    assert 800 < frac < 1200
