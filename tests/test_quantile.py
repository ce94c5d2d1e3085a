import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import quantile as Q


def test_exact_quantiles_match_percentile(spark, monkeypatch):
    monkeypatch.setattr(Q, "ACCURACY", 20)       # several rounds on small data
    monkeypatch.setattr(Q, "FINAL_VALUES", 5)
    rng = np.random.default_rng(7)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.34, 5.0, rng.exponential(size=3000))   # a heavy value
    c = rng.integers(0, 4, size=3000).astype(float)                            # few levels
    rows = [(float(x), float(y), float(z) if i % 10 else None) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    probs = [0.25, 0.5, 0.75, 0.9]
    got = Q.exact_quantiles(df, ["a", "b", "c"], probs)
    want = df.agg(*[F.percentile(col, probs).alias(col) for col in ["a", "b", "c"]]).first()
    for col in ["a", "b", "c"]:
        assert got[col] == pytest.approx(list(want[col]), rel=1e-12, abs=1e-12)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "k double, e double")
    got = Q.exact_quantiles(df, ["k", "e"], [0.5])
    assert got == {"k": [1.0], "e": [None]}


def test_bounds_that_miss_cost_a_round_only(spark, monkeypatch):
    """Counts decide: whatever the sketch proposes, the rank is found."""
    monkeypatch.setattr(Q, "FINAL_VALUES", 3)
    df = spark.createDataFrame([(float(i % 50),) for i in range(400)], "a double").cache()
    want = df.agg(F.percentile("a", [0.1, 0.5, 0.99])).first()[0]
    for wrong in ((0.0, 0.0), (49.0, 49.0), (-5.0, 99.0), (10.0, 11.0), (25.5, 30.0)):
        rounds = []

        def propose(df, ranges, wrong=wrong, rounds=rounds):
            rounds.append(len(ranges))
            return [wrong] * len(ranges) if len(rounds) == 1 else right(df, ranges)
        right = Q._proposed
        monkeypatch.setattr(Q, "_proposed", propose)
        got = Q.exact_quantiles(df, ["a"], [0.1, 0.5, 0.99])
        monkeypatch.setattr(Q, "_proposed", right)
        assert got["a"] == pytest.approx(want) and len(rounds) < 20


def test_two_heavy_values_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(Q, "FINAL_VALUES", 5)
    df = spark.createDataFrame([(v,) for v in [1.0] * 500 + [2.0] * 500 + [0.5, 3.0]], "a double").cache()
    assert Q.exact_quantiles(df, ["a"], [0.0, 0.25, 0.5, 0.75, 1.0]) == {"a": [0.5, 1.0, 1.5, 2.0, 3.0]}


def test_profile_and_describe_take_the_one_path(spark, monkeypatch):
    from tabsmith.operators import profile as A
    from tabsmith.plans.profile import profile_table
    monkeypatch.setattr(Q, "FINAL_VALUES", 50)
    df = spark.createDataFrame([(float(i % 97), i, None) for i in range(2000)], "a double, b long, e double").cache()
    prof, rows = profile_table(df), {r["column"]: r for r in A.describe_numeric(df).collect()}
    want = df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in ("a", "b")]).first()
    for c in ("a", "b"):
        st = prof.columns[c]
        assert [st.q1, st.median, st.q3] == pytest.approx(want[c]) == [rows[c]["q25"], rows[c]["q50"], rows[c]["q75"]]
    assert rows["e"]["count"] == 0 and rows["e"]["q50"] is None and prof.columns["e"].median is None


def test_infinities_and_nan_fetch_few_values(spark, monkeypatch):
    """Ranges shrink beside infinities, NaN and widths that overflow; what the driver fetches stays bounded."""
    from pyspark.sql.classic.dataframe import DataFrame
    monkeypatch.setattr(Q, "ACCURACY", 50)
    monkeypatch.setattr(Q, "FINAL_VALUES", 20)
    inf, nan = float("inf"), float("nan")
    base = [float(i * 7919 % 4001) for i in range(2000)]
    odd = {"one": [inf], "both": [-inf] * 3 + [inf], "many": [-inf] * 900 + [inf] * 1200, "nans": [nan] * 5 + [inf], "wide": [1.7e308, -1.7e308],
           "only": [inf] * 4000}
    rows = [tuple(float(x) if x is not None else None for x in r)
            for r in zip(*[(v + (base if k != "only" else []) + [None] * 5000)[:5000] for k, v in odd.items()])]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in odd)).repartition(4).cache()
    probs = [0.001, 0.25, 0.5, 0.75, 0.999]
    want = {k: spark.createDataFrame([(x,) for x in map(lambda r: r[i], rows) if x is not None], "x double").agg(F.percentile("x", probs)).first()[0]
            for i, k in enumerate(odd)}
    fetched, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: fetched.append(collect(self)) or fetched[-1])
    got = Q.exact_quantiles(df, list(odd), probs)
    assert max(map(len, fetched)) <= 20 * 10 * len(odd)
    for k in odd:
        assert got[k] == pytest.approx(want[k], rel=1e-9, nan_ok=True)
    one = Q.exact_quantiles(df, ["one"], [0.5])
    assert one["one"] == pytest.approx([want["one"][2]]) and len(fetched[-1]) <= 40


def test_ranges_of_the_same_values_share_a_sketch(spark, monkeypatch):
    df = spark.range(0, 30_000, numPartitions=4).selectExpr("double(id % 20011 * 1.5) as a", "double(id * 3 % 17001) as b")
    made = []
    real = Q.F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda *a: made.append(1) or real(*a))
    got = Q.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75])
    assert len(made) == 2
    monkeypatch.undo()
    for c in ("a", "b"):
        assert got[c] == df.toPandas()[c].quantile([0.25, 0.5, 0.75]).tolist()


def test_fills_ask_for_quartiles_of_columns_with_nulls_only(spark, monkeypatch):
    from tabsmith.plans.profile import profile_table
    df = spark.range(100).selectExpr("id", "if(id % 5 = 0, null, double(id * 2)) as gaps")
    asked = []
    real = Q.exact_quantiles
    monkeypatch.setattr(Q, "exact_quantiles", lambda d, columns, probs: asked.extend(columns) or real(d, columns, probs))
    prof = profile_table(df, quantiles="missing")
    assert asked == ["gaps"] and prof.columns["id"].q1 is None and prof.columns["gaps"].median == df.toPandas()["gaps"].median()


def test_empty_columns_need_one_count(spark, monkeypatch):
    from tabsmith.plans import catalog
    monkeypatch.setattr(catalog, "_state", lambda *a: pytest.fail("the whole profile was made"))
    assert catalog.q_drop_empty_columns(spark, "/root/testdata/sf0.001").where("action <> 'kept'").count() == 1
