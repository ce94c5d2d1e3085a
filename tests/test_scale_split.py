import pytest
from pyspark.sql import functions as F

from tabsmith.operators import scale as N
from tabsmith.operators import split as D


def test_standard_scale_population(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(10)], "x double, c double")
    out, _, st = N.standard_scale(df)
    r = out.agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("c"))).first()
    assert r[0] == pytest.approx(0.0, abs=1e-12)
    assert r[1] == pytest.approx(1.0)
    assert r[2] == 0.0


def test_correlation_selection_chains():
    # b ~ a, c ~ b but not a: both b and c drop (c's partner b is itself dropped)
    pairs = [("a", "b", 0.95), ("a", "c", 0.5), ("b", "c", 0.93)]
    kept, rep = N.correlation_selection(["a", "b", "c"], pairs)
    assert kept == ["a"] and [c for c, _ in rep] == ["b", "c"]
    kept, _ = N.correlation_selection(["a", "b"], [("a", "b", None)])
    assert kept == ["a", "b"]


def test_variance_selection_removes_non_numeric():
    st = {"a": N.Moments(0, 1.0, 0, 1), "k": N.Moments(1, 0.0, 1, 1)}
    kept, rep = N.variance_selection(["a", "k", "s"], {"a", "k"}, st)
    assert kept == ["a"] and {c for c, _, _ in rep} == {"k", "s"}


def test_split_exact_disjoint_and_partition_free(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y string")
    one, _ = D.assign_split(df.repartition(1), ["id"], "y")
    seven, _ = D.assign_split(df.repartition(7), ["id"], "y")
    a = {r["id"]: r["__part"] for r in one.collect()}
    b = {r["id"]: r["__part"] for r in seven.collect()}
    assert a == b and len(a) == 1000
    counts = one.groupBy("y", "__part").count().collect()
    got = {(r["y"], r["__part"]): r["count"] for r in counts}
    assert got[("a", "test")] == D.n_test_stratified(666)
    assert got[("b", "test")] == D.n_test_stratified(334)


def test_split_radix_levels(spark, monkeypatch):
    monkeypatch.setattr(D, "FINAL_BUCKET_ROWS", 5)
    df = spark.createDataFrame([(i,) for i in range(3000)], "id long").cache()
    out, _ = D.assign_split(df, ["id"], None, stratify=False)
    assert out.where(F.col("__part") == "test").count() == D.n_test_random(3000)


def test_split_fallback_on_singleton(spark):
    df = spark.createDataFrame([(i, i if i < 5 else 99) for i in range(50)], "id long, y long")
    out, warn = D.assign_split(df, ["id"], "y")
    assert warn and warn[0].startswith("Stratified split failed")
    assert out.where(F.col("__part") == "test").count() == 10


def test_split_many_classes_uses_smaller_prefix_step(spark):
    # 300 classes (> 256): the radix search switches to two hex characters per level
    rows = [(i, i % 300) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, y long").cache()
    out, warn = D.assign_split(df, ["id"], "y")
    assert not warn
    per_class = {r["y"]: r["count"] for r in out.where(F.col("__part") == "test").groupBy("y").count().collect()}
    assert len(per_class) == 300 and set(per_class.values()) == {D.n_test_stratified(10)}


def test_pairwise_nulls_of_wide_and_narrow_frames(spark, monkeypatch):
    """80 columns with nulls: every pair as by a plain aggregate over the rows that have both."""
    import numpy as np
    monkeypatch.setattr(N, "PAIR_BLOCK", 33)      # several blocks
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 80)) + 1e4
    x[:, 1] = 2 * x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5], x[:, 6] = 3.0, np.nan                 # constant; no value at all
    x[::2, 7], x[1::2, 8] = np.nan, np.nan         # never there together
    cols = [f"c.{i}" for i in range(80)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    st = N.moments(df, cols)
    got = {(a, b): r for a, b, r in N.correlation_pairs(df, cols, st)}
    assert len(got) == 80 * 79 // 2
    for i in range(80):
        for j in range(i + 1, 80):
            a, b = (x[:, k] - (np.nanmean(x[:, k]) if k != 6 else 0) for k in (i, j))
            n = (~np.isnan(a * b)).sum()
            if {i, j} & {5, 6} or not n:
                assert got[(cols[i], cols[j])] is None
            else:
                assert got[(cols[i], cols[j])] == pytest.approx(np.nanmean(a * b) / np.nanstd(x[:, i]) / np.nanstd(x[:, j]), abs=1e-9)
    narrow = {(a, b): r for a, b, r in N.correlation_pairs(df, cols[:3], st)}
    assert all(r == pytest.approx(got[k], abs=1e-9) for k, r in narrow.items())
    assert N.correlation_pairs(df, cols[:1], st) == []
