"""Streams: bad rows are rejected, every row is in the sinks once, also after a restart."""
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import predict as P
from tabsmith.plans import automl
from tabsmith.streaming import score as ST


def rows(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, F.lit("n/a")).otherwise((F.col("id") % 10).cast("string")).alias("x"),
                                    F.when(F.col("id") % 5 == 0, F.lit("?")).when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.lit("1e3")).alias("z"))


def test_one_scan_checks_all_columns(spark):
    df = rows(spark, 0, 200)
    good, bad = P.validated(df, ["x", "z"], ["k"])
    assert dict(good.dtypes) == {"k": "bigint", "x": "double", "z": "double"}
    assert {r["k"] for r in good.collect()} == {k for k in range(200) if k % 7 and k % 5}
    assert good.where("z IS NULL").count() == sum(1 for k in range(200) if k % 7 and k % 5 and k % 4 == 0)
    want = {(k, "x", "n/a") for k in range(0, 200, 7)} | {(k, "z", "?") for k in range(0, 200, 5)}
    assert {tuple(r) for r in bad.collect()} == want
    assert bad._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bundle"))
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("x"), F.lit(1000.0).alias("z"),
                                 F.when(F.col("id") % 10 > 4, "high").otherwise("low").alias("y"))
    automl.fit(df, "y", ["k"], "fast", only=["KNN"]).save(d, "KNN")
    return d


def test_restart_after_a_batch_cut_short(spark, bundle, tmp_path, monkeypatch):
    src, sink, bad, ck = (str(tmp_path / n) for n in ("src", "sink", "bad", "ck"))
    schema = rows(spark, 0, 1).schema
    go = lambda: ST.score_stream(spark, bundle, src, sink, schema, ck, "k", ["x", "z"], bad)
    rows(spark, 0, 100).write.parquet(src)
    go()
    rows(spark, 100, 180).write.mode("append").parquet(src)
    whole = ST.score_batch

    def cut(batch, number, *rest):
        whole(batch, number, *rest)      # both sinks are written, the commit of the batch is not
        raise RuntimeError("lost")
    monkeypatch.setattr(ST, "score_batch", cut)
    with pytest.raises(Exception, match="lost"):
        go()
    monkeypatch.setattr(ST, "score_batch", whole)
    out = go().collect()
    good = {k for k in range(180) if k % 7 and k % 5}
    assert sorted(r["k"] for r in out) == sorted(good)
    assert all(r["prediction"] == float(r["k"] % 10 <= 4) for r in out)
    rejects = [tuple(r) for r in ST.rejected(spark, bad, "k").collect()]
    assert len(rejects) == len(set(rejects)) and set(rejects) == {(k, "x", "n/a") for k in range(0, 180, 7)} | {(k, "z", "?") for k in range(0, 180, 5)}
    assert sorted(r["k"] for r in go().collect()) == sorted(good)      # nothing new, nothing twice


def test_no_batches(spark, bundle, tmp_path):
    src = str(tmp_path / "src")
    rows(spark, 0, 0).write.parquet(src)
    out = ST.score_stream(spark, bundle, src, str(tmp_path / "s"), rows(spark, 0, 1).schema, str(tmp_path / "c"), "k", ["x"], str(tmp_path / "b"))
    assert out.count() == 0 and ST.rejected(spark, str(tmp_path / "b"), "k").count() == 0
    with pytest.raises(ValueError):
        ST.score_stream(spark, bundle, src, "s", rows(spark, 0, 1).schema, "c", "k", ["x"])
