"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory. Inputs are the driver tables or the fixtures
Spark derives from them (``tabsmith.sources.fixtures``). Doubles are
rounded to 6 places so results compare across engines.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabsmith.functions.expr import nan_to_null
from tabsmith.operators import clean as C
from tabsmith.operators.classes import class_dictionary, labelled
from tabsmith.operators import compare as L
from tabsmith.operators import encode as E
from tabsmith.operators import evaluate as V
from tabsmith.operators import impute as M
from tabsmith.operators import profile as A
from tabsmith.operators import scale as N
from tabsmith.operators import split as D
from tabsmith.plans.profile import profile_table, q
from tabsmith.sources import fixtures as X
from tabsmith.sources import readers as S


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles; adding 0.0 turns -0.0 into 0.0."""
    return df.select(*[(F.round(q(f.name), places) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else q(f.name)
                       for f in df.schema.fields])


def _rows(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sources ---

def q_load_table(spark, sf):
    return S.load_table(spark, f"{sf}/customer.parquet")


def q_load_json(spark, sf):
    ev = S.load_table(spark, f"{sf}/events.parquet")
    return S.json_records(ev.select("event_id", "props"), "props").select("event_id", "k")


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def q_sample_exact_n(spark, sf):
    o = X.table(spark, sf, "orders").select(*_ORDER_COLS)
    return S.sample_exact_n(o, ["o_orderkey"], S.REFERENCE_ROW_CAP)


def q_sample_fraction(spark, sf):
    o = X.table(spark, sf, "orders").select(*_ORDER_COLS)
    return S.sample_fraction(o, ["o_orderkey"], 20)


# -------------------------------------------------------------- profiling ---

def _dirty(spark, sf) -> DataFrame:
    return nan_to_null(C.clean_column_names(X.dirty_orders(spark, sf)))


def q_profile_shape(spark, sf):
    return A.profile_shape(_dirty(spark, sf))


def q_profile_types(spark, sf):
    return A.profile_types(_dirty(spark, sf))


def q_profile_missing(spark, sf):
    return A.profile_missing(_dirty(spark, sf)).withColumnRenamed("column", "col_name")


def q_profile_missing_total(spark, sf):
    return A.profile_missing_total(_dirty(spark, sf))


def q_profile_duplicates(spark, sf):
    return A.profile_duplicates(_dirty(spark, sf))


def q_profile_bytes(spark, sf):
    return A.profile_bytes(_dirty(spark, sf)).withColumnRenamed("column", "col_name")


def q_profile_preview(spark, sf):
    return A.profile_preview(X.table(spark, sf, "customer"), ["c_custkey"])


def q_describe_numeric(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return rounded(A.describe_numeric(li).withColumnRenamed("column", "col_name"))


def q_describe_categorical(spark, sf):
    # freq is null for the empty column: shown as double (see q_dedup_rows)
    return A.describe_categorical(_dirty(spark, sf)).withColumnRenamed("column", "col_name") \
        .withColumn("freq", F.col("freq").cast("double"))


# --------------------------------------------------------------- cleaning ---

MESSY_NAMES = {"c_custkey": "  Cust Key ", "c_name": "Customer   Name", "c_nationkey": "NATION\tKey",
               "c_acctbal": "Acct Bal", "c_mktsegment": " MKT Segment"}


def q_clean_names(spark, sf):
    cu = X.table(spark, sf, "customer")
    messy = cu.select(*[F.col(c).alias(n) for c, n in MESSY_NAMES.items()])
    return C.clean_column_names(messy)


def q_dedup_rows(spark, sf):
    # the one all-null row keeps a null id: shown as double, so both engines
    # hand the same (float) column to the comparison
    d = C.remove_duplicate_rows(_dirty(spark, sf))
    return d.withColumn("id", F.col("id").cast("double"))


def _nonempty(spark, sf) -> DataFrame:
    return C.remove_empty_rows(C.remove_duplicate_rows(_dirty(spark, sf)))


def q_drop_empty_rows(spark, sf):
    return _nonempty(spark, sf)


@lru_cache(maxsize=8)
def _state(spark: SparkSession, sf: str):
    """Decisions of the cleaning / imputing / encoding chain on dirty_orders,
    target protected, ``id`` carried as the row key. The deduplicated frame is
    cached: every key derived from it would repeat the shuffle."""
    df = _nonempty(spark, sf).persist()
    prof = profile_table(df, quantiles="missing")
    protect = ["target"]
    dropped = C.cleaning_decisions(prof, protect)
    gone = {c for c, _ in dropped}
    feats = [c for c in df.columns if c not in gone and c != "target"]
    nfill = M.numeric_fill_plan(prof, [c for c in feats if prof.columns[c].kind == "numeric"])
    cfill = M.categorical_fill_plan(prof, [c for c in feats if prof.columns[c].kind == "categorical"], df)
    enc = E.encoding_plan(prof, feats)
    return df, prof, dropped, feats, nfill, cfill, enc


def q_drop_empty_columns(spark, sf):
    """C4: one aggregate, for null counts are all that it asks of the profile."""
    prof = profile_table(_nonempty(spark, sf), quantiles=False, value_counts=False)
    rows = [(c, prof.columns[c].non_null,
             "Removed (Empty column)" if c in C.empty_columns(prof) else "kept") for c in prof.order]
    return _rows(spark, rows, "col_name string, non_null bigint, action string")


def q_drop_id_columns(spark, sf):
    df = _nonempty(spark, sf)
    return C.drop_columns(df, C.id_columns(df.columns))


def q_drop_high_cardinality(spark, sf):
    df, prof, dropped, *_ = _state(spark, sf)
    gone = {c for c, a in dropped if not a.startswith("Removed (Unique")}
    rows = []
    for c in prof.categorical():
        if c in gone or c == "target":
            continue
        st = prof.columns[c]
        ratio = st.distinct / prof.rows
        act = "Removed (Unique ratio > 0.15)" if ratio > C.CARDINALITY_THRESHOLD else "kept"
        rows.append((c, st.distinct, round(ratio, 6), act))
    return _rows(spark, rows, "col_name string, n_distinct bigint, ratio double, action string")


# ---------------------------------------------------------------- missing ---

def q_missing_columns(spark, sf):
    df, prof, dropped, feats, *_ = _state(spark, sf)
    rows = [(c, "numeric") for c in M.numerical_missing_columns(prof, feats)]
    rows += [(c, "categorical") for c in M.categorical_missing_columns(prof, feats)]
    return _rows(spark, rows, "col_name string, kind string")


def _outlier_checks(spark, sf):
    df, prof, dropped, feats, *_ = _state(spark, sf)
    return df, [M.detect_outliers(prof, c) for c in M.numerical_missing_columns(prof, feats)]


def q_iqr_outlier_flags(spark, sf):
    df, checks = _outlier_checks(spark, sf)
    rows = [(c.column, c.q1, c.q3, c.lower, c.upper, c.has_outliers) for c in checks]
    return rounded(_rows(spark, rows, "col_name string, q1 double, q3 double, lower double, "
                                      "upper double, has_outliers boolean"))


def q_iqr_outlier_rows(spark, sf):
    df, checks = _outlier_checks(spark, sf)
    return M.outlier_row_counts(df, checks).withColumnRenamed("column", "col_name")


def _filled(spark, sf):
    df, prof, dropped, feats, nfill, cfill, enc = _state(spark, sf)
    return M.apply_fills(df.select("id", *feats), {**nfill, **cfill}, prof), prof


def q_impute_numeric(spark, sf):
    f, prof = _filled(spark, sf)
    return rounded(f.select("id", *[c for c in f.columns if c != "id" and prof.columns[c].kind == "numeric"]))


def q_impute_categorical(spark, sf):
    f, prof = _filled(spark, sf)
    return f.select("id", *[c for c in f.columns if c != "id" and prof.columns[c].kind == "categorical"])


def q_impute_report(spark, sf):
    df, prof, dropped, feats, nfill, cfill, enc = _state(spark, sf)
    return _rows(spark, M.missing_value_report(nfill, cfill), "col_name string, method string")


# --------------------------------------------------------------- encoding ---

def q_encoding_plan(spark, sf):
    df, prof, dropped, feats, nfill, cfill, enc = _state(spark, sf)
    return _rows(spark, [(c, n, m) for c, n, m in enc], "col_name string, levels bigint, method string")


def _encoded(spark, sf):
    f, prof = _filled(spark, sf)
    enc = _state(spark, sf)[6]
    return E.apply_encoding(f, prof, enc), enc


def q_label_encode(spark, sf):
    e, enc = _encoded(spark, sf)
    return e.select("id", *[c for c, _, m in enc if m == "label"])


def q_one_hot_encode(spark, sf):
    e, enc = _encoded(spark, sf)
    hot = [c for c, _, m in enc if m == "one_hot"]
    return e.select("id", *[c for c in e.columns if any(c.startswith(h + "_") for h in hot)])


def q_encoding_report(spark, sf):
    enc = _state(spark, sf)[6]
    return _rows(spark, E.encoding_report(enc), "col_name string, method string")


def q_split_xy(spark, sf):
    df = _nonempty(spark, sf)
    feats, y = E.split_xy(df, "target", ["id"])
    return labelled(df, y, class_dictionary(df, y)).select("id", "label")


def q_infer_problem_type(spark, sf):
    docs = X.labelled_docs(spark, sf)
    li = X.table(spark, sf, "lineitem")
    cases = [("dirty_orders", _nonempty(spark, sf), "target"), ("labelled_docs", docs, "quality"),
             ("labelled_docs", docs, "n_chars"), ("lineitem", li, "l_linenumber"),
             ("lineitem", li, "l_quantity")]
    rows = [(name, t, E.infer_problem_type(d, t)) for name, d, t in cases]
    return _rows(spark, rows, "dataset string, target string, problem_type string")


# ---------------------------------------------------- scaling / selection ---

def _numeric_encoded(spark, sf):
    e, enc = _encoded(spark, sf)
    prof = _state(spark, sf)[1]
    from tabsmith.plans.profile import numeric_columns
    nums = [c for c in numeric_columns(e) if c != "id"]
    return e, nums


def q_standard_scale(spark, sf):
    e, nums = _numeric_encoded(spark, sf)
    scaled, _, _ = N.standard_scale(e.select("id", *nums), nums)
    return rounded(scaled)


def q_min_max_scale(spark, sf):
    e, nums = _numeric_encoded(spark, sf)
    scaled, _, _ = N.min_max_scale(e.select("id", *nums), nums)
    return rounded(scaled)


@lru_cache(maxsize=8)
def _selection(spark, sf):
    e, nums = _numeric_encoded(spark, sf)
    feats = [c for c in e.columns if c != "id"]
    stats = N.moments(e, nums)
    kept, vrep = N.variance_selection(feats, set(nums), stats)
    pairs = N.correlation_pairs(e, kept, stats)
    sel, crep = N.correlation_selection(kept, pairs)
    return feats, stats, kept, vrep, pairs, sel, crep


def q_variance_selection(spark, sf):
    feats, stats, kept, vrep, *_ = _selection(spark, sf)
    rows = [(c, v, t) for c, v, t in vrep] + [(c, N.scaled_variance(stats[c]), "kept") for c in kept]
    return rounded(_rows(spark, rows, "col_name string, variance double, action string"))


def q_correlation_matrix(spark, sf):
    pairs = _selection(spark, sf)[4]
    return rounded(_rows(spark, [(a, b, None if r is None else abs(r)) for a, b, r in pairs],
                         "col_i string, col_j string, abs_corr double"))


def q_correlation_selection(spark, sf):
    feats, stats, kept, vrep, pairs, sel, crep = _selection(spark, sf)
    rows = crep + [(c, "kept") for c in sel]
    return _rows(spark, rows, "col_name string, action string")


def q_feature_report(spark, sf):
    feats, stats, kept, vrep, pairs, sel, crep = _selection(spark, sf)
    return _rows(spark, N.feature_selection_report(vrep, crep), "col_name string, action string")


# ------------------------------------------------------------------ split ---

def q_split_stratified(spark, sf):
    df = _nonempty(spark, sf).select("id", "target").cache()
    out, _ = D.assign_split(df, ["id"], "target", stratify=True)
    return out.select("id", F.col("__part").alias("part"))


def q_split_random(spark, sf):
    docs = X.labelled_docs(spark, sf).select("doc_id").cache()
    out, _ = D.assign_split(docs, ["doc_id"], None, stratify=False)
    return out.select("doc_id", F.col("__part").alias("part"))


def q_split_fallback(spark, sf):
    docs = X.labelled_docs(spark, sf).select("doc_id", "n_chars").cache()
    out, warn = D.assign_split(docs, ["doc_id"], "n_chars", stratify=True)
    return out.select("doc_id", F.col("__part").alias("part"),
                      F.lit(len(warn) > 0).alias("fell_back"))


def q_split_report(spark, sf):
    df = _nonempty(spark, sf).select("id", "target").cache()
    out, _ = D.assign_split(df, ["id"], "target", stratify=True)
    return D.split_report(out)


# ------------------------------------------------------------- evaluation ---

def _preds(spark, sf, kind):
    return X.fixed_predictions(spark, sf, kind)


def _both_kinds(spark, sf, fn):
    b = fn(_preds(spark, sf, "binary")).withColumn("kind", F.lit("binary"))
    m = fn(_preds(spark, sf, "multiclass")).withColumn("kind", F.lit("multiclass"))
    return rounded(b.unionByName(m))


def _metric(name):
    def run(spark, sf):
        return _both_kinds(spark, sf, lambda p: V.classification_metrics(p).select(
            "model", F.col(name).alias("value")))
    return run


q_metric_accuracy = _metric("accuracy")
q_metric_precision = _metric("precision")
q_metric_recall = _metric("recall")
q_metric_f1 = _metric("f1")


def q_metric_roc_auc(spark, sf):
    return _both_kinds(spark, sf, V.roc_auc)


def q_confusion_matrix(spark, sf):
    return _both_kinds(spark, sf, V.confusion_matrix)


def q_classification_report(spark, sf):
    return _both_kinds(spark, sf, V.classification_report)


def q_metric_mae_mse_rmse(spark, sf):
    return rounded(V.regression_metrics(_preds(spark, sf, "regression")).select("model", "mae", "mse", "rmse"))


def q_metric_r2(spark, sf):
    return rounded(V.regression_metrics(_preds(spark, sf, "regression")).select("model", "r2"))


def q_evaluation_long(spark, sf):
    return rounded(V.evaluation_long(_preds(spark, sf, "binary")))


# ------------------------------------------------------------- comparison ---

def _cls_board(spark, sf):
    return L.leaderboard_classification(_preds(spark, sf, "binary"))


def _reg_board(spark, sf):
    return L.leaderboard_regression(_preds(spark, sf, "regression"))


def q_leaderboard_classification(spark, sf):
    return rounded(_cls_board(spark, sf))


def q_leaderboard_regression(spark, sf):
    return rounded(_reg_board(spark, sf))


def _two_boards(spark, sf, fn):
    a = fn(_cls_board(spark, sf)).select("model", "rank").withColumn("kind", F.lit("classification"))
    b = fn(_reg_board(spark, sf)).select("model", "rank").withColumn("kind", F.lit("regression"))
    return a.unionByName(b)


def q_top_models(spark, sf):
    return _two_boards(spark, sf, L.top_models)


def q_best_model(spark, sf):
    return _two_boards(spark, sf, L.best_model)


def q_leaderboard_by_metric(spark, sf):
    a = L.leaderboard_by_metric(_cls_board(spark, sf), ["accuracy", "precision", "recall", "f1", "roc_auc"])
    b = L.leaderboard_by_metric(_reg_board(spark, sf), ["r2", "rmse", "mae", "mse"])
    return rounded(a.withColumn("kind", F.lit("classification"))
                   .unionByName(b.withColumn("kind", F.lit("regression"))))


def q_score_distribution(spark, sf):
    a = L.score_distribution(_cls_board(spark, sf), "accuracy", True).withColumn("kind", F.lit("classification"))
    b = L.score_distribution(_reg_board(spark, sf), "r2", False).withColumn("kind", F.lit("regression"))
    return rounded(a.unionByName(b))


def q_leaderboard_display(spark, sf):
    a = L.leaderboard_display(_cls_board(spark, sf), ["accuracy", "f1", "roc_auc"], True)
    b = L.leaderboard_display(_reg_board(spark, sf), ["r2", "rmse"], False)
    la = a.select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("display"))
                                              for m in ["accuracy", "f1", "roc_auc"]])))
    lb = b.select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("display"))
                                              for m in ["r2", "rmse"]])))
    return la.unionByName(lb)


def q_feature_importance(spark, sf):
    return rounded(L.feature_importance(X.importance_input(spark, sf)))


def q_importance_highlights(spark, sf):
    imp = L.feature_importance(X.importance_input(spark, sf))
    return rounded(L.importance_highlights(imp, L.best_model(_cls_board(spark, sf))))


def q_select_tuned(spark, sf):
    orig = _cls_board(spark, sf)
    tuned = L.leaderboard_classification(_preds(spark, sf, "tuned"))
    return rounded(L.select_tuned(orig, tuned, "accuracy"))


# ---------------------------------------------------------------- predict ---

def q_reject_non_numeric(spark, sf):
    from tabsmith.operators.predict import reject_non_numeric
    o = X.table(spark, sf, "orders")
    inp = o.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority "
                                        "ELSE CAST(o_totalprice AS STRING) END").alias("x"))
    return reject_non_numeric(inp, ["x"], ["o_orderkey"])


def q_validate_features(spark, sf):
    from tabsmith.operators.predict import validate_features
    incoming = X.table(spark, sf, "orders").drop("o_orderdate")
    expected = ["o_custkey", "o_totalprice", "o_orderstatus", "o_shippriority"]
    return validate_features(incoming, expected)


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
