"""Independent DuckDB SQL for the SQL-checkable queries of ``catalog``.

Each text runs on the driver's pre-registered views; fixtures are defined
as CTEs from the same SQL as the Spark side. The computations themselves
(percentiles, modes, ranks, correlations, metrics) are written directly in
SQL, not derived from the Spark code. Doubles are rounded to 6 places.
"""

from __future__ import annotations

from tabsmith.sources.fixtures import DIRTY_COLUMNS, IMPORTANCE_FEATURES, duck_ctes


def _r(e: str) -> str:
    """Round to 6 places; -0.0 becomes 0.0 so both engines print one zero."""
    return f"(round(CAST({e} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


DIRTY_NUMERIC = ["id", "price", "price_copy", "age", "const_col"]
DIRTY_CATEGORICAL = ["status", "priority", "member", "city", "note", "empty_col", "target"]

NONEMPTY = (",\ndedup AS (SELECT DISTINCT * FROM dirty_orders),\n"
            "nonempty AS (SELECT * FROM dedup WHERE NOT ("
            + " AND ".join(f"{c} IS NULL" for c in DIRTY_COLUMNS) + "))\n")


def dirty(body: str, nonempty: bool = False, extra: str = "") -> str:
    return duck_ctes("dirty_orders") + (NONEMPTY if nonempty else "") + extra + body


ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- sources ---
ORACLE["load_table"] = "SELECT * FROM customer"
ORACLE["load_json"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
_OC = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
ORACLE["sample_exact_n"] = (f"SELECT {_OC} FROM orders "
                            "ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100000")
ORACLE["sample_fraction"] = (f"SELECT {_OC} FROM orders WHERE CAST(('0x' || substring(md5('42|' || "
                             "CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20")

# -------------------------------------------------------------- profiling ---
ORACLE["profile_shape"] = dirty('SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(12 AS BIGINT) AS "columns" '
                                "FROM dirty_orders")
_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST(count(*) - count({c}) AS BIGINT) AS missing "
                              f"FROM dirty_orders" for c in DIRTY_COLUMNS)
ORACLE["profile_missing"] = dirty(_MISSING)
ORACLE["profile_missing_total"] = dirty(f"SELECT CAST(sum(missing) AS BIGINT) AS missing_total FROM ({_MISSING})")
ORACLE["profile_duplicates"] = dirty("SELECT CAST((SELECT count(*) FROM dirty_orders) - "
                                     "(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS BIGINT) "
                                     "AS duplicate_rows")
ORACLE["profile_bytes"] = dirty(" UNION ALL ".join(
    (f"SELECT '{c}' AS col_name, CAST(count({c}) * 8 AS BIGINT) AS bytes FROM dirty_orders"
     if c in DIRTY_NUMERIC else
     f"SELECT '{c}' AS col_name, CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS bytes FROM dirty_orders")
    for c in DIRTY_COLUMNS))
ORACLE["profile_preview"] = "SELECT * FROM customer ORDER BY c_custkey LIMIT 5"

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]
ORACLE["describe_numeric"] = " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST(count({c}) AS BIGINT) AS count, {_r(f'avg({c})')} AS mean, "
    f"{_r(f'stddev_samp({c})')} AS std, {_r(f'min({c})')} AS min, {_r(f'quantile_cont({c}, 0.25)')} AS q25, "
    f"{_r(f'quantile_cont({c}, 0.5)')} AS q50, {_r(f'quantile_cont({c}, 0.75)')} AS q75, "
    f"{_r(f'max({c})')} AS max FROM lineitem" for c in _LI_NUM)
ORACLE["describe_categorical"] = dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST(count({c}) AS BIGINT) AS count, CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\", "
    f"(SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, "
    f"(SELECT CAST(count(*) AS DOUBLE) FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC LIMIT 1) AS freq FROM dirty_orders" for c in DIRTY_CATEGORICAL))

# --------------------------------------------------------------- cleaning ---
ORACLE["clean_names"] = ("SELECT c_custkey AS cust_key, c_name AS customer_name, c_nationkey AS nation_key, "
                         "c_acctbal AS acct_bal, c_mktsegment AS mkt_segment FROM customer")
ORACLE["dedup_rows"] = dirty("SELECT DISTINCT CAST(id AS DOUBLE) AS id, * EXCLUDE (id) FROM dirty_orders")
ORACLE["drop_empty_rows"] = dirty("SELECT * FROM nonempty", True)
ORACLE["drop_empty_columns"] = dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CASE WHEN count({c}) = 0 THEN 'Removed (Empty column)' ELSE 'kept' END AS action FROM nonempty"
    for c in DIRTY_COLUMNS), True)
ORACLE["drop_id_columns"] = dirty("SELECT * EXCLUDE (id) FROM nonempty", True)
_CARD = ["status", "priority", "member", "city", "note"]
ORACLE["drop_high_cardinality"] = dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"{_r(f'count(DISTINCT {c}) / count(*)')} AS ratio, "
    f"CASE WHEN count(DISTINCT {c}) / count(*) > 0.15 THEN 'Removed (Unique ratio > 0.15)' ELSE 'kept' END AS action "
    f"FROM nonempty" for c in _CARD), True)

# ---------------------------------------------------------------- missing ---
_FEAT_NUM = ["price", "price_copy", "age", "const_col"]
_FEAT_CAT = ["status", "priority", "member", "city"]
ORACLE["missing_columns"] = dirty(" UNION ALL ".join(
    [f"SELECT '{c}' AS col_name, 'numeric' AS kind FROM nonempty HAVING count(*) > count({c})" for c in _FEAT_NUM]
    + [f"SELECT '{c}', 'categorical' FROM nonempty HAVING count(*) > count({c})" for c in _FEAT_CAT]), True)

_QS = ",\n".join(
    f"qs_{c} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
    f"quantile_cont({c}, 0.5) AS med, avg({c}) AS mean, min({c}) AS mn, max({c}) AS mx, "
    f"count(*) AS n, count({c}) AS nn FROM nonempty)" for c in _FEAT_NUM)
_QS = ",\n" + _QS + "\n"


def _fences(c):
    return (f"(SELECT q1 - 1.5 * (q3 - q1) FROM qs_{c})", f"(SELECT q3 + 1.5 * (q3 - q1) FROM qs_{c})")


ORACLE["iqr_outlier_flags"] = dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, {_r('q1')} AS q1, {_r('q3')} AS q3, {_r('q1 - 1.5 * (q3 - q1)')} AS lower, "
    f"{_r('q3 + 1.5 * (q3 - q1)')} AS upper, (mn < q1 - 1.5 * (q3 - q1) OR mx > q3 + 1.5 * (q3 - q1)) AS has_outliers "
    f"FROM qs_{c} WHERE n > nn" for c in _FEAT_NUM), True, _QS)
ORACLE["iqr_outlier_rows"] = dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST(sum(CASE WHEN {c} < {_fences(c)[0]} OR {c} > {_fences(c)[1]} THEN 1 ELSE 0 END) "
    f"AS BIGINT) AS outlier_rows FROM nonempty HAVING (SELECT n > nn FROM qs_{c})" for c in _FEAT_NUM), True, _QS)


def _fill(c):
    return (f"(SELECT CASE WHEN mn < q1 - 1.5 * (q3 - q1) OR mx > q3 + 1.5 * (q3 - q1) THEN med ELSE mean END "
            f"FROM qs_{c})")


def _mode(c):
    return f"(SELECT {c} FROM nonempty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


_FILLED = (",\nfilled AS (SELECT id, "
           + ", ".join(f"coalesce({c}, {_fill(c)}) AS {c}" for c in _FEAT_NUM) + ", "
           + ", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in _FEAT_CAT)
           + " FROM nonempty)\n")
ORACLE["impute_numeric"] = dirty("SELECT id, " + ", ".join(f"{_r(c)} AS {c}" for c in _FEAT_NUM)
                                 + " FROM filled", True, _QS + _FILLED)
ORACLE["impute_categorical"] = dirty("SELECT id, " + ", ".join(_FEAT_CAT) + " FROM filled", True, _QS + _FILLED)
ORACLE["impute_report"] = dirty(" UNION ALL ".join(
    [f"SELECT '{c}' AS col_name, CASE WHEN mn < q1 - 1.5 * (q3 - q1) OR mx > q3 + 1.5 * (q3 - q1) "
     f"THEN 'Median (Outliers Detected)' ELSE 'Mean (No Outliers)' END AS method FROM qs_{c} WHERE n > nn"
     for c in _FEAT_NUM]
    + [f"SELECT '{c}', 'Mode' FROM nonempty HAVING count(*) > count({c})" for c in _FEAT_CAT]), True, _QS)

# --------------------------------------------------------------- encoding ---
ORACLE["encoding_plan"] = dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST(count(DISTINCT {c}) AS BIGINT) AS levels, "
    f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'label' WHEN count(DISTINCT {c}) BETWEEN 3 AND 10 THEN 'one_hot' "
    f"ELSE 'leftover' END AS method FROM nonempty" for c in _FEAT_CAT), True)
ORACLE["label_encode"] = dirty(
    "SELECT id, CAST(CASE WHEN member = (SELECT min(member) FROM filled) THEN 0 ELSE 1 END AS INTEGER) AS member "
    "FROM filled", True, _QS + _FILLED)
# one-hot column names depend on the data; the levels are the sorted values seen
_STATUS = ["O", "P"]
_PRIORITY = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_HOT = [("status", v) for v in _STATUS] + [("priority", v) for v in _PRIORITY]
ORACLE["one_hot_encode"] = dirty(
    "SELECT id, " + ", ".join(f"CAST({c} = '{v}' AS INTEGER) AS {_q(c + '_' + v)}" for c, v in _HOT)
    + " FROM filled", True, _QS + _FILLED)
ORACLE["encoding_report"] = dirty(" UNION ALL ".join(
    [f"SELECT '{c}' AS col_name, 'Label Encoding' AS method FROM nonempty HAVING count(DISTINCT {c}) = 2"
     for c in _FEAT_CAT]
    + [f"SELECT '{c}', 'One Hot Encoding' FROM nonempty HAVING count(DISTINCT {c}) BETWEEN 3 AND 10"
       for c in _FEAT_CAT]), True)

ORACLE["split_xy"] = dirty("SELECT id, CAST(dense_rank() OVER (ORDER BY target) - 1 AS DOUBLE) AS label "
                           "FROM nonempty", True)
ORACLE["infer_problem_type"] = (
    duck_ctes("dirty_orders", "labelled_docs") + NONEMPTY +
    "SELECT 'dirty_orders' AS dataset, 'target' AS target, 'classification' AS problem_type "
    "UNION ALL SELECT 'labelled_docs', 'quality', CASE WHEN count(DISTINCT quality) > 20 THEN 'regression' "
    "ELSE 'classification' END FROM labelled_docs "
    "UNION ALL SELECT 'labelled_docs', 'n_chars', CASE WHEN count(DISTINCT n_chars) > 20 THEN 'regression' "
    "ELSE 'classification' END FROM labelled_docs "
    "UNION ALL SELECT 'lineitem', 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) > 20 THEN 'regression' "
    "ELSE 'classification' END FROM lineitem "
    "UNION ALL SELECT 'lineitem', 'l_quantity', CASE WHEN count(DISTINCT l_quantity) > 20 THEN 'regression' "
    "ELSE 'classification' END FROM lineitem")

# ---------------------------------------------------- scaling / selection ---
_ENC_COLS = ["price", "price_copy", "age", "const_col", "member"] + [c + "_" + v for c, v in _HOT]
_ENC = (",\nenc AS (SELECT id, price, price_copy, age, const_col, "
        "CAST(CASE WHEN member = (SELECT min(member) FROM filled) THEN 0 ELSE 1 END AS DOUBLE) AS member, "
        + ", ".join(f"CAST({c} = '{v}' AS DOUBLE) AS {_q(c + '_' + v)}" for c, v in _HOT)
        + " FROM filled),\nst AS (SELECT "
        + ", ".join(f"avg({_q(c)}) AS m{i}, stddev_pop({_q(c)}) AS s{i}, min({_q(c)}) AS lo{i}, "
                    f"max({_q(c)}) AS hi{i}" for i, c in enumerate(_ENC_COLS))
        + " FROM enc)\n")
_ENC_ALL = _QS + _FILLED + _ENC


def _std(i, c):
    return f"CASE WHEN s{i} = 0 THEN {_q(c)} - m{i} ELSE ({_q(c)} - m{i}) / s{i} END"


ORACLE["standard_scale"] = dirty(
    "SELECT id, " + ", ".join(f"{_r(_std(i, c))} AS {_q(c)}" for i, c in enumerate(_ENC_COLS))
    + " FROM enc, st", True, _ENC_ALL)
ORACLE["min_max_scale"] = dirty(
    "SELECT id, " + ", ".join(
        f"{_r(f'CASE WHEN hi{i} = lo{i} THEN {_q(c)} - lo{i} ELSE ({_q(c)} - lo{i}) / (hi{i} - lo{i}) END')} "
        f"AS {_q(c)}" for i, c in enumerate(_ENC_COLS))
    + " FROM enc, st", True, _ENC_ALL)
_VAR = " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, {_r(f'var_pop({_std(i, c)})')} AS variance, "
    f"CASE WHEN var_pop({_std(i, c)}) > 0 THEN 'kept' ELSE 'Removed (Variance <= 0.0)' END AS action FROM enc, st"
    for i, c in enumerate(_ENC_COLS)) + \
    " UNION ALL SELECT 'city', CAST(NULL AS DOUBLE), 'Removed (Variance <= 0.0)'"
ORACLE["variance_selection"] = dirty(_VAR, True, _ENC_ALL)
_KEPT = [c for c in _ENC_COLS if c != "const_col"]
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{b}' AS col_j, {_r(f'abs(corr({_q(a)}, {_q(b)}))')} AS abs_corr FROM enc"
    for i, a in enumerate(_KEPT) for b in _KEPT[i + 1:])
ORACLE["correlation_matrix"] = dirty(_PAIRS, True, _ENC_ALL)
_KEPT_VALUES = " UNION ALL ".join(f"SELECT '{c}' AS c" for c in _KEPT)
_CORR_DROP = (f"SELECT col_j AS col_name FROM ({_PAIRS}) GROUP BY col_j HAVING max(abs_corr) > 0.9")
ORACLE["correlation_selection"] = dirty(
    f"SELECT col_name, 'Removed (Correlation > 0.9)' AS action FROM ({_CORR_DROP}) "
    f"UNION ALL SELECT c, 'kept' FROM ({_KEPT_VALUES}) WHERE c NOT IN ({_CORR_DROP})", True, _ENC_ALL)
ORACLE["feature_report"] = dirty(
    f"SELECT col_name, action FROM ({_VAR}) WHERE action <> 'kept' "
    f"UNION ALL SELECT col_name, 'Removed (Correlation > 0.9)' FROM ({_CORR_DROP})", True, _ENC_ALL)

# ------------------------------------------------------------------ split ---
_STRAT = ("SELECT id, CASE WHEN rn <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS part FROM ("
          "SELECT id, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || CAST(id AS VARCHAR))) AS rn, "
          "count(*) OVER (PARTITION BY target) AS n FROM nonempty)")
ORACLE["split_stratified"] = dirty(_STRAT, True)
_RAND = ("SELECT doc_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM ("
         "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rn, "
         "count(*) OVER () AS n FROM labelled_docs)")
ORACLE["split_random"] = duck_ctes("labelled_docs") + _RAND
ORACLE["split_fallback"] = (duck_ctes("labelled_docs") +
                            f"SELECT doc_id, part, (SELECT min(c) < 2 FROM (SELECT count(*) AS c FROM labelled_docs "
                            f"GROUP BY n_chars)) AS fell_back FROM ({_RAND})")
ORACLE["split_report"] = dirty(
    f"SELECT 'Training Samples' AS item, CAST(sum(CASE WHEN part = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS \"rows\" "
    f"FROM ({_STRAT}) UNION ALL SELECT 'Testing Samples', CAST(sum(CASE WHEN part = 'test' THEN 1 ELSE 0 END) AS BIGINT) "
    f"FROM ({_STRAT}) UNION ALL SELECT 'Training Labels', CAST(sum(CASE WHEN part = 'train' THEN 1 ELSE 0 END) AS BIGINT) "
    f"FROM ({_STRAT}) UNION ALL SELECT 'Testing Labels', CAST(sum(CASE WHEN part = 'test' THEN 1 ELSE 0 END) AS BIGINT) "
    f"FROM ({_STRAT})", True)


# ------------------------------------------------------------- evaluation ---

def _class_table(src: str, name: str) -> str:
    return (f"{name}_cc AS (SELECT model, label, prediction, count(*) AS n FROM {src} GROUP BY model, label, prediction),\n"
            f"{name}_cls AS (SELECT model, label AS cls FROM {name}_cc UNION SELECT model, prediction FROM {name}_cc),\n"
            f"{name}_t0 AS (SELECT c.model, c.cls, "
            f"coalesce((SELECT sum(n) FROM {name}_cc x WHERE x.model = c.model AND x.label = c.cls), 0) AS support, "
            f"coalesce((SELECT sum(n) FROM {name}_cc x WHERE x.model = c.model AND x.prediction = c.cls), 0) AS predicted, "
            f"coalesce((SELECT sum(n) FROM {name}_cc x WHERE x.model = c.model AND x.label = c.cls "
            f"AND x.prediction = c.cls), 0) AS tp FROM {name}_cls c),\n"
            f"{name}_t1 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS p, "
            f"CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS r FROM {name}_t0),\n"
            f"{name}_t AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM {name}_t1),\n"
            f"{name}_m AS (SELECT model, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, "
            f"sum(support * p) / sum(support) AS precision, sum(support * r) / sum(support) AS recall, "
            f"sum(support * f) / sum(support) AS f1 FROM {name}_t GROUP BY model)")


def _auc(src: str, name: str) -> str:
    return (f"{name}_col AS (SELECT model, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, "
            f"CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS neg, "
            f"sum(CASE WHEN label NOT IN (0, 1) THEN 1 ELSE 0 END) AS other "
            f"FROM {src} WHERE score IS NOT NULL GROUP BY model, score),\n"
            f"{name}_rk AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_col),\n"
            f"{name}_auc0 AS (SELECT model, CASE WHEN sum(other) = 0 AND sum(pos) > 0 AND sum(neg) > 0 THEN "
            f"sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc FROM {name}_rk GROUP BY model),\n"
            f"{name}_auc AS (SELECT d.model, a.roc_auc FROM (SELECT DISTINCT model FROM {src}) d "
            f"LEFT JOIN {name}_auc0 a ON a.model = d.model)")


_EVAL_CTES = (duck_ctes("fixed_predictions", "fixed_predictions_multiclass") + ",\n"
              + _class_table("fixed_predictions", "b") + ",\n" + _class_table("fixed_predictions_multiclass", "mc")
              + ",\n" + _auc("fixed_predictions", "b") + ",\n" + _auc("fixed_predictions_multiclass", "mc") + "\n")


def _metric_sql(col: str) -> str:
    return (_EVAL_CTES + f"SELECT model, {_r(col)} AS value, 'binary' AS kind FROM b_m "
            f"UNION ALL SELECT model, {_r(col)}, 'multiclass' FROM mc_m")


for _k, _c in [("metric_accuracy", "accuracy"), ("metric_precision", "precision"),
               ("metric_recall", "recall"), ("metric_f1", "f1")]:
    ORACLE[_k] = _metric_sql(_c)
ORACLE["metric_roc_auc"] = (_EVAL_CTES + f"SELECT model, {_r('roc_auc')} AS roc_auc, 'binary' AS kind FROM b_auc "
                            f"UNION ALL SELECT model, {_r('roc_auc')}, 'multiclass' FROM mc_auc")


def _cm(name: str, kind: str) -> str:
    return (f"SELECT a.model, a.cls AS label, b.cls AS prediction, CAST(coalesce((SELECT sum(n) FROM {name}_cc x "
            f"WHERE x.model = a.model AND x.label = a.cls AND x.prediction = b.cls), 0) AS BIGINT) AS count, "
            f"'{kind}' AS kind FROM {name}_cls a JOIN {name}_cls b ON a.model = b.model")


ORACLE["confusion_matrix"] = _EVAL_CTES + _cm("b", "binary") + " UNION ALL " + _cm("mc", "multiclass")


def _report(name: str, kind: str) -> str:
    return (f"SELECT model, 'class' AS row_type, cls AS class_value, {_r('p')} AS precision, {_r('r')} AS recall, "
            f"{_r('f')} AS f1, CAST(support AS BIGINT) AS support, '{kind}' AS kind FROM {name}_t "
            f"UNION ALL SELECT model, 'accuracy', NULL, NULL, NULL, {_r('sum(tp) / sum(support)')}, "
            f"CAST(sum(support) AS BIGINT), '{kind}' FROM {name}_t GROUP BY model "
            f"UNION ALL SELECT model, 'macro avg', NULL, {_r('avg(p)')}, {_r('avg(r)')}, {_r('avg(f)')}, "
            f"CAST(sum(support) AS BIGINT), '{kind}' FROM {name}_t GROUP BY model "
            f"UNION ALL SELECT model, 'weighted avg', NULL, {_r('sum(support * p) / sum(support)')}, "
            f"{_r('sum(support * r) / sum(support)')}, {_r('sum(support * f) / sum(support)')}, "
            f"CAST(sum(support) AS BIGINT), '{kind}' FROM {name}_t GROUP BY model")


ORACLE["classification_report"] = _EVAL_CTES + _report("b", "binary") + " UNION ALL " + _report("mc", "multiclass")

_REG = (duck_ctes("fixed_predictions_regression") +
        ",\nreg AS (SELECT model, avg(abs(label - prediction)) AS mae, avg((label - prediction) * (label - prediction)) "
        "AS mse, var_pop(label) AS vy FROM fixed_predictions_regression GROUP BY model),\n"
        "reg_m AS (SELECT model, mae, mse, sqrt(mse) AS rmse, 1 - mse / nullif(vy, 0) AS r2 FROM reg)\n")
ORACLE["metric_mae_mse_rmse"] = _REG + f"SELECT model, {_r('mae')} AS mae, {_r('mse')} AS mse, {_r('rmse')} AS rmse FROM reg_m"
ORACLE["metric_r2"] = _REG + f"SELECT model, {_r('r2')} AS r2 FROM reg_m"

_CMJ = (",\ncm_cells AS (" + _cm("b", "binary") + "),\n"
        "cm_rows AS (SELECT model, label, list(count ORDER BY prediction) AS r FROM cm_cells GROUP BY model, label),\n"
        "cm_json AS (SELECT model, CAST(to_json(list(r ORDER BY label)) AS VARCHAR) AS matrix FROM cm_rows GROUP BY model)\n")
# the usual text table: name to the width of 'weighted avg' (class names here are shorter), cells to 9
_CELL = "lpad(CASE WHEN {0} IS NULL THEN '' ELSE format('{{:.2f}}', round({0}, 6)) END, 9, ' ')"
_REPT = (",\nrep_rows AS (" + _report("b", "binary") + "),\n"
         "rep_lines AS (SELECT model, class_value, CASE row_type WHEN 'class' THEN 0 WHEN 'accuracy' THEN 1 WHEN 'macro avg' THEN 2 ELSE 3 END AS k, "
         "lpad(CASE WHEN row_type = 'class' THEN CAST(CAST(class_value AS BIGINT) AS VARCHAR) ELSE row_type END, 12, ' ') || '  ' || "
         + " || ' ' || ".join(_CELL.format(c) for c in ("precision", "recall", "f1"))
         + " || ' ' || lpad(CAST(support AS VARCHAR), 9, ' ') AS line FROM rep_rows),\n"
         "rep_text AS (SELECT model, '" + " " * 13 + " precision    recall  f1-score   support' || chr(10) || chr(10) || "
         "string_agg(CASE WHEN k = 1 THEN chr(10) ELSE '' END || line, chr(10) ORDER BY k, class_value) || chr(10) AS report FROM rep_lines GROUP BY model)\n")
ORACLE["evaluation_long"] = (
    _EVAL_CTES + _CMJ + _REPT +
    " UNION ALL ".join(f"SELECT m.model, '{n}' AS metric, {_r(c)} AS value, CAST(NULL AS VARCHAR) AS value_json "
                       f"FROM b_m m JOIN b_auc a ON a.model = m.model"
                       for n, c in [("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"),
                                    ("F1 Score", "f1"), ("ROC-AUC", "roc_auc")])
    + " UNION ALL SELECT model, 'Confusion Matrix', CAST(NULL AS DOUBLE), matrix FROM cm_json"
    + " UNION ALL SELECT model, 'Classification Report', CAST(NULL AS DOUBLE), report FROM rep_text")

# ------------------------------------------------------------- comparison ---
_BOARDS = (_EVAL_CTES.rstrip() + ",\n" + _REG.split("WITH ", 1)[1].rstrip().replace(
    "fixed_predictions_regression AS", "fixed_predictions_regression AS", 1)
    + ",\ncls_board AS (SELECT m.model, m.accuracy, m.precision, m.recall, m.f1, a.roc_auc, "
    "row_number() OVER (ORDER BY m.accuracy DESC, m.model) AS rank FROM b_m m JOIN b_auc a ON a.model = m.model),\n"
    "reg_board AS (SELECT model, mae, mse, rmse, r2, row_number() OVER (ORDER BY r2 DESC NULLS LAST, rmse, model) "
    "AS rank FROM reg_m)\n")
ORACLE["leaderboard_classification"] = (
    _BOARDS + f"SELECT model, {_r('accuracy')} AS accuracy, {_r('precision')} AS precision, {_r('recall')} AS recall, "
    f"{_r('f1')} AS f1, {_r('roc_auc')} AS roc_auc, rank FROM cls_board")
ORACLE["leaderboard_regression"] = (
    _BOARDS + f"SELECT model, {_r('mae')} AS mae, {_r('mse')} AS mse, {_r('rmse')} AS rmse, {_r('r2')} AS r2, rank "
    "FROM reg_board")
ORACLE["top_models"] = (_BOARDS + "SELECT model, rank, 'classification' AS kind FROM cls_board WHERE rank <= 3 "
                        "UNION ALL SELECT model, rank, 'regression' FROM reg_board WHERE rank <= 3")
ORACLE["best_model"] = (_BOARDS + "SELECT model, rank, 'classification' AS kind FROM cls_board WHERE rank = 1 "
                        "UNION ALL SELECT model, rank, 'regression' FROM reg_board WHERE rank = 1")


def _by_metric(board, kind, metrics):
    parts = []
    for m in metrics:
        order = f"{m} ASC NULLS LAST" if m in ("mae", "mse", "rmse") else f"{m} DESC NULLS LAST"
        parts.append(f"SELECT model, '{m}' AS metric, {_r(m)} AS value, row_number() OVER (ORDER BY {order}, model) "
                     f"AS rank, '{kind}' AS kind FROM {board}")
    return " UNION ALL ".join(parts)


ORACLE["leaderboard_by_metric"] = _BOARDS + _by_metric(
    "cls_board", "classification", ["accuracy", "precision", "recall", "f1", "roc_auc"]) + " UNION ALL " + _by_metric(
    "reg_board", "regression", ["r2", "rmse", "mae", "mse"])
ORACLE["score_distribution"] = (
    _BOARDS + f"SELECT model, rank, {_r('accuracy * 100.0')} AS score, 'classification' AS kind FROM cls_board "
    f"WHERE rank <= 5 UNION ALL SELECT model, rank, {_r('r2')}, 'regression' FROM reg_board WHERE rank <= 5")


def _disp(m, percent):
    if percent:
        return f"CASE WHEN {m} IS NULL THEN '—' ELSE printf('%.1f%%', round({m} * 100, 1)) END"
    return f"CASE WHEN {m} IS NULL THEN '—' ELSE printf('%.3f', round({m}, 3)) END"


ORACLE["leaderboard_display"] = _BOARDS + " UNION ALL ".join(
    [f"SELECT model, '{m}' AS metric, {_disp(m, True)} AS display FROM cls_board" for m in ["accuracy", "f1", "roc_auc"]]
    + [f"SELECT model, '{m}', {_disp(m, False)} FROM reg_board" for m in ["r2", "rmse"]])

_IMP = (duck_ctes("importance_input") +
        ",\nimp_n AS (SELECT model, feature, CASE WHEN sum(importance) OVER (PARTITION BY model) <> 0 THEN "
        "importance / sum(importance) OVER (PARTITION BY model) ELSE importance END AS importance FROM importance_input),\n"
        "imp_r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM imp_n),\n"
        "imp AS (SELECT model, feature, importance, rank FROM imp_r WHERE rank <= 10 AND importance > 0)\n")
ORACLE["feature_importance"] = _IMP + f"SELECT model, feature, {_r('importance')} AS importance, rank FROM imp"
ORACLE["importance_highlights"] = (
    _BOARDS.rstrip() + ",\n" + _IMP.split("WITH ", 1)[1] +
    f"SELECT i.model, i.feature, {_r('i.importance * 100')} AS percent, i.rank FROM imp i "
    "JOIN cls_board b ON b.model = i.model AND b.rank = 1 WHERE i.rank <= 8")

_TUNED = (_BOARDS.rstrip() + ",\n" + duck_ctes("fixed_predictions_tuned").split("WITH ", 1)[1].rstrip() + ",\n"
          + _class_table("fixed_predictions_tuned", "tu") + "\n")
ORACLE["select_tuned"] = (
    _TUNED + "SELECT model, version, " + _r("acc") + " AS accuracy, row_number() OVER (ORDER BY acc DESC, model) "
    "AS rank FROM (SELECT o.model, CASE WHEN t.accuracy > o.accuracy THEN 'tuned' ELSE 'original' END AS version, "
    "CASE WHEN t.accuracy > o.accuracy THEN t.accuracy ELSE o.accuracy END AS acc "
    "FROM cls_board o LEFT JOIN tu_m t ON t.model = o.model)")

# ---------------------------------------------------------------- predict ---
ORACLE["reject_non_numeric"] = (
    "SELECT o_orderkey, 'x' AS col_name, x AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 "
    "THEN o_orderpriority ELSE CAST(o_totalprice AS VARCHAR) END AS x FROM orders) "
    "WHERE x IS NOT NULL AND TRY_CAST(x AS DOUBLE) IS NULL")

# the driver's views carry their columns in information_schema
ORACLE["validate_features"] = (
    "WITH expected AS (SELECT * FROM (VALUES ('o_custkey'), ('o_totalprice'), ('o_orderstatus'), "
    "('o_shippriority')) AS t(feature)),\n"
    "have AS (SELECT column_name AS feature FROM information_schema.columns WHERE table_name = 'orders' "
    "AND column_name <> 'o_orderdate')\n"
    "SELECT feature, CASE WHEN feature IN (SELECT feature FROM have) THEN 'ok' ELSE 'missing' END AS status "
    "FROM expected UNION ALL SELECT feature, 'unexpected' FROM have WHERE feature NOT IN (SELECT feature FROM expected)")

_DUCK_TYPES = "CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' " \
              "WHEN 'VARCHAR' THEN 'string' ELSE lower(typeof({c})) END"
ORACLE["profile_types"] = dirty(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", {_DUCK_TYPES.format(c=c)} AS dtype, "
    f"CASE WHEN typeof({c}) IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT') THEN 'numeric' "
    f"ELSE 'categorical' END AS kind FROM dirty_orders LIMIT 1)" for c in DIRTY_COLUMNS))
