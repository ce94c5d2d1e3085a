"""DuckDB SQL for ``catalog_rules``: the rules themselves, and neighbours,
folds and their scores computed from all pairs."""

from __future__ import annotations

import json

from tabsmith.operators.tune import CLASSIFICATION_GRIDS, reference_settings
from tabsmith.plans.catalog_rules import CLASSIFIERS, REGRESSORS
from tabsmith.plans.oracle import ORACLE
from tabsmith.sources.fixtures import duck_ctes

RULE_ORACLE: dict[str, str] = {}

_R = duck_ctes("rule_orders")


def _split(target: str | None) -> str:
    """The run's split: exact per class by key hash, or over all rows."""
    part = f"PARTITION BY {target} " if target else ""
    least = "floor(0.2 * n + 0.5)" if target else "ceil(0.2 * n)"
    return (_R + f", parts AS (SELECT *, rn <= {least} AS test FROM (SELECT *, row_number() OVER ({part}ORDER BY md5('42|' || "
            f"CAST(o_orderkey AS VARCHAR))) AS rn, count(*) OVER ({part.strip()}) AS n FROM rule_orders))\n")


_LABEL = {"target": "CAST(target = 'low' AS DOUBLE)", "family": "CAST(right(family, 1) AS DOUBLE)"}
_LEVEL = "CAST(round((amount - 1010) / 100) AS INTEGER) AS level"

for _key in CLASSIFIERS:
    for _kind, _target in (("clf", "target"), ("multiclass", "family")):
        RULE_ORACLE[f"rule_{_kind}_{_key}"] = (_split(_target) + f"SELECT o_orderkey, {_LABEL[_target]} AS label, "
                                               f"{_LABEL[_target]} AS prediction FROM parts WHERE test")
for _key in ("winner", "svm", "knn"):
    RULE_ORACLE[f"score_saved_{_key}"] = _R + "SELECT o_orderkey, target AS predicted_label FROM rule_orders"
for _key in ("svm", "gbt"):
    RULE_ORACLE[f"score_saved_multiclass_{_key}"] = _R + "SELECT o_orderkey, family AS predicted_label FROM rule_orders"
for _key in REGRESSORS:
    RULE_ORACLE[f"rule_reg_{_key}"] = _split(None) + f"SELECT o_orderkey, amount AS label, {_LEVEL} FROM parts WHERE test"
for _key in ("forest", "knn"):
    RULE_ORACLE[f"score_saved_reg_{_key}"] = _R + f"SELECT o_orderkey, {_LEVEL} FROM rule_orders"

_NAMES = "(VALUES " + ", ".join(f"('{n}')" for n in CLASSIFIERS.values()) + ") AS names(model)"
_ONE = "CAST(1 AS DOUBLE)"
RULE_ORACLE["rule_leaderboard"] = (f"SELECT model, {_ONE} AS accuracy, {_ONE} AS precision, {_ONE} AS recall, {_ONE} AS f1, {_ONE} AS roc_auc, "
                                   f"CAST(row_number() OVER (ORDER BY model) AS INTEGER) AS rank FROM {_NAMES}")
RULE_ORACLE["rule_summary"] = (_R + "SELECT 'Classification' AS problem_type, count(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_values, "
                               f"(SELECT min(model) FROM {_NAMES}) AS best_model, 'Accuracy' AS best_metric_label, {_ONE} AS best_metric_value FROM rule_orders")
RULE_ORACLE["rule_best_parameters"] = (
    _R + f"SELECT 'classification' AS problem_type, (SELECT min(model) FROM {_NAMES}) AS selected_model, {_ONE} AS accuracy, "
    "'[\"signal\",' || string_agg('\"priority_' || priority || '\"', ',' ORDER BY priority) || ']' AS input_features, true AS has_parameters "
    "FROM (SELECT DISTINCT priority FROM rule_orders) WHERE priority > (SELECT min(priority) FROM rule_orders)")

_HEAD = "'" + " " * 13 + " precision    recall  f1-score   support' || chr(10) || chr(10)"
_LINE = "lpad('{0}', 12, ' ') || '       1.00      1.00      1.00 ' || lpad(CAST({1} AS VARCHAR), 9, ' ') || chr(10)"
RULE_ORACLE["rule_evaluation"] = (
    _split("target") + f", t AS (SELECT count(*) FILTER (WHERE target = 'high') AS h, count(*) FILTER (WHERE target = 'low') AS l FROM parts WHERE test),\n"
    "x AS (SELECT '[[' || h || ',0],[0,' || l || ']]' AS matrix, " + _HEAD + " || " + _LINE.format(0, "h") + " || " + _LINE.format(1, "l")
    + " || chr(10) || lpad('accuracy', 12, ' ') || repeat(' ', 21) || '      1.00 ' || lpad(CAST(h + l AS VARCHAR), 9, ' ') || chr(10) || "
    + _LINE.format("macro avg", "h + l") + " || " + _LINE.format("weighted avg", "h + l") + " AS report FROM t)\n"
    + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {_ONE} AS value, CAST(NULL AS VARCHAR) AS value_json FROM {_NAMES}"
                         for m in ("Accuracy", "Precision", "Recall", "F1 Score", "ROC-AUC"))
    + f" UNION ALL SELECT model, 'Confusion Matrix', NULL, matrix FROM {_NAMES}, x UNION ALL SELECT model, 'Classification Report', NULL, report FROM {_NAMES}, x")

RULE_ORACLE["score_probabilities"] = (_R + "SELECT o_orderkey, model, family AS likeliest, CAST(1 AS DOUBLE) AS total, CAST(3 AS INTEGER) AS n_classes "
                                      f"FROM rule_orders, {_NAMES}")
_BAD = "(o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)"
RULE_ORACLE["score_stream"] = _R + f"SELECT o_orderkey, CAST(target = 'low' AS DOUBLE) AS prediction FROM rule_orders WHERE NOT {_BAD}"
RULE_ORACLE["score_stream_rejects"] = (_R + "SELECT o_orderkey, 'signal' AS col_name, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE priority || '?' END AS value "
                                       f"FROM rule_orders WHERE {_BAD}")

# ------------------------------------------------------------- neighbours ---
_SPLIT = ("WITH split AS (SELECT *, rn <= ceil(0.2 * n) AS test FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER "
          "(ORDER BY md5('42|' || CAST(vec_id AS VARCHAR))) AS rn, count(*) OVER () AS n FROM embeddings)),\n")
_METRIC = {"euclidean": "list_distance(q.e, t.e)", "manhattan": "list_sum(list_transform(range(1, len(q.e) + 1), lambda i: abs(q.e[i] - t.e[i])))"}


def _nearest(metric: str) -> str:
    return (_SPLIT + f"d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label AS tl, {_METRIC[metric]} AS dist FROM split q JOIN split t ON q.test AND NOT t.test),\n"
            "nn AS (SELECT *, min(dist) OVER (PARTITION BY qid) AS low FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rk FROM d) WHERE rk <= 5),\n"
            "w AS (SELECT *, CASE WHEN low = 0 THEN CAST(dist = 0 AS DOUBLE) ELSE 1 / dist END AS w FROM nn)\n")


def _vote(weight: str) -> str:
    return (f", v AS (SELECT qid, tl, {weight} AS c FROM w GROUP BY qid, tl), p AS (SELECT qid, tl, row_number() OVER "
            "(PARTITION BY qid ORDER BY c DESC, tl) AS r FROM v) SELECT qid AS vec_id, CAST(tl AS DOUBLE) AS prediction FROM p WHERE r = 1")


RULE_ORACLE["knn_manhattan"] = _nearest("manhattan") + _vote("count(*)")
RULE_ORACLE["knn_distance_weighted"] = _nearest("euclidean") + _vote("sum(w)")
RULE_ORACLE["knn_regress_weighted"] = _nearest("manhattan") + ("SELECT qid AS vec_id, round(sum(w * tl) / sum(w), 6) + CAST(0 AS DOUBLE) AS prediction "
                                                              "FROM w GROUP BY qid")

# ------------------------------------------------------------------ folds ---
_FOLD = "CAST(floor(CAST('0x' || substr(md5('42|' || CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 * 3) AS INTEGER)"
_KNN_SETTINGS = ", ".join(
    "({}, '{}', '{}', '{}')".format(s["n_neighbors"], s["weights"], s["metric"],
                                    json.dumps({"k": str(s["n_neighbors"]), "metric": s["metric"], "weights": s["weights"]}, sort_keys=True))
    for s in reference_settings(CLASSIFICATION_GRIDS["KNN"]))
_KNN_FOLDS = (
    "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, " + _FOLD.format("vec_id") + " AS fold FROM embeddings),\n"
    "d AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, q.fold, q.vec_id AS qid, q.label AS ql, t.vec_id AS tid, t.label AS tl, {x} AS dist "
                                  "FROM e q JOIN e t ON q.fold <> t.fold" for m, x in _METRIC.items()) + "),\n"
    "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, qid ORDER BY dist, tid) AS rk FROM d) WHERE rk <= 9),\n"
    f"s(k, weights, metric, params) AS (VALUES {_KNN_SETTINGS}),\n"
    "n AS (SELECT r.*, s.k, s.weights, s.params, min(dist) OVER (PARTITION BY s.params, qid) AS low FROM r JOIN s ON r.metric = s.metric AND r.rk <= s.k),\n"
    "w AS (SELECT *, CASE WHEN weights = 'uniform' THEN CAST(1 AS DOUBLE) WHEN low = 0 THEN CAST(dist = 0 AS DOUBLE) ELSE 1 / dist END AS w FROM n),\n"
    "v AS (SELECT params, fold, qid, ql, tl, sum(w) AS c FROM w GROUP BY ALL),\n"
    "p AS (SELECT *, row_number() OVER (PARTITION BY params, qid ORDER BY c DESC, tl) AS o FROM v),\n"
    "scores AS (SELECT params, fold, avg(CAST(ql = tl AS DOUBLE)) AS score, count(*) AS rows FROM p WHERE o = 1 GROUP BY params, fold)\n")
_LINEAR_FOLDS = (
    duck_ctes("labelled_docs") + ", f AS (SELECT CAST(n_chars AS DOUBLE) AS y, CAST(n_words AS DOUBLE) AS x, " + _FOLD.format("doc_id") + " AS fold FROM labelled_docs),\n"
    "k AS (SELECT DISTINCT fold FROM f),\n"
    "m AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x * y) / sum(x * x) AS c FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold),\n"
    "p AS (SELECT fold, y, a + b * x AS with_it, c * x AS without FROM f JOIN m USING (fold)),\n"
    "scores AS (SELECT '{\"fitIntercept\": \"True\"}' AS params, fold, 1 - avg((y - with_it) ** 2) / var_pop(y) AS score, count(*) AS rows FROM p GROUP BY fold\n"
    "UNION ALL SELECT '{\"fitIntercept\": \"False\"}', fold, 1 - avg((y - without) ** 2) / var_pop(y), count(*) FROM p GROUP BY fold)\n")
_SCORES = "SELECT params, fold, round(score, 6) + CAST(0 AS DOUBLE) AS score, rows FROM scores"
RULE_ORACLE["fold_scores_knn"] = _KNN_FOLDS + _SCORES
RULE_ORACLE["fold_scores_linear"] = _LINEAR_FOLDS + _SCORES

# --------------------------------------------- reports of a table with nulls ---
# put together from the SQL of the single steps, which the run must have taken alike
_STEP = lambda key: "(" + ORACLE[key] + ")"
_DROPPED = ("(SELECT 'empty_col' AS col_name, 'Removed (Empty column)' AS action UNION ALL SELECT 'id', 'Removed (Identifier column)' "
            f"UNION ALL SELECT col_name, action FROM {_STEP('drop_high_cardinality')} WHERE action <> 'kept')")
RULE_ORACLE["dirty_preprocessing_report"] = (
    f"SELECT 'cleaning' AS stage, col_name, action FROM {_DROPPED} "
    f"UNION ALL SELECT 'missing', col_name, method FROM {_STEP('impute_report')} "
    f"UNION ALL SELECT 'encoding', col_name, method FROM {_STEP('encoding_report')} "
    f"UNION ALL SELECT 'scaling', col_name, 'Standard Scaling' FROM {_STEP('variance_selection')} WHERE variance IS NOT NULL "
    f"UNION ALL SELECT 'selection', * FROM {_STEP('feature_report')}")
RULE_ORACLE["dirty_dataset_report"] = (
    duck_ctes("dirty_orders") + "SELECT 'rows' AS item, '' AS col_name, CAST(count(*) AS BIGINT) AS value FROM dirty_orders "
    "UNION ALL SELECT 'columns', '', 12 "
    f"UNION ALL SELECT 'missing_values_total', '', CAST(sum(missing) AS BIGINT) FROM {_STEP('profile_missing')} "
    f"UNION ALL SELECT 'duplicate_rows_removed', '', duplicate_rows FROM {_STEP('profile_duplicates')} "
    f"UNION ALL SELECT 'missing_values', col_name, missing FROM {_STEP('profile_missing')} WHERE missing > 0 "
    f"UNION ALL SELECT 'dropped_column', col_name, 1 FROM {_DROPPED} "
    f"UNION ALL SELECT 'selected_feature', col_name, 1 FROM {_STEP('correlation_selection')} WHERE action = 'kept'")
