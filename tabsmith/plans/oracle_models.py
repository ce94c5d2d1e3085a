"""DuckDB oracles for the model keys whose answer SQL can reproduce
exactly: Gaussian naive Bayes, one-feature least squares and exact KNN
(a cross join is fine for the oracle; the Spark side never builds pairs)."""

from __future__ import annotations

from tabsmith.sources.fixtures import duck_ctes

MODEL_ORACLE: dict[str, str] = {}

_STRAT_DOCS = ("split AS (SELECT *, CASE WHEN rn <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS part FROM ("
               "SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rn, "
               "count(*) OVER (PARTITION BY quality) AS n FROM labelled_docs))")
_F = ["n_chars", "n_words", "distinct_ratio", "n_lines"]
_NB = (duck_ctes("labelled_docs") + ",\n" + _STRAT_DOCS + ",\n"
       "tr AS (SELECT * FROM split WHERE part = 'train'),\n"
       "eps AS (SELECT 1e-9 * greatest(" + ", ".join(f"var_pop({c})" for c in _F) + ") AS e FROM tr),\n"
       "cls AS (SELECT quality, ln(count(*) / (SELECT count(*) FROM tr)) AS lp, "
       + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + (SELECT e FROM eps) AS v_{c}" for c in _F)
       + " FROM tr GROUP BY quality),\n"
       "sc AS (SELECT t.doc_id, t.quality, c.quality AS cls, c.lp + "
       + " + ".join(f"(-0.5 * ln(2 * pi() * c.v_{x}) - (t.{x} - c.m_{x}) * (t.{x} - c.m_{x}) / (2 * c.v_{x}))" for x in _F)
       + " AS s FROM split t JOIN cls c ON true WHERE t.part = 'test'),\n"
       "best AS (SELECT doc_id, quality, cls, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, cls) AS r FROM sc)\n")
MODEL_ORACLE["clf_gaussian_nb"] = _NB + ("SELECT doc_id, CAST(quality AS DOUBLE) AS label, "
                                         "CAST(cls AS DOUBLE) AS prediction FROM best WHERE r = 1")

_RAND_DOCS = ("split AS (SELECT *, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM ("
              "SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rn, "
              "count(*) OVER () AS n FROM labelled_docs))")
MODEL_ORACLE["reg_linear"] = (
    duck_ctes("labelled_docs") + ",\n" + _RAND_DOCS + ",\n"
    "fit AS (SELECT regr_slope(n_chars, n_words) AS b, regr_intercept(n_chars, n_words) AS a FROM split "
    "WHERE part = 'train')\n"
    "SELECT doc_id, round(a + b * n_words, 4) + CAST(0 AS DOUBLE) AS prediction FROM split, fit WHERE part = 'test'")

_EMB = ("WITH split AS (SELECT *, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM ("
        "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY md5('42|' || "
        "CAST(vec_id AS VARCHAR))) AS rn, count(*) OVER () AS n FROM embeddings)),\n"
        "d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label AS tl, list_distance(q.e, t.e) AS dist "
        "FROM split q JOIN split t ON q.part = 'test' AND t.part = 'train'),\n"
        "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rk FROM d) "
        "WHERE rk <= 5)\n")
MODEL_ORACLE["clf_knn"] = (_EMB + ", v AS (SELECT qid, tl, count(*) AS c FROM nn GROUP BY qid, tl),\n"
                           "p AS (SELECT qid, tl, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tl) AS r FROM v)\n"
                           "SELECT qid AS vec_id, CAST(tl AS DOUBLE) AS prediction FROM p WHERE r = 1")
MODEL_ORACLE["reg_knn"] = (_EMB + "SELECT qid AS vec_id, round(avg(tl), 6) + CAST(0 AS DOUBLE) AS prediction "
                           "FROM nn GROUP BY qid")

# ---- decisions of the end-to-end classification run on labelled_docs ----
# (stratified split on quality, profile of the training rows, target and the
# doc_id key protected). One-hot column names are the sorted lang levels
# after the first, as found in the data.
_LANG = ["en", "es", "fr"]
_NUM = ["n_chars", "n_words", "distinct_ratio", "n_lines"]
_INPUTS = _NUM + [f"lang_{v}" for v in _LANG]
_RUN = (duck_ctes("labelled_docs") + ",\n" + _STRAT_DOCS + ",\n"
        "tr AS (SELECT * FROM split WHERE part = 'train'),\n"
        "card AS (SELECT c, CAST(d AS DOUBLE) / n AS ratio, d FROM ("
        "SELECT 'lang' AS c, count(DISTINCT lang) AS d, count(*) AS n FROM tr UNION ALL "
        "SELECT 'source', count(DISTINCT source), count(*) FROM tr)),\n"
        "dropped AS (SELECT c FROM card WHERE ratio > 0.15),\n"
        "enc AS (SELECT *, " + ", ".join(f"CAST(lang = '{v}' AS DOUBLE) AS lang_{v}" for v in _LANG) + " FROM tr),\n"
        "pairs AS (" + " UNION ALL ".join(
            f"SELECT '{a}' AS col_i, '{b}' AS col_j, abs(corr({a}, {b})) AS r FROM enc"
            for i, a in enumerate(_INPUTS) for b in _INPUTS[i + 1:]) + "),\n"
        "vars AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, var_pop({c}) AS v FROM enc" for c in _INPUTS) + "),\n"
        "corr_drop AS (SELECT col_j AS c FROM pairs WHERE col_i IN (SELECT c FROM vars WHERE v > 0) "
        "AND col_j IN (SELECT c FROM vars WHERE v > 0) GROUP BY col_j HAVING max(r) > 0.9),\n"
        "selected AS (SELECT c FROM vars WHERE v > 0 AND c NOT IN (SELECT c FROM corr_drop))\n")
MODEL_ORACLE["preprocessing_report"] = _RUN + (
    "SELECT 'cleaning' AS stage, c AS col_name, 'Removed (Unique ratio > 0.15)' AS action FROM dropped "
    "UNION ALL SELECT 'encoding', c, CASE WHEN d = 2 THEN 'Label Encoding' ELSE 'One Hot Encoding' END FROM card "
    "WHERE c NOT IN (SELECT c FROM dropped) AND d BETWEEN 2 AND 10 "
    "UNION ALL SELECT 'scaling', c, 'Standard Scaling' FROM vars "
    "UNION ALL SELECT 'selection', c, 'Removed (Variance <= 0.0)' FROM card "
    "WHERE c NOT IN (SELECT c FROM dropped) AND (d < 2 OR d > 10) "
    "UNION ALL SELECT 'selection', c, 'Removed (Variance <= 0.0)' FROM vars WHERE v = 0 "
    "UNION ALL SELECT 'selection', c, 'Removed (Correlation > 0.9)' FROM corr_drop")
MODEL_ORACLE["dataset_report"] = _RUN + (
    "SELECT 'rows' AS item, '' AS col_name, CAST(count(*) AS BIGINT) AS value FROM labelled_docs "
    "UNION ALL SELECT 'columns', '', CAST(8 AS BIGINT) "
    "UNION ALL SELECT 'missing_values_total', '', CAST(8 * count(*) - (" + " + ".join(
        f"count({c})" for c in ["doc_id", "lang", "source", "n_chars", "n_words", "distinct_ratio", "n_lines",
                                 "quality"]) + ") AS BIGINT) FROM labelled_docs "
    "UNION ALL SELECT 'duplicate_rows_removed', '', CAST(count(*) - (SELECT count(*) FROM "
    "(SELECT DISTINCT * FROM labelled_docs)) AS BIGINT) FROM labelled_docs "
    "UNION ALL SELECT 'dropped_column', c, CAST(1 AS BIGINT) FROM dropped "
    "UNION ALL SELECT 'selected_feature', c, CAST(1 AS BIGINT) FROM selected")
