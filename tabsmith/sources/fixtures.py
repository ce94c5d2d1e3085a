"""Test inputs derived from the driver tables.

The driver tables hold no nulls, no duplicate rows and no model output, so
three derived views give the operators work to do (see FIXTURES.md):

* ``dirty_orders``   - orders with nulls, outliers, copies and all-null rows
* ``labelled_docs``  - documents joined to labels, with text features
* ``fixed_predictions`` - rule-made model outputs, binary / multiclass / regression

Each view is one SQL text with ``{table}`` placeholders. Spark runs it with
``spark.sql(text, table=DataFrame)``; the DuckDB oracle runs the same text
with the placeholders replaced by the pre-registered view names. Where the two
dialects differ (text splitting) two texts are kept side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

DIRTY_BASE = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50
            ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100 + 1
            ELSE o_totalprice * 2 + 1 END AS price_copy,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 90 AS DOUBLE) END AS age,
       CAST(1.0 AS DOUBLE) AS const_col,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status,
       o_orderpriority AS priority,
       CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS member,
       concat('city_', CAST(o_custkey % 12 AS STRING)) AS city,
       concat('note ', CAST(o_orderkey AS STRING)) AS note,
       CAST(NULL AS STRING) AS empty_col,
       CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS target
FROM {orders}
"""

DIRTY_COLUMNS = ["id", "price", "price_copy", "age", "const_col", "status", "priority",
                 "member", "city", "note", "empty_col", "target"]

# all copies (id % 50 = 0) and all-null rows (id % 500 = 1) inject dirt;
# every order row is still read and kept.
DIRTY_UNION = ("SELECT * FROM dirty_base\n"
               "UNION ALL SELECT * FROM dirty_base WHERE id % 50 = 0\n"
               "UNION ALL SELECT "
               + ", ".join(f"CASE WHEN id < 0 THEN {c} END AS {c}" for c in DIRTY_COLUMNS)
               + " FROM dirty_base WHERE id % 500 = 1")

LABELLED_DOCS_SPARK = """
SELECT d.doc_id, d.lang, d.source, d.n_chars,
       size(split(d.text, ' ')) AS n_words,
       round(size(array_distinct(split(d.text, ' '))) / size(split(d.text, ' ')), 6) AS distinct_ratio,
       size(split(d.text, '\\n')) - 1 AS n_lines,
       l.quality
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

LABELLED_DOCS_DUCKDB = """
SELECT d.doc_id, d.lang, d.source, d.n_chars,
       CAST(len(string_split(d.text, ' ')) AS INTEGER) AS n_words,
       round(len(list_distinct(string_split(d.text, ' '))) / len(string_split(d.text, ' ')), 6) AS distinct_ratio,
       CAST(len(string_split(d.text, chr(10))) - 1 AS INTEGER) AS n_lines,
       l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

# Rule-made predictions. rule_a carries signal with tied scores, rule_b is
# noise, rule_c never predicts class 1 (zero division in precision).
FIXED_PREDICTIONS_BINARY = """
WITH s AS (
  SELECT o_orderkey AS row_key, 'rule_a' AS model,
         CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label,
         least(CAST(floor(o_totalprice / 3000) AS DOUBLE) / 100, CAST(1 AS DOUBLE)) AS score
  FROM {orders}
  UNION ALL
  SELECT o_orderkey, 'rule_b',
         CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
         CAST((o_custkey * 37 + o_orderkey) % 100 AS DOUBLE) / 100
  FROM {orders}
  UNION ALL
  SELECT o_orderkey, 'rule_c',
         CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
         CAST(o_orderkey % 7 AS DOUBLE) / 20
  FROM {orders})
SELECT row_key, model, label,
       CASE WHEN score >= 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS prediction,
       score
FROM s
"""

FIXED_PREDICTIONS_MULTICLASS = """
WITH s AS (
  SELECT o_orderkey AS row_key, o_orderkey, o_custkey,
         CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE) AS label
  FROM {orders})
SELECT row_key, 'rule_a' AS model, label,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST((CAST(label AS INT) + 1) % 3 AS DOUBLE) ELSE label END AS prediction,
       CAST(NULL AS DOUBLE) AS score
FROM s
UNION ALL SELECT row_key, 'rule_b', label, CAST(o_custkey % 3 AS DOUBLE), CAST(NULL AS DOUBLE) FROM s
UNION ALL SELECT row_key, 'rule_c', label, CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM s
"""

FIXED_PREDICTIONS_REGRESSION = """
SELECT o_orderkey AS row_key, 'rule_a' AS model, o_totalprice AS label,
       o_totalprice + CAST(o_custkey % 100 AS DOUBLE) - 50 AS prediction
FROM {orders}
UNION ALL SELECT o_orderkey, 'rule_b', o_totalprice, o_totalprice * CAST(1.1 AS DOUBLE) FROM {orders}
UNION ALL SELECT o_orderkey, 'rule_c', o_totalprice, CAST(150000 AS DOUBLE) FROM {orders}
"""

# A second set of rule outputs standing in for "tuned" models (G8):
# rule_a gets a better threshold, rule_b a worse one, rule_c stays the same.
FIXED_PREDICTIONS_TUNED = """
WITH s AS (
  SELECT o_orderkey AS row_key, 'rule_a' AS model,
         CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label,
         CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS prediction
  FROM {orders}
  UNION ALL
  SELECT o_orderkey, 'rule_b',
         CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
         CASE WHEN (o_custkey * 37 + o_orderkey) % 100 >= 90 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  FROM {orders}
  UNION ALL
  SELECT o_orderkey, 'rule_c',
         CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
         CAST(0 AS DOUBLE)
  FROM {orders})
SELECT row_key, model, label, prediction, CAST(NULL AS DOUBLE) AS score FROM s
"""

# Targets that a rule decides with a wide margin, so that every model family
# must find it: two classes, three classes, and a number near four levels.
RULE_ORDERS = """
SELECT o_orderkey,
       CASE WHEN o_totalprice > 150000 THEN CAST(8 AS DOUBLE) ELSE CAST(-8 AS DOUBLE) END + CAST(o_custkey % 7 AS DOUBLE) / 10 AS signal,
       CAST(o_custkey % 3 AS DOUBLE) * 5 + CAST(o_orderkey % 5 AS DOUBLE) / 20 AS first_axis,
       CASE WHEN o_custkey % 3 = 1 THEN CAST(9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(o_orderkey % 3 AS DOUBLE) / 20 AS second_axis,
       CAST(o_custkey % 4 AS DOUBLE) + CAST(o_orderkey % 7 AS DOUBLE) / 100 AS step,
       o_orderpriority AS priority,
       CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS target,
       concat('class_', CAST(o_custkey % 3 AS STRING)) AS family,
       1000 + 100 * CAST(o_custkey % 4 AS DOUBLE) + CAST(o_orderkey % 40 AS DOUBLE) / 2 AS amount
FROM {orders}
"""

# Raw importances per (model, feature), computed from lineitem so that the
# table grows with the data: 12 features, two always zero, rule_c all zero.
IMPORTANCE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
                       "l_orderkey", "l_partkey", "l_suppkey", "flag_r", "status_o", "zero_a", "zero_b"]

IMPORTANCE_INPUT = """
WITH f AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
         CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_partkey AS DOUBLE) AS l_partkey,
         CAST(l_suppkey AS DOUBLE) AS l_suppkey,
         CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS flag_r,
         CASE WHEN l_linestatus = 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS status_o,
         CAST(0 AS DOUBLE) AS zero_a, CAST(0 AS DOUBLE) AS zero_b
  FROM {lineitem}),
m AS (
  SELECT """ + ",\n         ".join(
    f"stddev_pop({c}) / (1 + abs(avg({c}))) AS a_{c}, abs(avg({c})) / (1 + stddev_pop({c})) AS b_{c}"
    for c in IMPORTANCE_FEATURES) + """
  FROM f)
""" + "\nUNION ALL\n".join(
    f"SELECT 'rule_a' AS model, '{c}' AS feature, a_{c} AS importance FROM m\n"
    f"UNION ALL SELECT 'rule_b', '{c}', b_{c} FROM m\n"
    f"UNION ALL SELECT 'rule_c', '{c}', CAST(0 AS DOUBLE) FROM m"
    for c in IMPORTANCE_FEATURES)


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = "WITH dirty_base AS (" + DIRTY_BASE + ")\n" + DIRTY_UNION
    return spark.sql(text, orders=orders)


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LABELLED_DOCS_SPARK, documents=table(spark, sf_dir, "documents"),
                     labels=table(spark, sf_dir, "labels"))


def fixed_predictions(spark: SparkSession, sf_dir: str, kind: str = "binary") -> DataFrame:
    text = {"binary": FIXED_PREDICTIONS_BINARY, "multiclass": FIXED_PREDICTIONS_MULTICLASS,
            "regression": FIXED_PREDICTIONS_REGRESSION, "tuned": FIXED_PREDICTIONS_TUNED}[kind]
    return spark.sql(text, orders=table(spark, sf_dir, "orders"))


def rule_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RULE_ORDERS, orders=table(spark, sf_dir, "orders"))


def importance_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IMPORTANCE_INPUT, lineitem=table(spark, sf_dir, "lineitem"))


# ---- DuckDB side: the same texts as CTEs over the pre-registered views ----

def _duck(text: str) -> str:
    return text.format(orders="orders", lineitem="lineitem", documents="documents", labels="labels")


def duck_ctes(*names: str) -> str:
    """``WITH`` clause defining the named fixtures for an oracle query."""
    parts = []
    for n in names:
        if n == "dirty_orders":
            parts.append("dirty_base AS (" + _duck(DIRTY_BASE) + ")")
            parts.append("dirty_orders AS (" + DIRTY_UNION + ")")
        elif n == "labelled_docs":
            parts.append("labelled_docs AS (" + LABELLED_DOCS_DUCKDB + ")")
        elif n == "fixed_predictions":
            parts.append("fixed_predictions AS (" + _duck(FIXED_PREDICTIONS_BINARY) + ")")
        elif n == "fixed_predictions_multiclass":
            parts.append("fixed_predictions_multiclass AS (" + _duck(FIXED_PREDICTIONS_MULTICLASS) + ")")
        elif n == "fixed_predictions_regression":
            parts.append("fixed_predictions_regression AS (" + _duck(FIXED_PREDICTIONS_REGRESSION) + ")")
        elif n == "fixed_predictions_tuned":
            parts.append("fixed_predictions_tuned AS (" + _duck(FIXED_PREDICTIONS_TUNED) + ")")
        elif n == "rule_orders":
            parts.append("rule_orders AS (" + _duck(RULE_ORDERS) + ")")
        elif n == "importance_input":
            parts.append("importance_input AS (" + _duck(IMPORTANCE_INPUT) + ")")
        else:
            raise KeyError(n)
    return "WITH " + ",\n".join(parts) + "\n"
