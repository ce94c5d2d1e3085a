"""Evaluation aggregates (V1-V10) over a long prediction table
``(row_key, model, label, prediction[, score])``.

All models are scored together: the prediction table is reduced once to
confusion counts ``(model, label, prediction, n)`` (map-side combined, so
its size is models x classes^2 whatever the row count), and every
classification metric is arithmetic on that small table. Spark reuses the
one exchange wherever the counts appear in a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed metric names of the reference.
CLASSIFICATION_METRICS = ["Accuracy", "Precision", "Recall", "F1 Score", "ROC-AUC"]
REGRESSION_METRICS = ["MAE", "MSE", "RMSE", "R2"]
AUC_MAX_BUCKETS = 4096
AUC_ROWS_PER_BUCKET = 1_000_000
#: True classes in one strip of a confusion grid, about.
GRID_BLOCK = 64


def confusion_counts(pred: DataFrame) -> DataFrame:
    """(model, label, prediction, n). Counts are taken as they are, so what is
    derived from them may be given either."""
    if pred.columns == ["model", "label", "prediction", "n"]:
        return pred
    return pred.groupBy("model", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_table(pred: DataFrame) -> DataFrame:
    """Per (model, class): support, predicted, tp over the union of true and
    predicted classes. Each confusion cell emits a 'true class' and a
    'predicted class' row, so one ``groupBy`` gives all three counts: one
    pass over the confusion counts, no joins."""
    cc = confusion_counts(pred)
    zero = F.lit(0).cast("bigint")
    both = cc.select("model", F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")))))
    t = both.groupBy("model", "cls").agg(*[F.sum(c).cast("bigint").alias(c)
                                           for c in ("support", "predicted", "tp")])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    t = t.withColumn("precision", p.cast("double")).withColumn("recall", r.cast("double"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return t.withColumn("f1", f1.cast("double"))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """V1-V4: accuracy and weighted precision / recall / F1 per model."""
    t = class_table(pred)
    n = F.sum("support")
    return t.groupBy("model").agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("support") * F.col("precision")) / n).alias("precision"),
        (F.sum(F.col("support") * F.col("recall")) / n).alias("recall"),
        (F.sum(F.col("support") * F.col("f1")) / n).alias("f1"))


def roc_auc(pred: DataFrame, buckets: int | None = None) -> DataFrame:
    """V5: exact ROC-AUC (ties count half) per model with scores on exactly
    two classes {0, 1}; other models get null.

    One small pre-job reads, per model, an approximate distinct count of the
    scores (and quantile bounds where a model has more than one range). The main query is a single chain over one
    scan of the predictions: collapse to ``(model, score, pos, neg)``, cut
    the distinct scores into ranges by the bounds (a broadcast of a few
    thousand numbers per model), a window per (model, range) for the
    negatives below each score, per-range totals, and a short window over
    ranges for the negatives of all earlier ranges:
    AUC = (sum_rows pos * (below_in_range + neg / 2) + sum_ranges off * pos_range) / (P * N)."""
    spark = pred.sparkSession
    pre = pred.groupBy("model").agg(F.approx_count_distinct("score", 0.05).alias("nd")).collect()
    want = {r["model"]: (buckets if buckets is not None
                         else int(min(AUC_MAX_BUCKETS, max(1, r["nd"] // AUC_ROWS_PER_BUCKET)))) for r in pre}
    bounds = {m: [] for m in want}
    wide = [m for m, b in want.items() if b > 1]
    if wide:
        # quantile bounds only for models with more than one range of scores
        probs = [i / AUC_MAX_BUCKETS for i in range(1, AUC_MAX_BUCKETS)]
        for r in (pred.where(F.col("model").isin(wide)).groupBy("model")
                  .agg(F.percentile_approx("score", probs, 10_000).alias("q")).collect()):
            qs, b = r["q"], want[r["model"]]
            if qs:
                bounds[r["model"]] = sorted(set(qs[int(len(qs) * i / b)] for i in range(1, b)))
    models = spark.createDataFrame([(m, bounds[m]) for m in want], "model string, bounds array<double>")

    col = pred.where(F.col("score").isNotNull()).groupBy("model", "score").agg(
        F.sum((F.col("label") == 1).cast("bigint")).alias("pos"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("neg"),
        F.sum(((F.col("label") != 0) & (F.col("label") != 1)).cast("bigint")).alias("other"))
    col = col.join(F.broadcast(models), "model").withColumn(
        "b", F.size(F.filter("bounds", lambda x: x < F.col("score")))).drop("bounds")
    w = Window.partitionBy("model", "b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    per_range = (col.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
                 .groupBy("model", "b").agg(
                     F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("inner"),
                     F.sum("pos").alias("pb"), F.sum("neg").alias("nb"), F.sum("other").alias("ob")))
    wb = Window.partitionBy("model").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumn("off", F.coalesce(F.sum("nb").over(wb), F.lit(0)))
    agg = per_range.groupBy("model").agg(
        (F.sum("inner") + F.sum(F.col("off") * F.col("pb"))).alias("num"),
        F.sum("pb").alias("P"), F.sum("nb").alias("N"), F.sum("ob").alias("O"))
    auc = F.when((F.col("O") == 0) & (F.col("P") > 0) & (F.col("N") > 0),
                 F.col("num") / (F.col("P") * F.col("N")))
    return models.select("model").join(agg.select("model", auc.cast("double").alias("roc_auc")),
                                       "model", "left")


def _classes(counts: DataFrame) -> DataFrame:
    """(model, cls): sorted union of true and predicted classes, one row each."""
    return counts.select("model", F.explode(F.array("label", "prediction")).alias("cls")).distinct()


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """V6: every (true, predicted) cell over the sorted union of classes,
    zeros kept; one pass over the predictions. The grid is built from class
    rows: true classes are dealt into blocks of ``GRID_BLOCK``, predicted ones
    sent to every block, so a task holds a strip of a model's grid, never
    all of it; the counts that exist are joined to it."""
    counts = confusion_counts(pred)
    classes = _classes(counts)
    blocks = F.greatest(F.ceil(F.count("*").over(Window.partitionBy("model")) / GRID_BLOCK), F.lit(1))
    dealt = classes.withColumn("blocks", blocks.cast("int"))
    true = dealt.select("model", F.col("cls").alias("label"), F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    every = dealt.select("model", F.col("cls").alias("prediction"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    grid = true.join(every, ["model", "block"]).drop("block")
    return grid.join(counts, ["model", "label", "prediction"], "left") \
        .select("model", "label", "prediction", F.coalesce("n", F.lit(0).cast("bigint")).alias("count"))


def confusion_json(pred: DataFrame) -> DataFrame:
    """The matrix of each model as JSON text, rows = true classes. A row
    is put together first, so no aggregate holds all cells as structs."""
    value = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    rows = confusion_matrix(pred).groupBy("model", "label").agg(
        F.array_join(value(F.struct("prediction", F.col("count").alias("v"))), ",").alias("line"))
    whole = F.array_join(value(F.struct("label", F.concat(F.lit("["), "line", F.lit("]")).alias("v"))), ",")
    return rows.groupBy("model").agg(F.concat(F.lit("["), whole, F.lit("]")).alias("matrix"))


def classification_report(pred: DataFrame) -> DataFrame:
    """V7: per class precision / recall / F1 / support, then accuracy,
    macro and weighted averages (as in the usual text report). Summary
    rows come from windows over the per-class rows of each model."""
    t = class_table(pred)
    w = Window.partitionBy("model")
    first = F.row_number().over(Window.partitionBy("model").orderBy("cls")) == 1
    t = t.select("*", F.sum("support").over(w).alias("n_all"), F.sum("tp").over(w).alias("tp_all"),
                 F.avg("precision").over(w).alias("mp"), F.avg("recall").over(w).alias("mr"),
                 F.avg("f1").over(w).alias("mf"),
                 F.sum(F.col("support") * F.col("precision")).over(w).alias("wp"),
                 F.sum(F.col("support") * F.col("recall")).over(w).alias("wr"),
                 F.sum(F.col("support") * F.col("f1")).over(w).alias("wf"), first.alias("first"))
    nulld = F.lit(None).cast("double")
    n = F.col("n_all").cast("bigint")

    def row(kind, cls, p, r, f, sup):
        return F.struct(F.lit(kind).alias("row_type"), cls.alias("class_value"), p.alias("precision"),
                        r.alias("recall"), f.alias("f1"), sup.alias("support"))
    own = row("class", F.col("cls"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"))
    summary = F.array(row("accuracy", nulld, nulld, nulld, F.col("tp_all") / F.col("n_all"), n),
                      row("macro avg", nulld, F.col("mp"), F.col("mr"), F.col("mf"), n),
                      row("weighted avg", nulld, F.col("wp") / F.col("n_all"), F.col("wr") / F.col("n_all"),
                          F.col("wf") / F.col("n_all"), n))
    rows = F.when(F.col("first"), F.concat(F.array(own), summary)).otherwise(F.array(own))
    return t.select("model", F.inline(rows))


def report_text(pred: DataFrame) -> DataFrame:
    """The class report of each model as the usual text table, two
    decimals, classes by ascending value (whole numbers without a point)."""
    t = classification_report(pred)
    whole = F.col("class_value") == F.floor("class_value")
    name = F.when(F.col("row_type") != "class", F.col("row_type")).when(whole, F.col("class_value").cast("bigint").cast("string")) \
        .otherwise(F.col("class_value").cast("string"))
    # Fixed order and texts of that table.
    kind = F.element_at(F.create_map(*[F.lit(x) for p in zip(["class", "accuracy", "macro avg", "weighted avg"], range(4)) for x in p]), F.col("row_type"))
    width = F.greatest(F.lit(len("weighted avg")), F.max(F.length("name")).over(Window.partitionBy("model")))
    t = t.withColumn("name", name).withColumn("kind", kind)
    two = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string("%.2f", F.round(c, 6)))
    cells = [F.lpad(two(c), 9, " ") for c in ("precision", "recall", "f1")] + [F.lpad(F.col("support").cast("string"), 9, " ")]
    pad = lambda c: F.concat(F.repeat(F.lit(" "), F.greatest(F.col("width") - F.length(c), F.lit(0))), c)
    t = t.withColumn("width", width)
    line = F.concat_ws(" ", F.concat(pad(F.col("name")), F.lit(" ")), *cells)
    t = t.select("model", "kind", "class_value", "width", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("kind", "class_value", "line"))), lambda x: F.when(x["kind"] == 1, F.concat(F.lit("\n"), x["line"])).otherwise(x["line"]))
    head = F.concat(F.repeat(F.lit(" "), F.max("width") + 1), *[F.concat(F.lit(" "), F.lit(h.rjust(9))) for h in ("precision", "recall", "f1-score", "support")])
    return t.groupBy("model").agg(F.concat(head, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("report"))


def regression_metrics(pred: DataFrame) -> DataFrame:
    """V8 + V9: MAE, MSE, RMSE, R2 per model, one aggregate."""
    e = F.col("label") - F.col("prediction")
    g = pred.groupBy("model").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                                  F.var_pop("label").alias("vy"))
    return g.select("model", "mae", "mse", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"))


def evaluation_long(pred: DataFrame, problem_type: str = "classification") -> DataFrame:
    """S5 rows: (model, metric, value, value_json) with the reference's metric names."""
    if problem_type == "regression":
        m = regression_metrics(pred)
        return m.select("model", F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(c).alias("value"),
                     F.lit(None).cast("string").alias("value_json"))
            for n, c in zip(REGRESSION_METRICS, ["mae", "mse", "rmse", "r2"])])))
    counts = confusion_counts(pred).persist()     # read by four tables below
    m = classification_metrics(counts).join(roc_auc(pred), "model", "left") \
        .join(confusion_json(counts), "model", "left").join(report_text(counts), "model", "left")
    names = zip(CLASSIFICATION_METRICS, ["accuracy", "precision", "recall", "f1", "roc_auc"])
    structs = [F.struct(F.lit(n).alias("metric"), F.col(c).alias("value"),
                        F.lit(None).cast("string").alias("value_json")) for n, c in names]
    structs.append(F.struct(F.lit("Confusion Matrix").alias("metric"), F.lit(None).cast("double").alias("value"),
                            F.col("matrix").alias("value_json")))
    structs.append(F.struct(F.lit("Classification Report").alias("metric"), F.lit(None).cast("double").alias("value"),
                            F.col("report").alias("value_json")))
    return m.select("model", F.inline(F.array(*structs)))
