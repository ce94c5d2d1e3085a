"""The data-dependent preparation plan: clean -> impute -> encode ->
target -> scale -> select -> split, compiled to one projection.

``prepare`` runs the profile jobs (three or four small aggregates, nothing
but statistics collected) and returns a ``PrepModel``. The model turns any
frame with the raw columns into ``(keys..., label, features...)`` with a
single ``select`` whose SQL text is also the saved scoring transform.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import DEFAULT_SEED, nan_to_null, row_hash
from tabsmith.operators import clean as C
from tabsmith.operators import encode as E
from tabsmith.operators import impute as M
from tabsmith.operators import scale as N
from tabsmith.operators import split as D
from tabsmith.operators.classes import class_dictionary, labelled
from tabsmith.plans.profile import TableProfile, is_numeric_type, profile_table, q
from tabsmith.plans.sqltext import ident, literal

ROW_KEY = "__row_key"
# apart from raw columns, one of which may be called label
LABEL = "__target_index"


@dataclass
class PrepConfig:
    target: str
    keys: list[str] = field(default_factory=list)
    id_names: list[str] = field(default_factory=lambda: list(C.ID_COLUMN_NAMES))
    cardinality_threshold: float = C.CARDINALITY_THRESHOLD
    variance_threshold: float = N.VARIANCE_THRESHOLD
    correlation_threshold: float = N.CORRELATION_THRESHOLD
    test_size: float = D.TEST_SIZE
    seed: int = DEFAULT_SEED
    fit_on: str = "train"            # "train" (no leakage) or "all" (reference order)
    problem_type: str | None = None  # None: inferred (T2)
    # cut lineage of the deduplicated frame in the reliable checkpoint folder;
    # None: yes on a cluster, no in local mode
    checkpoint: bool | None = None


@dataclass
class PrepModel:
    config: PrepConfig
    target: str
    keys: list[str]
    raw_columns: list[str]
    name_map: dict[str, str]
    problem_type: str
    classes: DataFrame | None        # (value, label, n) of a classification target
    n_classes: int
    dropped: list[tuple[str, str]]
    numeric_fills: dict
    categorical_fills: dict
    enc_plan: list[tuple[str, int, str]]
    input_features: list[str]
    input_sql: dict[str, str]
    scaling: dict[str, N.Moments]
    variance_report: list
    correlation_report: list
    selected: list[str]
    warnings: list[str] = field(default_factory=list)
    counts: dict = field(default_factory=dict)
    float_columns: list[str] = field(default_factory=list)   # raw names whose NaN counts as null

    # ---- compiled projection ------------------------------------------
    def named_keys(self) -> list[str]:
        """The key columns that the user named: they are in raw rows."""
        return [C.clean_name(k) for k in self.config.keys]

    def with_label(self, df: DataFrame) -> DataFrame:
        """``df`` (renamed columns) with ``__label``: the class's index, or the target as a number."""
        if self.problem_type == "classification":
            return labelled(df, self.target, self.classes, LABEL, self.n_classes)
        return df.withColumn(LABEL, q(self.target).cast("double"))

    def class_names(self) -> DataFrame:
        """(label, name): the classes as the text that Spark writes for them."""
        return self.classes.select("label", F.col("value").cast("string").alias("name"))

    def feature_columns(self) -> list[str]:
        """Column names of the selected features in compiled frames. They are
        positions: a level may hold any character, so names made of levels
        are for reports only (``selected``)."""
        return [f"f{i}" for i in range(len(self.selected))]

    def feature_sql(self) -> list[tuple[str, str]]:
        """(column, SQL) of every selected scaled feature over the renamed raw columns."""
        out = []
        for name, c in zip(self.feature_columns(), self.selected):
            inner = self.input_sql[c]
            m = self.scaling[c]
            if m.mean is None:
                out.append((name, f"CAST({inner} AS DOUBLE)"))
            elif not m.std:
                out.append((name, f"(CAST({inner} AS DOUBLE) - {literal(float(m.mean))})"))
            else:
                out.append((name, f"((CAST({inner} AS DOUBLE) - {literal(float(m.mean))}) / {literal(float(m.std))})"))
        return out

    def statement(self) -> str:
        """SQLTransformer statement over raw rows: renames, fills, encodes, scales, selects."""
        # scoring frames carry no target: only the other raw columns are read;
        # NaN becomes null as in training, so it is filled alike
        read = lambda c: f"nullif({ident(c)}, CAST('NaN' AS DOUBLE))" if c in self.float_columns else ident(c)
        rename = ", ".join(f"{read(old)} AS {ident(new)}" for old, new in self.name_map.items()
                           if old in self.raw_columns and new != self.target)
        # a key that the run made itself is not in the raw rows
        cols = [ident(k) for k in self.named_keys()]
        cols += [f"{e} AS {ident(n)}" for n, e in self.feature_sql()]
        return f"SELECT {', '.join(cols)} FROM (SELECT {rename} FROM __THIS__)"

    def transform(self, df: DataFrame, with_label: bool = True) -> DataFrame:
        renamed = rename_raw(df, self.name_map)
        exprs = [q(k) for k in self.named_keys()]
        if with_label:
            renamed = self.with_label(renamed)
            exprs.append(F.col(LABEL).alias("label"))
        # display names here: this frame is for reading, models take the positional one
        exprs += [F.expr(e).alias(c) for c, (_, e) in zip(self.selected, self.feature_sql())]
        return renamed.select(*exprs)

    def report_rows(self) -> list[tuple[str, str, str]]:
        """Q3: (stage, column, action) for every decision."""
        rows = [("cleaning", c, a) for c, a in self.dropped]
        rows += [("missing", c, t) for c, t in M.missing_value_report(self.numeric_fills, self.categorical_fills)]
        rows += [("encoding", c, t) for c, t in E.encoding_report(self.enc_plan)]
        rows += [("scaling", c, N.STANDARD_TEXT) for c in self.input_features if c in self.scaling]
        rows += [("selection", c, t) for c, t in N.feature_selection_report(self.variance_report,
                                                                            self.correlation_report)]
        rows += [("warning", "", w) for w in self.warnings]
        return rows

    def preprocessing_report(self, spark) -> DataFrame:
        """Q3: (stage, column, action)."""
        return spark.createDataFrame(self.report_rows(), "stage string, col_name string, action string")

    def dataset_report(self, spark) -> DataFrame:
        """Q2: (item, col_name, value)."""
        c = self.counts
        rows = [("rows", "", c["raw_rows"]), ("columns", "", c["raw_columns"]),
                ("missing_values_total", "", c["missing_total"]),
                ("duplicate_rows_removed", "", c["duplicates_removed"])]
        rows += [("missing_values", col, n) for col, n in c["missing"].items() if n]
        rows += [("dropped_column", col, 1) for col, _ in self.dropped]
        rows += [("selected_feature", col, 1) for col in self.selected]
        return spark.createDataFrame(rows, "item string, col_name string, value bigint")


def rename_raw(df: DataFrame, name_map: dict[str, str]) -> DataFrame:
    return nan_to_null(df.select(*[q(c).alias(name_map.get(c, c)) for c in df.columns]))


def _repeated(df: DataFrame, key: str) -> bool:
    """Whether rows share a value of ``key`` (or several have none)."""
    return bool(df.groupBy(q(key)).count().where("count > 1").take(1))


def materialize(df: DataFrame, checkpoint: bool) -> DataFrame:
    """Cache a frame that later jobs scan several times. With ``checkpoint``
    the data is written to the reliable checkpoint folder, so a lost
    executor never forces a replay of the dedup shuffle."""
    if checkpoint:
        from tabsmith.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Cleaned:
    frame: DataFrame            # deduplicated, no empty rows, no null target, with __part
    raw_rows: int
    raw_columns: int
    raw_missing: dict
    duplicates_removed: int
    empty_rows_removed: int
    null_target_removed: int
    name_map: dict
    keys: list[str]
    warnings: list[str]
    classes: DataFrame | None
    n_classes: int
    problem_type: str
    float_columns: list[str] = field(default_factory=list)


def clean_and_split(df: DataFrame, cfg: PrepConfig) -> Cleaned:
    """C1-C3, T2 and D1-D3. One scan of the raw input (the dedup shuffle);
    then small aggregates over the cached distinct rows: counts, problem
    type, class counts, two or three radix levels of the split."""
    name_map = {c: C.clean_name(c) for c in df.columns}
    C.clean_column_names(df)  # raises on collisions
    target = C.clean_name(cfg.target)
    d0 = rename_raw(df, name_map)
    if target not in d0.columns:
        raise E.TargetMissing(f"Target column '{cfg.target}' was not found.")
    cols = d0.columns
    # C2 as a grouped count: one shuffle whose cached output (one row per
    # distinct row, weighted by its copies) also yields the raw row and null
    # counts, so the raw input is scanned only once
    grouped = d0.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("__copies"))
    keys = [C.clean_name(k) for k in cfg.keys]
    if len(keys) != 1:
        # rows are told apart by their content; named keys are columns that are no features
        grouped = grouped.withColumn(ROW_KEY, row_hash(d0))
        keys = [ROW_KEY]
    use_ckpt = cfg.checkpoint
    if use_ckpt is None:
        use_ckpt = not df.sparkSession.sparkContext.master.startswith("local")
    grouped = materialize(grouped, use_ckpt)
    if keys != [ROW_KEY] and _repeated(grouped, keys[0]):
        grouped, keys = grouped.withColumn(ROW_KEY, row_hash(d0)), [ROW_KEY]
    allnull = C.all_null_condition(cols)
    copies = F.col("__copies")
    cnt = grouped.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("n"),
                      F.count_if(allnull).alias("empty"),
                      F.count_if(q(target).isNull() & ~allnull).alias("nt"),
                      *[F.coalesce(F.sum(F.when(q(c).isNull(), copies)), F.lit(0)).alias(f"m{i}")
                        for i, c in enumerate(cols)]).collect()[0]
    raw = {"__n": int(cnt["raw"])}
    raw_missing = {c: int(cnt[f"m{i}"]) for i, c in enumerate(cols)}
    dedup = grouped.drop("__copies")
    cleaned = dedup.where(~allnull).where(q(target).isNotNull())
    problem = cfg.problem_type or E.infer_problem_type(cleaned, target)
    classes = class_dictionary(cleaned, target) if problem == "classification" else None
    split, warnings = D.assign_split(cleaned, keys, target if problem == "classification" else None,
                                     stratify=problem == "classification", test_size=cfg.test_size,
                                     seed=cfg.seed, classes=classes)
    split = materialize(split, False)
    split.count()               # fills the split cache, so the first copy can go
    grouped.unpersist()
    return Cleaned(split, int(raw["__n"]), len(cols), raw_missing, int(raw["__n"]) - int(cnt["n"]),
                   int(cnt["empty"]), int(cnt["nt"]), name_map, keys, warnings, classes, 0 if classes is None else classes.count(), problem,
                   [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")])


def fit_plan(frame: DataFrame, cfg: PrepConfig, cl: Cleaned) -> PrepModel:
    """Profile the fitting rows and take every decision (C4-C6, M3-M4,
    E1-E3, N1, F1-F2)."""
    target = C.clean_name(cfg.target)
    keys = cl.keys
    fit_rows = frame.where(F.col("__part") == "train") if cfg.fit_on == "train" else frame
    body_cols = [c for c in frame.columns if c != "__part"]
    fit_rows = fit_rows.select(*[q(c) for c in body_cols])
    prof = profile_table(fit_rows, quantiles="missing")
    protect = [target] + [k for k in keys if k == ROW_KEY]
    dropped = C.cleaning_decisions(prof, protect, cfg.id_names, cfg.cardinality_threshold)
    gone = {c for c, _ in dropped} | set(keys) | {C.clean_name(k) for k in cfg.keys} | {target}
    features = [c for c in body_cols if c not in gone]
    nfill = M.numeric_fill_plan(prof, [c for c in features if prof.columns[c].kind == "numeric"])
    cfill = M.categorical_fill_plan(prof, [c for c in features if prof.columns[c].kind == "categorical"],
                                    fit_rows)
    enc = E.encoding_plan(prof, features)
    methods = {c: m for c, _, m in enc}

    # SQL of every post-encoding input feature over the renamed columns
    input_sql: dict[str, str] = {}
    tail: dict[str, str] = {}
    numeric_inputs: set[str] = set()
    for c in features:
        st = prof.columns[c]
        if st.kind == "other":
            continue
        base = ident(c)
        if c in nfill:
            base = M.fill_expression(c, nfill[c][0], "numeric")
        elif c in cfill:
            base = M.fill_expression(c, cfill[c][0], st.dtype)
        if st.kind == "numeric":
            input_sql[c] = base
            numeric_inputs.add(c)
        elif methods.get(c) == "label":
            input_sql[c] = E.label_expression(c, st.levels, st.dtype).replace(ident(c), f"({base})")
            numeric_inputs.add(c)
        elif methods.get(c) == "one_hot":
            for name, e in E.one_hot_expressions(c, st.levels, st.dtype):
                while name in tail or name in features:   # another column already has that name
                    name += "_"
                tail[name] = e.replace(ident(c), f"({base})")
                numeric_inputs.add(name)
        else:
            input_sql[c] = base        # leftover categorical: removed by F1
    input_sql.update(tail)
    input_features = list(input_sql)

    num_cols = [c for c in input_features if c in numeric_inputs]
    # positions as column names: display names may differ in case only or hold dots
    inner = {c: f"f{i}" for i, c in enumerate(num_cols)}
    enc_frame = fit_rows.select(*[F.expr(input_sql[c]).alias(inner[c]) for c in num_cols])
    inner_stats = N.moments(enc_frame, list(inner.values()))
    stats = {c: inner_stats[n] for c, n in inner.items()}
    kept, vrep = N.variance_selection(input_features, numeric_inputs, stats, cfg.variance_threshold)
    outer = {n: c for c, n in inner.items()}
    pairs = [(outer[a], outer[b], r) for a, b, r in N.correlation_pairs(enc_frame, [inner[c] for c in kept], inner_stats)]
    selected, crep = N.correlation_selection(kept, pairs, cfg.correlation_threshold)

    return PrepModel(cfg, target, keys, list(cl.name_map), cl.name_map, cl.problem_type, cl.classes, cl.n_classes,
                     dropped, nfill, cfill, enc, input_features, input_sql, stats, vrep, crep,
                     selected, list(cl.warnings),
                     {"raw_rows": cl.raw_rows, "raw_columns": cl.raw_columns,
                      "duplicates_removed": cl.duplicates_removed,
                      "empty_rows_removed": cl.empty_rows_removed,
                      "null_target_removed": cl.null_target_removed,
                      "missing_total": sum(cl.raw_missing.values()), "missing": dict(cl.raw_missing)},
                     cl.float_columns)


def prepare(df: DataFrame, cfg: PrepConfig):
    """Full preparation: returns (model, prepared frame with __part)."""
    cl = clean_and_split(df, cfg)
    model = fit_plan(cl.frame, cfg, cl)
    body = model.with_label(cl.frame)
    exprs = [q(k) for k in model.keys] + [F.col("__part"), F.col(LABEL).alias("label")]
    exprs += [F.expr(e).alias(n) for n, e in model.feature_sql()]
    return model, body.select(*exprs), cl
