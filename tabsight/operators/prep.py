"""Preprocessing (F1–F9, D1, M1–M4): blank → NULL, dedupe, drop, impute, scale, one-hot, PCA.

``Preprocessor.fit`` computes per-column statistics with global aggregates (exact medians via
``exact_quantiles``, modes and sorted levels from the frequency table); ``transform`` is a
single projection of ``coalesce``/arithmetic/``when`` expressions — whole-stage codegen, no
Python on the rows. The fitted state is a few scalars and level lists per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CATEGORICAL, NUMERIC, classify
from ..functions.safe import qcol
from ..session import ensure_checkpoint_dir
from .knn_impute import knn_impute
from .profile import frequency_table, top_values
from .quantiles import exact_quantiles
from .screen import prep_drop_columns

MAX_LEVELS = 10_000

BLANK_RE = r"^\s*$"


def blank_to_null(df: DataFrame) -> DataFrame:
    """strings made only of whitespace become NULL (string columns only)."""
    cats = {c for c, k in classify(df) if k == CATEGORICAL}
    return df.select(*[
        (F.when(qcol(c).rlike(BLANK_RE), F.lit(None).cast("string")).otherwise(qcol(c)).alias(c) if c in cats else qcol(c))
        for c in df.columns])


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows (NULLs equal) — a hash aggregate with map-side combine."""
    return df.dropDuplicates()


def row_key(columns: list[str]) -> Column:
    """Deterministic row identity for distinct rows: md5 of a length-prefixed rendering of
    every value (NULL rendered apart from any string), so it is independent of partitioning
    and retries (unlike ``monotonically_increasing_id``)."""
    parts = []
    for c in columns:
        v = qcol(c).cast("string")
        parts.append(F.when(v.isNull(), F.lit("N")).otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)))
    return F.md5(F.concat_ws("|", *parts))


@dataclass
class Preprocessor:
    """imputation + scaling for numeric columns, imputation + one-hot for categorical ones."""
    numeric_strategy: str = "median"          # median | mean | most_frequent | constant
    categorical_strategy: str = "most_frequent"  # most_frequent | constant
    scaler_type: str = "standard"             # standard | minmax
    fill_value: str = "missing"
    use_knn_imputer: bool = False             # the rows were filled by nearest donors (``preprocess``); later rows by the strategy
    knn_neighbors: int = 5
    numeric_features: list[str] = field(default_factory=list)
    categorical_features: list[str] = field(default_factory=list)
    num_fill: dict = field(default_factory=dict)
    num_center: dict = field(default_factory=dict)
    num_scale: dict = field(default_factory=dict)
    cat_fill: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)
    fitted: bool = False

    def fit(self, df: DataFrame) -> "Preprocessor":
        classes = classify(df)
        num = [c for c, k in classes if k == NUMERIC]
        cat = [c for c, k in classes if k == CATEGORICAL]
        if not num and not cat:
            raise ValueError("No features to preprocess")
        stats = df.agg(*([F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(num + cat)]
                         + [F.avg(qcol(c).cast("double")).alias(f"m{i}") for i, c in enumerate(num)])).first()
        # all-NULL columns carry no information and are dropped (as the reference's imputer does)
        n_num = len(num)
        num = [c for i, c in enumerate(num) if stats[f"n{i}"] > 0]
        cat = [c for j, c in enumerate(cat) if stats[f"n{n_num + j}"] > 0]
        self.numeric_features, self.categorical_features = num, cat
        if num:
            if self.numeric_strategy == "median":
                med = exact_quantiles(df, num, [0.5])
                self.num_fill = {c: med[c][0] for c in num}
            elif self.numeric_strategy == "mean":
                m = df.agg(*[F.avg(qcol(c).cast("double")).alias(c) for c in num]).first()
                self.num_fill = {c: m[c] for c in num}
            elif self.numeric_strategy == "most_frequent":
                self.num_fill = self._modes(df, num, numeric=True)
            else:
                self.num_fill = {c: 0.0 for c in num}
            filled = [F.coalesce(qcol(c).cast("double"), F.lit(self.num_fill[c])) for c in num]
            if self.scaler_type == "standard":
                s = df.agg(*[F.avg(x).alias(f"a{i}") for i, x in enumerate(filled)]
                           + [F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
                self.num_center = {c: s[f"a{i}"] for i, c in enumerate(num)}
                self.num_scale = {c: (s[f"s{i}"] if s[f"s{i}"] else 1.0) for i, c in enumerate(num)}
            else:
                s = df.agg(*[F.min(x).alias(f"a{i}") for i, x in enumerate(filled)]
                           + [F.max(x).alias(f"b{i}") for i, x in enumerate(filled)]).first()
                self.num_center = {c: s[f"a{i}"] for i, c in enumerate(num)}
                self.num_scale = {c: ((s[f"b{i}"] - s[f"a{i}"]) or 1.0) for i, c in enumerate(num)}
        if cat:
            if self.categorical_strategy == "most_frequent":
                self.cat_fill = self._modes(df, cat, numeric=False)
            else:
                self.cat_fill = {c: self.fill_value for c in cat}
            self.levels = self._levels(df, cat)
        self.fitted = True
        return self

    @staticmethod
    def _modes(df: DataFrame, cols: list[str], numeric: bool) -> dict:
        top = top_values(frequency_table(df, cols), 1, numeric_order=numeric).select("column_name", "value").collect()
        out = {r["column_name"]: r["value"] for r in top}
        return {c: (float(out[c]) if numeric and out.get(c) is not None else out.get(c)) for c in cols}

    def _levels(self, df: DataFrame, cols: list[str]) -> dict:
        """Sorted distinct levels per categorical column after imputation (one row per level)."""
        filled = df.select(*[F.coalesce(qcol(c), F.lit(self.cat_fill[c])).alias(c) for c in cols])
        freq = frequency_table(filled, cols).where(F.col("value").isNotNull())
        counts = {r["column_name"]: r["n"] for r in freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        too_many = {c: n for c, n in counts.items() if n > MAX_LEVELS}
        if too_many:
            raise ValueError(f"Too many categorical levels for one-hot encoding: {too_many}")
        rows = freq.select("column_name", "value").collect()
        out = {c: [] for c in cols}
        for r in rows:
            out[r["column_name"]].append(r["value"])
        return {c: sorted(v) for c, v in out.items()}

    # ------------------------------------------------------------------ transform
    def feature_names(self) -> list[str]:
        """F8: numeric names first, then ``{column}_{level}`` per categorical level."""
        self._check()
        return list(self.numeric_features) + [f"{c}_{v}" for c in self.categorical_features for v in self.levels[c]]

    def feature_columns(self) -> list[Column]:
        """One double Column per output feature, named as ``feature_names``."""
        self._check()
        out = []
        for c in self.numeric_features:
            x = F.coalesce(qcol(c).cast("double"), F.lit(self.num_fill[c]))
            out.append(((x - F.lit(self.num_center[c])) / F.lit(self.num_scale[c])).alias(c))
        for c in self.categorical_features:
            x = F.coalesce(qcol(c), F.lit(self.cat_fill[c]))
            for v in self.levels[c]:
                out.append(F.when(x == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}"))
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Wide output: kept pass-through columns, then one column per feature."""
        return df.select(*[qcol(k) for k in (keep or [])], *self.feature_columns())

    def transform_vector(self, df: DataFrame, keep: list[str] | None = None, out_col: str = "features") -> DataFrame:
        """Vector output (``VectorUDT``) for MLlib estimators."""
        arr = F.array(*[c for c in self.feature_columns()])
        return df.select(*[qcol(k) for k in (keep or [])], array_to_vector(arr).alias(out_col))

    def summary(self) -> dict:
        return {"numeric_features": self.numeric_features, "categorical_features": self.categorical_features,
                "numeric_strategy": self.numeric_strategy, "categorical_strategy": self.categorical_strategy,
                "scaler_type": self.scaler_type, "use_knn_imputer": self.use_knn_imputer,
                "knn_neighbors": self.knn_neighbors, "fitted": self.fitted}

    def _check(self):
        if not self.fitted:
            raise ValueError("Preprocessor must be fitted before transform")


@dataclass
class Prepared:
    """Result of the canonical flow: the processed frame (``row_id`` + features), the fitted
    preprocessor, and the cleaned frame it came from (after blank → NULL and dedupe)."""
    frame: DataFrame
    preprocessor: Preprocessor
    base: DataFrame
    dropped: list[str]

    @property
    def feature_names(self) -> list[str]:
        return self.preprocessor.feature_names()


def filled_by_neighbors(base: DataFrame, features: list[str], k: int) -> DataFrame:
    """the numeric features of ``base`` filled from the k nearest rows that have them. Rows that were kept
    apart only by their id stay apart."""
    numeric = [c for c, kind in classify(base.select(*[qcol(c) for c in features])) if kind == NUMERIC]
    return knn_impute(base, numeric, "row_id", k).checkpoint() if numeric else base


def preprocess(df: DataFrame, exclude_cols: list[str] | None = None, target_col: str | None = None,
               dedupe: bool = True, keep_target: bool = False, use_knn: bool = False, knn_neighbors: int = 5, **prep_kw) -> Prepared:
    """M1–M3: blank → NULL → dedupe (target included; written once) → drop exclude ∪ ID names ∪ target →
    impute (with ``use_knn`` numeric cells by their nearest donors) / scale / encode. The output keeps ``row_id`` (and the target as ``label`` when
    ``keep_target``) on the same row as the features."""
    if len(df.columns) == 0:
        raise ValueError("Input dataframe is None or empty")
    base = blank_to_null(df)
    if dedupe:
        base = dedupe_rows(base)
    ensure_checkpoint_dir(df.sparkSession)
    base = base.withColumn("row_id", row_key(list(df.columns))).checkpoint()
    drop = prep_drop_columns(df, exclude_cols, target_col)
    feats = [c for c in df.columns if c not in drop]
    if use_knn:
        base = filled_by_neighbors(base, feats, knn_neighbors)
        prep_kw |= {"use_knn_imputer": True, "knn_neighbors": knn_neighbors}
    pre = Preprocessor(**prep_kw).fit(base.select(*[qcol(c) for c in feats]))
    keep = ["row_id"] + ([target_col] if keep_target and target_col else [])
    return Prepared(pre.transform(base, keep=keep), pre, base, drop)


# ------------------------------------------------------------------ PCA (M4)


def pca(df: DataFrame, columns: list[str], n_components: int = 2, keep: list[str] | None = None,
        drop_all_null_rows: bool = False):
    """Centred PCA: MLlib ``PCA`` fitted on mean-centred vectors (its transform does not centre,
    so the projection is done here as a linear expression per component). ±inf → NULL,
    all-NULL columns dropped, NULLs filled with the column median; the sign of each component
    is fixed so its largest-magnitude loading is positive. Returns (frame, explained ratio) or
    None when fewer than 3 rows or 2 usable columns."""
    def finite(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    if drop_all_null_rows:  # P14: the scatter path drops rows with every feature missing
        df = df.where(F.exists(F.array(*[qcol(c).cast("double") for c in columns]), finite))
    clean = df.select(*[qcol(k) for k in (keep or [])],
                      *[F.when(finite(qcol(c).cast("double")), qcol(c).cast("double")).alias(c) for c in columns])
    ensure_checkpoint_dir(df.sparkSession)
    clean = clean.checkpoint()  # read by the counts, the medians, the means, the covariances and the result
    counts = clean.agg(F.count(F.lit(1)).alias("n"), *[F.count(qcol(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    use = [c for i, c in enumerate(columns) if counts[f"c{i}"] > 0]
    n = counts["n"]
    if n < 3 or len(use) < 2:
        return None
    k = min(n_components, n, len(use))
    if k < 2:
        return None
    med = exact_quantiles(clean, use, [0.5])
    filled = clean.select(*[qcol(x) for x in (keep or [])],
                          *[F.coalesce(qcol(c), F.lit(med[c][0])).alias(c) for c in use])
    d = len(use)
    means = filled.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(use)]).first()
    mean = np.array([means[f"m{i}"] for i in range(d)])
    # covariance and eigenvectors by MLlib (one tree-aggregate of d×d Gramians) on centred vectors
    from pyspark.ml.feature import PCA as _MLPCA
    from pyspark.ml.feature import VectorAssembler
    centred = filled.select(*[(qcol(c) - F.lit(float(mean[i]))).alias(f"_c{i}") for i, c in enumerate(use)])
    vec = VectorAssembler(inputCols=[f"_c{i}" for i in range(d)], outputCol="_v").transform(centred)
    model = _MLPCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    vecs = np.array(model.pc.toArray(), dtype=float, copy=True)
    ratios = model.explainedVariance.toArray()
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    vals = ratios
    comps = []
    for j in range(k):
        expr = None
        for i, c in enumerate(use):
            term = (qcol(c) - F.lit(float(mean[i]))) * F.lit(float(vecs[i, j]))
            expr = term if expr is None else expr + term
        comps.append(expr.alias(f"PC{j + 1}"))
    out = filled.select(*[qcol(x) for x in (keep or [])], *comps)
    return out, [float(v) for v in vals[:k]]


# ------------------------------------------------------------------ SQL form (saveable as an MLlib stage)


def _sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_double(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _sql_str(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def preprocessor_sql(pre: Preprocessor, keep: list[str] | None = None) -> str:
    """The fitted transform as one SQL statement over ``__THIS__`` for ``SQLTransformer``, so
    the preprocessing travels with a saved ``PipelineModel``."""
    pre._check()
    items = [_sql_ident(k) for k in (keep or [])]
    for c in pre.numeric_features:
        x = f"coalesce(CAST({_sql_ident(c)} AS DOUBLE), {_sql_double(pre.num_fill[c])})"
        items.append(f"(({x} - {_sql_double(pre.num_center[c])}) / {_sql_double(pre.num_scale[c])}) AS {_sql_ident(c)}")
    for c in pre.categorical_features:
        x = f"coalesce({_sql_ident(c)}, {_sql_str(pre.cat_fill[c])})"
        for v in pre.levels[c]:
            items.append(f"CASE WHEN {x} = {_sql_str(v)} THEN 1.0 ELSE 0.0 END AS {_sql_ident(f'{c}_{v}')}")
    return "SELECT " + ", ".join(items) + " FROM __THIS__"


def preprocessor_sql_sparse(pre: Preprocessor, keep: list[str] | None = None) -> str:
    """Like ``preprocessor_sql`` but categorical columns are only imputed (kept as text), for a
    sparse one-hot by ``StringIndexer`` + ``OneHotEncoder`` downstream."""
    pre._check()
    items = [_sql_ident(k) for k in (keep or [])]
    for c in pre.numeric_features:
        x = f"coalesce(CAST({_sql_ident(c)} AS DOUBLE), {_sql_double(pre.num_fill[c])})"
        items.append(f"(({x} - {_sql_double(pre.num_center[c])}) / {_sql_double(pre.num_scale[c])}) AS {_sql_ident(c)}")
    for c in pre.categorical_features:
        items.append(f"coalesce({_sql_ident(c)}, {_sql_str(pre.cat_fill[c])}) AS {_sql_ident(c)}")
    return "SELECT " + ", ".join(items) + " FROM __THIS__"
