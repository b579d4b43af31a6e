"""Feature preparation as fit/transform stages.

``fit`` learns one small set of numbers per column from the training table;
``transform`` is a projection with those numbers as literals (or a broadcast
join for category codes). The stages are ``pyspark.ml`` stages, so they go into
a ``Pipeline`` and are saved with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, doubles, long_text, named, numeric_columns, per_column, present, text_columns
from ..functions.ordered import dense_codes
from ..functions.quantiles import modes, quantiles
from ..functions.scratch import cut
from .profile import fence_map, null_counts

MISSING = "MISSING"


def _param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.identity)


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    def _option(self, name: str):
        return self.getOrDefault(name)


class _Learned(Model, _Stage):
    """A fitted stage: options and learned values in one JSON parameter."""

    learned = _param("learned", "values found by fit")

    def __init__(self, learned: dict | None = None):
        super().__init__()
        self._set(learned=learned or {})

    @property
    def values(self) -> dict:
        return self._option("learned")


class MissingFiller(Estimator, _Stage):
    """Fill numbers by mean, median, most frequent or a constant; all else by its most frequent value."""

    strategy = _param("strategy", "mean, median, most_frequent or constant")
    columns = _param("columns", "columns to fill, all when absent")
    fillValue = _param("fillValue", "value of the constant strategy")
    exclude = _param("exclude", "columns never filled")

    def __init__(self, strategy="mean", columns=None, fillValue=0, exclude=()):
        super().__init__()
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise ValueError(f"unknown strategy: {strategy}")
        self._set(strategy=strategy, columns=columns, fillValue=fillValue, exclude=list(exclude))

    def _fit(self, df: DataFrame) -> "MissingFillerModel":
        skip = set(self._option("exclude"))
        columns = [c for c in self._option("columns") or df.columns if c not in skip]
        numbers = [c for c in columns if c in set(numeric_columns(df))]
        others = [c for c in columns if c not in set(numbers)]
        strategy = self._option("strategy")
        fills: dict = {}
        if numbers and strategy == "mean":
            rows = per_column(doubles(df, numbers), numbers, {"value": F.avg}).collect()
            fills.update({r["feature"]: r["value"] for r in rows})
        elif numbers and strategy == "median":
            fills.update({r["feature"]: r["q"][0] for r in quantiles(df, numbers, [0.5]).collect()})
        elif numbers and strategy == "most_frequent":
            fills.update({r["feature"]: r["value"] for r in modes(df, numbers, text=False).collect()})
        elif numbers:
            fills.update(dict.fromkeys(numbers, self._option("fillValue")))
        if others:
            if strategy == "constant" and isinstance(self._option("fillValue"), str):
                fills.update(dict.fromkeys(others, self._option("fillValue")))
            else:
                fills.update(dict.fromkeys(others, MISSING))
                fills.update({r["feature"]: r["value"] for r in modes(df, others, text=True).collect()})
        return MissingFillerModel({"fills": fills, "as_double": numbers if strategy in ("mean", "median") else []})


class MissingFillerModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        fills, widened = self.values["fills"], set(self.values["as_double"])

        def filled(c: str) -> Column:
            if c not in fills:
                return F.col(c)
            kind = T.DoubleType() if c in widened else df.schema[c].dataType
            fill = F.lit(fills[c])
            fill = fill.try_cast(kind) if isinstance(fills[c], str) else fill.cast(kind)
            return F.coalesce(present(df, c).cast(kind), fill).alias(c)

        return df.select(*[filled(c) for c in df.columns])


class SparseColumnDropper(Estimator, _Stage):
    """Drop the columns whose missing share in the training table is above a limit."""

    mostMissing = _param("mostMissing", "largest share kept")
    exclude = _param("exclude", "columns never dropped")

    def __init__(self, mostMissing=0.5, exclude=()):
        super().__init__()
        self._set(mostMissing=mostMissing, exclude=list(exclude))

    def _fit(self, df: DataFrame) -> "ColumnDropper":
        skip = set(self._option("exclude"))
        rows = null_counts(df).collect()
        limit = self._option("mostMissing")
        return ColumnDropper(
            {"drop": [r["feature"] for r in rows if r["rows"] and r["missing"] / r["rows"] > limit and r["feature"] not in skip]}
        )


class ConstantColumnDropper(Estimator, _Stage):
    """Drop columns with fewer than two distinct values (min equals max)."""

    exclude = _param("exclude", "columns never dropped")

    def __init__(self, exclude=()):
        super().__init__()
        self._set(exclude=list(exclude))

    def _fit(self, df: DataFrame) -> "ColumnDropper":
        columns = [c for c in df.columns if c not in set(self._option("exclude"))]
        rows = per_column(
            df,
            columns,
            {"flat": lambda c: F.coalesce(F.min(present(df, c)) == F.max(present(df, c)), F.lit(True))},
        ).collect()
        return ColumnDropper({"drop": [r["feature"] for r in rows if r["flat"]]})


class CorrelatedColumnDropper(Estimator, _Stage):
    """Of every pair above the threshold keep the column that comes first."""

    threshold = _param("threshold", "absolute correlation")
    exclude = _param("exclude", "columns never dropped")

    def __init__(self, threshold=0.8, exclude=()):
        super().__init__()
        self._set(threshold=threshold, exclude=list(exclude))

    def _fit(self, df: DataFrame) -> "ColumnDropper":
        from .profile import high_correlations

        columns = numeric_columns(df, self._option("exclude"))
        drop: list[str] = []
        if len(columns) > 1:
            pairs = {(r["a"], r["b"]) for r in high_correlations(df, self._option("threshold"), columns).collect()}
            for i, b in enumerate(columns):
                if any((a, b) in pairs and a not in drop for a in columns[:i]):
                    drop.append(b)
        return ColumnDropper({"drop": drop})


class ColumnDropper(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.values["drop"])


class OutlierHandler(Estimator, _Stage):
    """iqr: clip to the fences. zscore: replace by the mean. remove: drop rows outside the fences."""

    method = _param("method", "iqr, zscore or remove")
    columns = _param("columns", "numeric columns, all when absent")
    threshold = _param("threshold", "times the quartile range, or standard deviations")
    exclude = _param("exclude", "columns left as they are, such as the target")

    def __init__(self, method="iqr", columns=None, threshold=1.5, exclude=()):
        super().__init__()
        if method not in ("iqr", "zscore", "remove"):
            raise ValueError(f"unknown outlier method: {method}")
        self._set(method=method, columns=columns, threshold=threshold, exclude=list(exclude))

    def _fit(self, df: DataFrame) -> "OutlierHandlerModel":
        skip = set(self._option("exclude"))
        columns = [c for c in self._option("columns") or numeric_columns(df) if c not in skip]
        limit = self._option("threshold")
        if not columns:
            limits: dict = {}
        elif self._option("method") == "zscore":
            rows = per_column(doubles(df, columns), columns, {"mean": F.avg, "std": F.stddev_samp}).collect()
            limits = {r["feature"]: [r["mean"], r["std"]] for r in rows}
        else:
            limits = {c: list(b) for c, b in fence_map(df, columns, limit).items()}
        return OutlierHandlerModel({"method": self._option("method"), "threshold": limit, "limits": limits})


class OutlierHandlerModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        method, threshold = self.values["method"], self.values["threshold"]
        limits = {c: b for c, b in self.values["limits"].items() if None not in b}

        def handled(c: str) -> Column:
            if c not in limits:
                return F.col(c)
            x = as_double(df, c)
            a, b = limits[c]
            if method == "iqr":
                return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(a)), F.lit(b))).alias(c)
            far = F.abs(F.try_divide(x - F.lit(a), F.lit(b))) > threshold
            return F.when(far, F.lit(a)).otherwise(x).alias(c)

        if method == "remove":
            kept = F.lit(True)
            for c, (low, high) in limits.items():
                x = as_double(df, c)
                kept = kept & F.coalesce(x.between(low, high), F.lit(True))
            return df.where(kept)
        return df.select(*[handled(c) for c in df.columns])


def encode_by_table(df: DataFrame, column: str, codes: DataFrame, output: str | None = None,
                    unknown: int | None = None, broadcast: bool = False) -> DataFrame:
    """Replace a text column by its code from a (value, code) table.

    Without ``broadcast`` the table may be of any size: the join is then a
    shuffle join that adaptive execution splits at hot values.
    """
    lookup = codes.toDF("_value", "_code")
    lookup = F.broadcast(lookup) if broadcast else lookup
    key = F.coalesce(present(df, column).cast("string"), F.lit(MISSING))
    joined = df.withColumn("_key", key).join(lookup, F.col("_key") == F.col("_value"), "left")
    code = F.col("_code") if unknown is None else F.coalesce("_code", F.lit(unknown).cast("long"))
    names = [code.alias(column) if (c == column and output is None) else F.col(c) for c in df.columns]
    return joined.select(*names, *([code.alias(output)] if output else []))


def code_table(df: DataFrame, column: str) -> DataFrame:
    """value, code: codes 0.. in sorted order of the text, nulls as their own text. Any number of values."""
    return code_tables(df, [column]).select("value", "code")


def code_tables(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, code: the code tables of several columns, numbered in one sort."""
    texts = named(long_text(df, columns), columns).select("feature", F.coalesce("value", F.lit(MISSING)).alias("value"))
    placed = dense_codes(texts.select(F.struct("feature", "value").alias("cell")), "cell")
    # One row per column: where its codes begin.
    starts = placed.groupBy(F.col("cell.feature").alias("feature")).agg(F.min("code").alias("_start"))
    return placed.select("cell.*", "code").join(F.broadcast(starts), "feature").select("feature", "value", (F.col("code") - F.col("_start")).alias("code"))


def _known_values(df: DataFrame, column: str, most: int, advice: str) -> list[str]:
    texts = df.select(F.coalesce(present(df, column).cast("string"), F.lit(MISSING)).alias("value")).distinct()
    rows = texts.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {column} has more than {most} values; {advice}")
    # Byte order, the order of Spark's and of the code table's sort.
    return sorted((r["value"] for r in rows), key=lambda v: v.encode())


def _fit_codes(df: DataFrame, columns: Sequence[str], unknown: str, orders: dict | None = None) -> "LabelEncoderModel":
    """The code table is written once; only its size per column comes to the driver."""
    orders = orders or {}
    spark = df.sparkSession
    given = [(c, v, i) for c, order in orders.items() for i, v in enumerate(order)]
    codes = spark.createDataFrame(given, "feature string, value string, code long")
    if columns:
        codes = codes.unionByName(code_tables(df, columns))
    codes = cut(codes)
    sizes = codes.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 16).alias("bytes")).collect()
    found = {r["feature"]: {"n": r["n"], "bytes": r["bytes"]} for r in sizes}
    learned = {c: found.get(c, {"n": 0, "bytes": 0}) for c in [*orders, *columns]}
    return LabelEncoderModel({"columns": learned, "unknown": unknown}, codes)


class LabelEncoder(Estimator, _Stage):
    """Text to code 0..k-1 in sorted order, for any number of values. New values get k (keep), null, or an error."""

    columns = _param("columns", "text columns, all when absent")
    unknown = _param("unknown", "keep, null or error")
    exclude = _param("exclude", "columns left as they are")

    def __init__(self, columns=None, unknown="keep", exclude=()):
        super().__init__()
        if unknown not in ("keep", "null", "error"):
            raise ValueError(f"unknown handling: {unknown}")
        self._set(columns=columns, unknown=unknown, exclude=list(exclude))

    def _fit(self, df: DataFrame) -> "LabelEncoderModel":
        skip = set(self._option("exclude"))
        columns = [c for c in self._option("columns") or text_columns(df) if c not in skip]
        return _fit_codes(df, columns, self._option("unknown"))


class OrdinalEncoder(Estimator, _Stage):
    """Label codes in a given order of values; columns without an order use sorted order."""

    orders = _param("orders", "column -> ordered values")
    unknown = _param("unknown", "keep, null or error")

    def __init__(self, orders=None, unknown="keep"):
        super().__init__()
        self._set(orders=orders or {}, unknown=unknown)

    def _fit(self, df: DataFrame) -> "LabelEncoderModel":
        given = self._option("orders")
        return _fit_codes(df, [c for c in text_columns(df) if c not in given], self._option("unknown"), given)


class LabelEncoderModel(_Learned, MLWritable):
    """Codes by a table (feature, value, code), which is saved as Parquet beside the parameters."""

    #: A column's code table of at most so many bytes, as counted by fit, is broadcast.
    BROADCAST_BYTES = 8 * 1024 * 1024

    def __init__(self, learned: dict | None = None, codes: DataFrame | None = None):
        super().__init__(learned)
        self.codes = codes

    def _transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        for c, size in self.values["columns"].items():
            if c not in df.columns:
                continue
            codes = self.codes.where(F.col("feature") == c).select("value", "code")
            fallback = size["n"] if self.values["unknown"] == "keep" else None
            df = encode_by_table(df, c, codes, unknown=fallback, broadcast=size["bytes"] <= self.BROADCAST_BYTES)
            if self.values["unknown"] == "error":
                stop = F.raise_error(F.lit(f"value of {c} not seen in training")).cast("long")
                df = df.withColumn(c, F.coalesce(F.col(c), stop))
        return df.select(*order)

    def labels(self, column: str) -> DataFrame:
        """value, code of one column."""
        return self.codes.where(F.col("feature") == column).select("value", "code")

    def write(self) -> "_CodesWriter":
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> "_CodesReader":
        return _CodesReader(cls)


class _CodesWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.codes.write.mode("overwrite").parquet(f"{path}/codes")


class _CodesReader(DefaultParamsReader):
    def load(self, path: str) -> LabelEncoderModel:
        model = super().load(path)
        model.codes = SparkSession.active().read.parquet(f"{path}/codes")
        return model


class IndicatorEncoder(Estimator, _Stage):
    """Replace a text column by one 0/1 column per value seen in training.

    Each value is a column of the result, so the caller says how many are
    bearable; ``indicator_vector`` has no such bound.
    """

    columns = _param("columns", "text columns, all when absent")
    exclude = _param("exclude", "columns left as they are")
    mostValues = _param("mostValues", "values of one column, as many columns of the result, beyond which fit fails")

    def __init__(self, columns=None, exclude=(), mostValues=200):
        super().__init__()
        self._set(columns=columns, exclude=list(exclude), mostValues=mostValues)

    def _fit(self, df: DataFrame) -> "IndicatorEncoderModel":
        skip = set(self._option("exclude"))
        columns = [c for c in self._option("columns") or text_columns(df) if c not in skip]
        advice = "raise mostValues or use indicator_vector"
        return IndicatorEncoderModel({"values": {c: _known_values(df, c, self._option("mostValues"), advice) for c in columns}})


class IndicatorEncoderModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        values = {c: v for c, v in self.values["values"].items() if c in df.columns}
        kept = [c for c in df.columns if c not in values]
        flags = []
        for c, known in values.items():
            key = F.coalesce(present(df, c).cast("string"), F.lit(MISSING))
            flags += [(key == v).cast("int").alias(f"{c}_{v}") for v in known]
        return df.select(*kept, *flags)


def indicator_vector(column: str, output: str) -> Pipeline:
    """Sparse indicator vector for columns with many values: label codes, then one-hot, none dropped."""
    return Pipeline(
        stages=[
            LabelEncoder([column], unknown="keep"),
            OneHotEncoder(inputCols=[column], outputCols=[output], dropLast=False, handleInvalid="keep"),
        ]
    )


class Scaler(Estimator, _Stage):
    """standard: mean and population deviation. minmax: to 0..1. robust: median and quartile range."""

    method = _param("method", "standard, minmax or robust")
    columns = _param("columns", "numeric columns, all when absent")
    exclude = _param("exclude", "columns left as they are")

    def __init__(self, method="standard", columns=None, exclude=()):
        super().__init__()
        if method not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown scaling method: {method}")
        self._set(method=method, columns=columns, exclude=list(exclude))

    def _fit(self, df: DataFrame) -> "ScalerModel":
        skip = set(self._option("exclude"))
        columns = [c for c in self._option("columns") or numeric_columns(df) if c not in skip]
        method = self._option("method")
        if not columns:
            return ScalerModel({"scales": {}})
        slim = doubles(df, columns)
        if method == "robust":
            rows = quantiles(df, columns, [0.25, 0.5, 0.75]).collect()
            found = {r["feature"]: (r["q"][1], None if r["q"][0] is None else r["q"][2] - r["q"][0]) for r in rows}
        elif method == "minmax":
            rows = per_column(slim, columns, {"a": F.min, "b": lambda c: F.max(c) - F.min(c)}).collect()
            found = {r["feature"]: (r["a"], r["b"]) for r in rows}
        else:
            rows = per_column(slim, columns, {"a": F.avg, "b": F.stddev_pop}).collect()
            found = {r["feature"]: (r["a"], r["b"]) for r in rows}
        # A constant column is only centred.
        return ScalerModel({"scales": {c: [a or 0.0, b or 1.0] for c, (a, b) in found.items()}})


class ScalerModel(_Learned):
    def _transform(self, df: DataFrame) -> DataFrame:
        scales = self.values["scales"]
        return df.select(
            *[
                ((as_double(df, c) - F.lit(scales[c][0])) / F.lit(scales[c][1])).alias(c) if c in scales else F.col(c)
                for c in df.columns
            ]
        )


class FloatCaster(Transformer, _Stage):
    """Every numeric column as a 32-bit float."""

    exclude = _param("exclude", "columns left as they are")

    def __init__(self, exclude=()):
        super().__init__()
        self._set(exclude=list(exclude))

    def _transform(self, df: DataFrame) -> DataFrame:
        names = numeric_columns(df, self._option("exclude"))
        return df.withColumns({c: F.col(c).cast("float") for c in names}) if names else df


class Preparation:
    """Fit/transform front: named pipelines, feature names, and the target kept apart."""

    def __init__(self, stages: Sequence, target: str | None = None):
        self.pipeline = Pipeline(stages=list(stages))
        self.target = target
        self.model: PipelineModel | None = None
        self.feature_names: list[str] = []

    def fit(self, df: DataFrame) -> "Preparation":
        self.model = self.pipeline.fit(df)
        self.feature_names = [c for c in self.model.transform(df).columns if c != self.target]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit first")
        return self.model.transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if self.target is None or self.target not in df.columns:
            return df, None
        return df.drop(self.target), df.select(self.target)


def _target_stage(df: DataFrame, target: str | None) -> list:
    text = target is not None and isinstance(df.schema[target].dataType, T.StringType)
    return [LabelEncoder([target], unknown="error")] if text else []


def full_preparation(df: DataFrame, target: str | None = None, handle_missing: bool = True,
                     handle_outliers: bool = True, encode: bool = True, scale: bool = True) -> Preparation:
    """Fill, clip, encode and scale, each switchable; the target is left out of all four."""
    skip = [target] if target else []
    stages: list = []
    if handle_missing:
        stages.append(MissingFiller("mean", exclude=skip))
    if handle_outliers:
        stages.append(OutlierHandler("iqr", exclude=skip))
    if encode:
        stages.append(LabelEncoder(exclude=skip))
        stages += _target_stage(df, target)
    if scale:
        stages.append(Scaler("standard", exclude=skip))
    return Preparation(stages, target)


def basic_preparation(df: DataFrame, target: str | None = None) -> Preparation:
    """Fill missing values and encode a text target."""
    return Preparation([MissingFiller("mean"), *_target_stage(df, target)], target)


def training_preparation(df: DataFrame, target: str) -> Preparation:
    """Fill by mean, encode texts, cast to 32-bit floats, encode a text target."""
    skip = [target]
    stages = [MissingFiller("mean", exclude=skip), LabelEncoder(exclude=skip), *_target_stage(df, target), FloatCaster(skip)]
    return Preparation(stages, target)


def trainer_preparation(df: DataFrame, target: str) -> Preparation:
    """Encode texts and standardise numbers."""
    numbers = numeric_columns(df, [target])
    return Preparation([LabelEncoder(exclude=[target]), Scaler("standard", numbers), *_target_stage(df, target)], target)


def default_cleaning(df: DataFrame) -> DataFrame:
    """Drop columns more than half missing, fill numbers by median and the rest by mode."""
    stages = [SparseColumnDropper(0.5), MissingFiller("median")]
    return Pipeline(stages=stages).fit(df).transform(df)
