"""Preparation of tables for training: clean, impute, encode, scale, split.

Fitting computes a handful of numbers per column in one aggregate; applying is a projection.
"""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficlens.operators import normalize as N
from trafficlens.operators.ranking import seeded_pieces, seeded_rank
from trafficlens.session import new_folder


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, minimum, maximum, value and row count per column, from one aggregate."""
    parts = {
        "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "n": F.count,
        "rows": lambda _: F.count(F.lit(1)),
    }
    wide = df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), *[f(F.col(f"`{c}`").cast("double")).alias(n) for n, f in parts.items()])
                for c in columns
            ]
        ).alias("s")
    )
    return wide.select(F.inline("s"))


def fitted_statistics(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    return {r["column"]: r.asDict() for r in column_statistics(df, columns).collect()}


def impute_means(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing numbers with the column mean."""
    means = fitted_statistics(fit_on if fit_on is not None else df, columns)
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(means[c]["mean"])) for c in columns}
    )


def clean(df: DataFrame, target: str | None = None) -> DataFrame:
    """Distinct rows, infinities as missing, means for missing numbers. The target is left alone."""
    distinct = N.infinite_to_null(df.dropDuplicates())
    columns = [c for c in N.numeric_columns(distinct) if c != target]
    return impute_means(distinct, columns) if columns else distinct


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    stats = fitted_statistics(fit_on if fit_on is not None else df, columns)
    return df.withColumns(
        {c: (F.col(f"`{c}`") - F.lit(s["mean"])) / F.lit(s["std"] or 1.0) for c, s in stats.items()}
    )


def min_max_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale to 0-1 by the range of the fitted rows; a constant column becomes 0."""
    stats = fitted_statistics(fit_on if fit_on is not None else df, columns)
    return df.withColumns(
        {c: (F.col(f"`{c}`") - F.lit(s["min"])) / F.lit((s["max"] - s["min"]) or 1.0) for c, s in stats.items()}
    )


# A value that becomes a column is part of every plan: more of them are refused before they reach the driver.
MOST_COLUMNS = 2_000


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted values of a column that is to become as many columns; more than ``MOST_COLUMNS`` are an error."""
    found = df.select(column).na.drop().distinct().limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values; take one_hot_vector")
    return sorted(r[0] for r in found)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with zero-based codes in sorted order, for any number of values.

    Values are sorted by range over all tasks; a code is the place within its partition plus the sizes of the
    partitions before, the only numbers that meet in one task.
    """
    placed = df.select(F.col(column).alias("value")).na.drop().distinct().orderBy("value").withColumn("_id", F.monotonically_increasing_id())
    path = new_folder(df.sparkSession, "dictionary")
    placed.write.parquet(path)
    part = df.sparkSession.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return part.join(offsets, "_part").select("value", (F.col("_before") + F.col("_id") % (1 << 33)).alias("code"))


def one_hot(df: DataFrame, column: str, known: list[str] | None = None) -> DataFrame:
    """One 0/1 column ``column_value`` per known category; an unknown category is all zeros.

    For more categories than a table should have columns take :func:`one_hot_vector`.
    """
    known = categories(df, column) if known is None else known
    c = F.col(column)
    return df.withColumns(
        {f"{column}_{v}": F.coalesce((c == v).cast("double"), F.lit(0.0)) for v in known}
    ).drop(column)


def label_encode(df: DataFrame, column: str, output: str) -> DataFrame:
    """Zero-based code in sorted order of the values; NULL stays NULL."""
    codes = dictionary(df, column).select(F.col("value").alias("_value"), F.col("code").cast("int").alias(output))
    return df.drop(output).join(codes, F.col(column) == F.col("_value"), "left").drop("_value")


def one_hot_vector(df: DataFrame, column: str, output: str) -> DataFrame:
    """Sparse 0/1 vector over all values of the column, as ``size`` and the index set; a missing value has none."""
    codes = dictionary(df, column)
    size = codes.count()
    indexed = df.join(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")), F.col(column) == F.col("_value"), "left")
    vector = F.struct(F.lit(size).cast("bigint").alias("size"), F.array_compact(F.array("_code")).alias("indices"))
    return indexed.withColumn(output, vector).drop("_value", "_code", column)


def _quota(ratio: float) -> Column:
    return F.floor(F.col("group_size") * F.lit(ratio) + F.lit(1e-9))


def stratified_split(
    df: DataFrame, id_column: str, target: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``split`` (train, val, test) with the same shares in every class; rounding goes to train."""
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    pieces = seeded_pieces(df, id_column, seed, [_quota(test), _quota(test) + _quota(val)], target)
    return pieces.withColumn("split", F.element_at(F.array(*map(F.lit, ("test", "val", "train"))), F.col("piece") + 1)).drop("piece")


def stratified_folds(df: DataFrame, id_column: str, target: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..folds-1), dealt evenly within every class."""
    ranked = seeded_rank(df, id_column, seed, target)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "group_size")


def reward_weight(label: Column) -> Column:
    """Training weight: malicious 1.0, benign 0.1."""
    return F.when(label == 1, 1.0).otherwise(0.1)


def fit_preparation(df: DataFrame, target: str) -> PipelineModel:
    """Fit impute + scale + one-hot + assemble into one persistable pipeline with output ``features``.

    The population deviation needs its own scaling stage; it is stored as a SQL projection.
    """
    df = N.infinite_to_null(df)
    numeric = [c for c in N.numeric_columns(df) if c != target]
    text = [c for c in N.categorical_columns(df) if c != target]
    stats = fitted_statistics(df, numeric)
    scaled = {}
    for c, s in stats.items():
        if s["n"]:
            # Imputed rows sit at the mean, so imputing shrinks the deviation by the share of real values.
            mean, std = s["mean"], s["std"] * (s["n"] / s["rows"]) ** 0.5 or 1.0
            scaled[f"{c}__scaled"] = f"(coalesce(double(`{c}`), double('{mean!r}')) - double('{mean!r}')) / double('{std!r}')"
    stages = []
    if scaled:
        made = ", ".join(f"{e} AS `{n}`" for n, e in scaled.items())
        stages.append(SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"))
    if text:
        stages.append(
            StringIndexer(
                inputCols=text, outputCols=[f"{c}__index" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
        # The slot of unknown values is the last one and is dropped: unknown becomes all zeros.
        stages.append(
            OneHotEncoder(inputCols=[f"{c}__index" for c in text], outputCols=[f"{c}__onehot" for c in text], dropLast=True)
        )
    stages.append(
        VectorAssembler(inputCols=[*scaled, *[f"{c}__onehot" for c in text]], outputCol="features", handleInvalid="keep")
    )
    return Pipeline(stages=stages).fit(df)


def prepare(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Apply fitted preparation to new rows."""
    made = N.infinite_to_null(df)
    out = model.transform(made)
    return out.select(*df.columns, "features")


def save_preparation(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_preparation(path: str) -> PipelineModel:
    return PipelineModel.load(path)
