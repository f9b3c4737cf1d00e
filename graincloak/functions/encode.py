"""Encodings of quasi-identifiers into numbers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincloak.operators.mondrian import kept, sized


def standardise(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """(x - mean) / population deviation, 1 for a constant column. One pass for all columns."""
    if not columns:
        return df
    fit = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    scale = {c: fit[f"s_{c}"] or 1.0 for c in columns}
    return df.withColumns({f"{prefix}{c}": (F.col(c) - F.lit(fit[f"m_{c}"] or 0.0)) / F.lit(scale[c]) for c in columns})


def value_codes(df: DataFrame, column: str, seed: int | None = None) -> DataFrame:
    """(value, code): the place of each distinct non-null value in order, or in an order shuffled by ``seed``."""
    order = F.col("value") if seed is None else F.xxhash64(F.col("value"), F.lit(column), F.lit(seed))
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy(order, "value")) - 1)  # distinct values only


def encode_codes(df: DataFrame, columns: list[str], prefix: str = "z_", seed: int | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """Integer codes fitted on ``fitted`` (``df`` itself by default); unseen and null values get -1."""
    for c in columns:
        codes = sized(kept(value_codes(df if fitted is None else fitted, c, seed).withColumnRenamed("value", f"v_{c}")))  # else rows would be dealt by their few values
        df = df.join(codes, F.col(c) == F.col(f"v_{c}"), "left").withColumn(f"{prefix}{c}", F.coalesce("code", F.lit(-1)).cast("double")).drop("code", f"v_{c}")
    return df


def encode_onehot(df: DataFrame, column: str, values: list) -> DataFrame:
    """A 0/1 column for each of the fitted ``values``; unseen values have none set."""
    return df.withColumns({f"{column}_{v}": (F.coalesce(F.col(column) == F.lit(v), F.lit(False))).cast("int") for v in values})
