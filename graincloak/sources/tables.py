"""Reading, checking and writing tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graincloak.config import People


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Maps become JSON text where the format has no maps."""
    if kind == "csv":
        df = df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))})
    df.write.mode("overwrite").format(kind).options(**options).save(path)


def required(df: DataFrame, who: People) -> DataFrame:
    """The columns of the job; stops with the names of those that are missing."""
    wanted = [who.key, *who.identifiers, who.sensitive]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*wanted)


def complete(df: DataFrame, who: People) -> DataFrame:
    """Rows without nulls (or NaN) in any identifier or the sensitive column."""
    return required(df, who).dropna(subset=[*who.identifiers, who.sensitive])


def by_kind(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns by type; absent ones are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    there = [c for c in columns if c in kinds]
    numeric = [c for c in there if isinstance(kinds[c], T.NumericType)]
    return numeric, [c for c in there if c not in numeric]


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, the same ones whatever the partitioning; samples of one seed are nested."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


ORDERS = People("row_key", ("totalprice", "acctbal", "days"), ("status", "priority", "nation"), "segment")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, as person-level rows."""
    orders = read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customers = read_table(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    both = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    days = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    return both.select(F.col("o_orderkey").alias("row_key"), F.col("o_totalprice").alias("totalprice"), F.col("c_acctbal").alias("acctbal"), days.alias("days"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
