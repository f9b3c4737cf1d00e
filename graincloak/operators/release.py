"""Publishing groups: ranges, value sets, sensitive-value statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincloak.config import People


def skew(df: DataFrame, group: str, sensitive: str) -> DataFrame:
    """Per group: size, distinct values, the largest share of a value, entropies (natural, and in bits), the histogram.
    Counts by (group, value) first, so that the second step sees a few rows a group."""
    counts = df.groupBy(group, F.col(sensitive).alias("value")).agg(F.count("*").alias("n"))
    sized = counts.groupBy(group).agg(F.sum("n").alias("group_size"), F.count("value").alias("sa_values"), F.max("n").alias("most"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("histogram"))
    entropy = F.log("group_size") - F.col("nlogn") / F.col("group_size")
    return sized.select(group, "group_size", "sa_values", (F.col("most") / F.col("group_size")).alias("p_max"), entropy.alias("entropy"), (entropy / F.log(F.lit(2.0))).alias("entropy_bits"), "histogram")


def generalise(df: DataFrame, group: str, who: People) -> DataFrame:
    """Per group: lowest and highest of each numeric column, the sorted distinct values of each categorical one."""
    parts = [f(c).alias(f"{c}_{n}") for c in who.numeric for n, f in (("lo", F.min), ("hi", F.max))]
    parts += [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in who.categorical]
    return df.groupBy(group).agg(*parts, F.min_by(who.sensitive, who.key).alias("sa_first"))


def release(df: DataFrame, assignment: DataFrame, who: People) -> DataFrame:
    """One row per group with all that is published about it. Rows without a group are left out."""
    members = df.join(assignment.filter("group_id IS NOT NULL"), who.key)
    return generalise(members, "group_id", who).join(skew(members, "group_id", who.sensitive), "group_id")


def range_text(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, F.concat(F.lit("["), lo.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), lo.cast("string"), F.lit(","), hi.cast("string"), F.lit("]")))


def set_text(values: Column, trim: bool = False) -> Column:
    joined = F.transform(values, lambda v: F.regexp_replace(v.cast("string"), r"^[\s'\"]+|[\s'\"]+$", "")) if trim else values
    return F.array_join(joined, "\\")


def record_level(df: DataFrame, assignment: DataFrame, released: DataFrame, who: People) -> DataFrame:
    """Each row's sensitive value beside its group's published row."""
    return df.select(who.key, who.sensitive).join(assignment, who.key).join(released, "group_id")


def audit(released: DataFrame, who: People, alpha: float = 0.8, entropy: float = 0.0) -> DataFrame:
    """How many groups break each promise."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return released.agg(F.count("*").alias("n_groups"), count(F.col("group_size") < who.k).alias("breaks_k"), count(F.col("sa_values") < who.e).alias("breaks_e"), count(F.col("p_max") > alpha).alias("breaks_alpha"), count(F.col("entropy") < entropy).alias("breaks_entropy"))
