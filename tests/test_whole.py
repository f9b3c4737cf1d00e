"""Whole-table microaggregation and forests of trees, against the plain rules."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graincloak.operators.microagg import local_groups, microaggregate
from graincloak.operators.mondrian import by_runs, median_leaves, mondrian
from graincloak.operators.whole import whole_groups
from graincloak.queries import DIMS, WHO, encoded, whole_query


def plain(x, sa, k, e, most, least_variance):
    """(For so few rows that those without a seat are one block.) Row to the smallest row of its group's founders; rows are in order of their key."""
    groups = {}

    def near_rows(rows):
        for g in local_groups(x, sa, rows, k, e, 0.8, 0.0)[0]:
            groups[int(g.min())] = sorted(g.tolist())

    def split(rows):
        for leaf in median_leaves(x[rows], sa[rows], 1, k, e, least_variance).values():
            near_rows(rows[np.sort(leaf)])

    def open_rows(rows):
        taken = {r for g in groups.values() for r in g}
        return np.array([r for r in rows if r not in taken], int)

    def centres():
        return {g: x[members].mean(axis=0) for g, members in groups.items()}

    def join(r, middle, most):
        free = [(round(float(np.sqrt(((c - x[r]) ** 2).sum())), 9), g) for g, c in middle.items() if len(groups[g]) < most]
        if free:
            groups[min(free)[1]].append(int(r))

    def place(rows):
        middle = centres()
        for r in rows:
            join(r, middle, most)
        rows = open_rows(rows)
        if len(rows) >= k:
            near_rows(rows)
        middle = centres()
        for r in open_rows(rows):
            join(r, middle, 10**9)

    every = np.arange(len(x))
    split(every)
    if len(open_rows(every)) >= most:
        split(open_rows(every))
    place(open_rows(every))
    large = [g for g in groups if len(groups[g]) > most]
    members = [np.sort(groups.pop(g)) for g in large]
    for m in members:
        split(m)
    if members:
        place(open_rows(np.sort(np.concatenate(members))))
    return {r: g for g, rows in groups.items() for r in rows}, len(large)


@pytest.mark.parametrize(("most", "least_variance"), [(24, 0.05), (9, 0.02), (12, 0.3)])
def test_whole_table_equals_the_plain_rules(spark, most, least_variance):
    rng = np.random.default_rng(most)
    x = np.round(np.concatenate([rng.normal(size=(200, 2)), rng.normal(size=(50, 2)) * 0.1 + 3]), 6)
    sa = rng.choice(list("abcd"), len(x), p=[0.7, 0.2, 0.06, 0.04])
    want, large = plain(x, sa, 4, 3, most, least_variance)
    df = spark.createDataFrame([(i, float(a), float(b), str(s)) for i, ((a, b), s) in enumerate(zip(x, sa))], "row_key long, a double, b double, s string")
    got = {r.row_key: r.group_id for r in whole_groups(df.repartition(5), "row_key", ["a", "b"], "s", 4, 3, most=most, least_variance=least_variance, local_rows=150).collect()}
    assert got == want and min(Counter(got.values()).values()) >= 4
    assert most != 9 or large  # large groups were split again


def test_whole_table_on_odd_rows(spark):
    schema = "row_key long, a double, s string"
    few = spark.createDataFrame([(5, 1.0, "x"), (3, 2.0, None), (9, None, "y"), (8, float("nan"), "y")], schema)
    run = lambda df: {r.row_key: r.group_id for r in whole_groups(df, "row_key", ["a"], "s", 4, 2).collect()}
    assert run(few) == {5: 3, 3: 3, 9: None, 8: None} and run(few.limit(0)) == {}
    equal = spark.range(30).select(F.col("id").alias("row_key"), F.lit(1.0).alias("a"), (F.col("id") % 3).cast("string").alias("s"))
    assert set(Counter(run(equal).values()).values()) <= {4, 5, 6, 7}
    with pytest.raises(ValueError, match="row_key"):
        run(few.union(few))


def test_whole_people(spark, small):
    got = whole_query(spark, small).collect()
    sizes = Counter(r.group_id for r in got)
    assert len(got) == 1500 and None not in sizes and min(sizes.values()) >= WHO.k
    kinds = encoded(spark, small).select(WHO.key, WHO.sensitive).toPandas().set_index(WHO.key)[WHO.sensitive]
    values = {}
    for r in got:
        values.setdefault(r.group_id, set()).add(kinds[r.row_key])
    assert min(map(len, values.values())) >= WHO.e


@pytest.mark.parametrize("rule", ["rank", "median", "total"])
def test_a_forest_equals_its_trees(spark, rule):
    """Trees of very unequal size, cut together and one by one, above and below ``local_rows``."""
    df = spark.range(2500).select(F.col("id").alias("row_key"), (F.col("id") * 31 % 257).cast("double").alias("a"), F.sqrt("id").alias("b"), (F.col("id") % 5).cast("string").alias("s"), F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("tree")).cache()
    run = lambda some, **more: mondrian(some, "row_key", ["a", "b"], 8, rule, "s", 3, 1.0 if rule == "total" else 0.05, **more)
    got = {r.row_key: (r.tree, r.group_id) for r in run(df.repartition(5), start="tree", local_rows=400).collect()}
    assert len(got) == 2500
    for tree in ("hot", "t3", "t17"):
        assert {k: g for k, (t, g) in got.items() if t == tree} == {r.row_key: r.group_id for r in run(df.filter(F.col("tree") == tree)).collect()}


@pytest.mark.parametrize("rule", ["rank", "median", "total"])
def test_unknown_numbers_and_repeated_keys_at_every_size(spark, rule):
    a = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, F.lit(float("nan"))).when(F.col("id") % 10 == 2, F.lit(float("-inf"))).otherwise(F.col("id") * 7 % 101)
    df = spark.range(900).select(F.col("id").alias("row_key"), a.alias("a"), F.sqrt("id").alias("b"), (F.col("id") % 5).cast("string").alias("s"))
    one, two = ({r.row_key: r.group_id for r in mondrian(df, "row_key", ["a", "b"], 8, rule, "s", 2, 0.05, local_rows=n).collect()} for n in (100, 50_000))
    assert one == two and len(one) == 900
    assert all(g is None for k, g in one.items() if k % 10 < 3) and any(g for g in one.values())
    for odd in (df.union(df.limit(1)), df.union(df.limit(1).withColumn("row_key", F.lit(None).cast("long")))):
        for n in (100, 50_000):
            with pytest.raises(ValueError, match="row_key"):
                mondrian(odd, "row_key", ["a", "b"], 8, rule, "s", 2, local_rows=n)


def test_unknown_numbers_in_blocks(spark):
    df = spark.range(300).select(F.col("id").alias("row_key"), F.when(F.col("id") != 7, F.sqrt("id")).alias("a"), (F.col("id") % 5).cast("string").alias("s"))
    got = {r.row_key: r.group_id for r in microaggregate(df, "row_key", ["a"], "s", 8, 3, "strict").collect()}
    assert len(got) == 300 and [k for k, g in got.items() if g is None] == [7]


def test_runs_over_many_batches(spark):
    import pandas as pd

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 150).alias("g"))
        count = lambda pdf: pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(pdf)], "sorted": [bool(pdf["key"].is_monotonic_increasing)]})
        got = by_runs(df, ["g"], count, "g long, n long, sorted boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.g: r.n for r in got} == {r.g: r["count"] for r in df.groupBy("g").count().collect()} and all(r.sorted for r in got) and len(got) == 150
