"""What keeps large tables cheap: few jobs a level, equal rows and boxes met once, no sort of all shuffled orders."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graincloak.config import People
from graincloak.operators import mondrian as module
from graincloak.operators import remainder
from graincloak.operators.metrics import attacks, linkage
from graincloak.operators.mondrian import mondrian, rank_leaves


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("text", [False, True])
def test_few_jobs_for_levels_with_exact_cuts(spark, text, monkeypatch):
    """Tied numbers in the middle, whole and other keys, brackets narrowed several times; levels cost a bounded number of jobs."""
    monkeypatch.setattr(module, "FEW", 200, raising=False)
    monkeypatch.setattr(module, "BINS", 2048, raising=False)
    key = F.format_string("%09d", F.col("id") * 7919 % 3001) if text else F.col("id") * 7919 % 3001 - 1500
    df = spark.range(3001).select(key.alias("row_key"), (F.col("id") % 3).cast("double").alias("a"), F.exp(F.col("id") % 700).alias("b"), F.sqrt(F.col("id") * 31 % 3001).alias("c")).persist()
    pdf = df.toPandas().sort_values("row_key", ignore_index=True)
    keys = pdf.row_key.to_numpy()
    want = {k: g for g, rows in rank_leaves(pdf[["a", "b", "c"]].to_numpy(), keys, 1, 8).items() for k in keys[rows]}
    got = {r.row_key: r.group_id for r in mondrian(df.repartition(5), "row_key", ["a", "b", "c"], 8, local_rows=1000).collect()}
    assert got == want
    if not text:
        monkeypatch.undo()
        _, n = jobs_of(spark, "levels", lambda: mondrian(df, "row_key", ["a", "b", "c"], 8, local_rows=1000))
        assert n <= 30, n  # two levels


def test_equal_rows_and_boxes_meet_once(spark):
    who = People("k", ("a",), ("c",), "s")
    boxes = spark.range(600).select(F.lit(8).cast("long").alias("group_size"), (F.col("id") % 3).cast("double").alias("a_lo"), (F.col("id") % 3 + 1).cast("double").alias("a_hi"), F.array(F.lit("x")).alias("c_set"))
    rows = spark.range(900).select(F.col("id").alias("k"), (F.col("id") % 4).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, "x").alias("c"), F.lit("s").alias("s"))
    got = {r.k: r for r in linkage(boxes, rows, who, tested=True).collect()}
    assert len(got) == 900 and max(r.n_tested for r in got.values()) <= 3
    for k, r in got.items():
        n = 0 if k % 5 == 0 else sum(lo <= k % 4 <= lo + 1 for lo in range(3)) * 200
        assert (r.n_match, r.rows_match) == (n, 8 * n)


def test_samples_without_a_sort_of_all_orders(spark):
    n, rng = 700, np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), int(rng.integers(0, 40))) for i in range(n)]
    got = attacks(spark.createDataFrame(rows, "k long, n_match long, rows_match long").persist(), "k", (0.001, 0.1, 0.5), range(2))
    assert "rangepartitioning" not in got._jdf.queryExecution().toString().lower()
    want = {}
    for s in range(2):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}-{s}".encode()).hexdigest(), r[0]))
        for f in (0.001, 0.1, 0.5):
            some = order[: max(1, int(n * f))]
            want[f, s] = (len(some), round(sum(r[1] == 1 for r in some) / len(some), 9), round(sum(1 / r[2] if r[2] else 0 for r in some) / len(some), 9))
    assert {(r.frac, r.seed): (r.n_external, round(r.umr, 9), round(r.err, 9)) for r in got.collect()} == want


def test_only_rows_that_get_a_seat_ask(spark, monkeypatch):
    """Far more rows than seats: the first rows in order of the key get them; no other row is compared with a group."""
    asked = []
    real = remainder.near
    monkeypatch.setattr(remainder, "near", lambda rows, *more: (asked.append(rows.count()), real(rows, *more))[1])
    rows = spark.range(2000).select(F.col("id").alias("row_key"), (F.col("id") * 37 % 101 / 10).alias("a"))
    centres = spark.range(12).select(F.col("id").alias("group_id"), F.lit(6).cast("long").alias("size"), F.col("id").cast("double").alias("c_a"))
    held, left = remainder.place_with_seats(rows.repartition(5), centres, "row_key", ["a"], 8)
    free, want = dict.fromkeys(range(12), 2), {}
    for k in range(2000):
        best = min(((round(abs(k * 37 % 101 / 10 - g), 9), g) for g in free if free[g]), default=None)
        if best:
            want[k] = best[1]
            free[best[1]] -= 1
    assert {r.row_key: r.group_id for r in held.collect()} == want and left.count() == 2000 - 24
    assert max(asked) <= 24
