import numpy as np
import pytest

from graincloak.operators.metrics import parse_range, parse_set
from graincloak.operators.mondrian import median_leaves, mondrian, rank_leaves, total_leaves
from graincloak.operators import boxes, remainder
from graincloak.operators.remainder import near, nearest, place_with_seats
from pyspark.sql import functions as F


def test_median_rules():
    x, sa = np.arange(8.0)[:, None], np.array(list("abcabcab"))
    assert len(median_leaves(x, sa, 1, 4, 3, 0.0)) == 1 and len(median_leaves(x, sa, 1, 8, 3, 0.0)) == 1
    assert median_leaves(x, np.array(["a"] * 8), 1, 4, 2, 0.0) == {}
    assert median_leaves(x, sa, 1, 3, 3, 100.0) == {}
    assert sorted(len(r) for r in median_leaves(x, sa, 1, 2, 2, 0.0).values()) == [4, 4]


def test_big_nodes_and_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("row_key"), (F.col("id") % 7).cast("double").alias("a"), F.sqrt("id").alias("b"))
    one = mondrian(df.repartition(5), "row_key", ["a", "b"], 8, local_rows=500)
    sizes = [r["count"] for r in one.groupBy("group_id").count().collect()]
    assert sum(sizes) == 3000 and min(sizes) >= 8 and max(sizes) <= 16
    pdf = df.toPandas()
    want = {k: g for g, rows in rank_leaves(pdf[["a", "b"]].to_numpy(), pdf.row_key.to_numpy(), 1, 8).items() for k in pdf.row_key.to_numpy()[rows]}
    assert {r.row_key: r.group_id for r in mondrian(df.repartition(7), "row_key", ["a", "b"], 8).collect()} == want


@pytest.mark.parametrize("rule", ["rank", "median", "total"])
def test_big_nodes_are_cut_like_small_ones(spark, rule):
    df = spark.range(4001).select(F.concat(F.lit("k"), F.col("id") * 7919 % 4001).alias("row_key"), (F.col("id") % 7).cast("double").alias("a"), F.sqrt(F.col("id") * 31 % 4001).alias("b"), (F.col("id") % 5).cast("string").alias("s"))
    pdf = df.toPandas().sort_values("row_key", ignore_index=True)
    x, keys, sa = pdf[["a", "b"]].to_numpy(), pdf.row_key.to_numpy(), pdf.s.to_numpy()
    leaves = {"rank": lambda: rank_leaves(x, keys, 1, 8), "median": lambda: median_leaves(x, sa, 1, 8, 3, 0.05), "total": lambda: total_leaves(x, sa, 1, 8, 3, 1.0, "keep", 42)}[rule]()
    want = dict.fromkeys(keys) | {k: g for g, rows in leaves.items() for k in keys[rows]}
    got = mondrian(df.repartition(5), "row_key", ["a", "b"], 8, rule, "s", 3, 0.05 if rule == "median" else 1.0, local_rows=600)
    assert {r.row_key: r.group_id for r in got.collect()} == want


@pytest.mark.parametrize("rule", ["rank", "median", "total"])
@pytest.mark.parametrize("hot", ["all", "largest", "one"])
def test_tied_values_in_big_nodes(spark, rule, hot):
    x = {"all": [F.lit(3.0)] * 2, "largest": [F.when(F.col("id") % 3 > 0, 9.0).otherwise(F.col("id") % 9), F.lit(1.0)], "one": [F.when(F.col("id") == 0, 9e3).otherwise(1.0), F.lit(1.0)]}[hot]
    df = spark.range(2000).select(F.col("id").alias("row_key"), *(v.cast("double").alias(c) for v, c in zip(x, "ab")), (F.col("id") % 5).cast("string").alias("s"))
    pdf = df.toPandas()
    x, keys, sa = pdf[["a", "b"]].to_numpy(), pdf.row_key.to_numpy(), pdf.s.to_numpy()
    leaves = {"rank": lambda: rank_leaves(x, keys, 1, 8), "median": lambda: median_leaves(x, sa, 1, 8, 3, 0.0), "total": lambda: total_leaves(x, sa, 1, 8, 3, 1.0, "keep", 42)}[rule]()
    want = dict.fromkeys(keys) | {k: g for g, rows in leaves.items() for k in keys[rows]}
    got = mondrian(df.repartition(3), "row_key", ["a", "b"], 8, rule, "s", 3, 1.0 if rule == "total" else 0.0, local_rows=500)
    assert {r.row_key: r.group_id for r in got.collect()} == want


def test_seats(spark):
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(9)], "row_key long, z double")
    centres = spark.createDataFrame([(1, 6, 0.0), (2, 7, 1.0), (3, 5, 3.0)], "group_id long, size long, c_z double")
    held, left = place_with_seats(rows, centres, "row_key", ["z"], 8)
    free, want = {1: 2, 2: 1, 3: 3}, {}
    for k in range(9):
        best = sorted((abs(k % 4 - c), g) for g, c in ((1, 0.0), (2, 1.0), (3, 3.0)) if free[g])
        if best:
            want[k] = best[0][1]
            free[best[0][1]] -= 1
    assert {r.row_key: r.group_id for r in held.collect()} == want
    assert {r.row_key for r in left.collect()} == set(range(9)) - want.keys()


@pytest.mark.parametrize(("seats", "task"), [(2, 200_000), (1, 90)])
def test_seats_of_a_dense_region(spark, seats, task, monkeypatch):
    """Tight seats and short lists, settled in one task or, where that holds too few rows, by rounds."""
    monkeypatch.setattr(remainder, "TASK", task)
    monkeypatch.setattr(remainder, "PAIRS", 500)
    groups = [(g, 0, g * 0.01, float(g % 3)) for g in range(70)]
    points = [(k, k * 37 % 11 * 0.001, 0.0) for k in range(145 if seats == 2 else 68)]  # nearly all want the same groups
    held, left = place_with_seats(spark.createDataFrame(points, "row_key long, a double, b double").repartition(3), spark.createDataFrame(groups, "group_id long, size long, c_a double, c_b double").repartition(4), "row_key", ["a", "b"], seats, m=16)
    free, want = dict.fromkeys(range(70), seats), {}
    for k, a, b in points:
        best = min(((round(((a - x) ** 2 + (b - y) ** 2) ** 0.5, 9), g) for g, _, x, y in groups if free[g]), default=None)
        if best:
            want[k] = best[1]
            free[best[1]] -= 1
    assert {r.row_key: r.group_id for r in held.collect()} == want
    assert {r.row_key for r in left.collect()} == {k for k, *_ in points} - want.keys()


def test_nearest_in_blocks_of_centres(spark, monkeypatch):
    """Many blocks, cut by a hash where many rows visit one, give what all pairs give; unknown numbers have no nearest."""
    monkeypatch.setattr(boxes, "LEAST", 20)
    monkeypatch.setattr(boxes, "SHARE", 30)
    rows = spark.range(150).select(F.col("id").alias("row_key"), (F.col("id") * 0.37 % 5).alias("a"), F.when(F.col("id") != 7, F.col("id") % 3 * 0.5).alias("b"))
    centres = spark.range(400).select(F.col("id").cast("string").alias("group_id"), F.when(F.col("id") != 3, F.col("id") % 20 * 0.25).alias("c_a"), (F.col("id") % 7 * 0.25).alias("c_b"))
    got = {r.row_key: [(x.d, x.group_id) for x in r.near] for r in near(rows, centres, "row_key", ["a", "b"], 3).collect()}
    known = [(str(g), g % 20 * 0.25, g % 7 * 0.25) for g in range(400) if g != 3]
    assert got == {r.row_key: sorted((round(((r.a - x) ** 2 + (r.b - y) ** 2) ** 0.5, 9), g) for g, x, y in known)[:3] for r in rows.collect() if r.b is not None}
    one = {r.row_key: r.group_id for r in nearest(rows, centres, "row_key", ["a", "b"]).collect()}
    assert one == {i: got[i][0][1] if i != 7 else None for i in range(150)}
    assert near(rows, centres.limit(0), "row_key", ["a", "b"]).count() == 0


def test_parsers(spark):
    df = spark.createDataFrame([("[22,26]",), ("[35]",), ("19.5",), ("x",), ("a\\b",), ("a,b",), ("[1,3]",)], "t string")
    got = df.select("t", parse_range(F.col("t")).alias("r"), parse_set(F.col("t")).alias("s")).collect()
    assert [tuple(r.r) for r in got[:4]] == [(22.0, 26.0), (35.0, 35.0), (19.5, 19.5), (None, None)]
    assert [r.s for r in got[4:]] == [["a", "b"], ["a", "b"], ["1", "2", "3"]]


def test_linear_encoder(spark):
    from graincloak.functions.latent import encode, principal

    x = np.random.default_rng(1).normal(size=(200, 4)) @ np.diag([5, 1, 3, 0.1])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double, d double")
    got = np.array([tuple(r) for r in encode(df, list("abcd"), principal(df, list("abcd"), 2)).orderBy("k").select("latent_0", "latent_1").collect()])
    middle = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(middle, full_matrices=False)
    want = middle @ axes[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_trained_encoder(spark):
    from graincloak.functions.latent import autoencoder, encode, gradients

    rng = np.random.default_rng(4)
    layers = [(rng.normal(size=(3, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2)), (rng.normal(size=(2, 5)), rng.normal(size=5)), (rng.normal(size=(5, 3)), rng.normal(size=3))]
    x = rng.normal(size=(7, 3))
    scale = np.array([1.0, 2.0, 0.5])
    flat, at = gradients(layers, x, scale), 1
    for w, b in layers:  # against differences
        for part in (w, b):
            for i in range(0, part.size, 3):
                old, ends = part.flat[i], []
                for d in (1e-6, -1e-6):
                    part.flat[i] = old + d
                    ends.append(gradients(layers, x, scale)[0])
                part.flat[i] = old
                assert abs((ends[0] - ends[1]) / 2e-6 - flat[at + i]) < 1e-4
            at += part.size
    base = rng.normal(size=(400, 2))
    rows = [(i, *map(float, r)) for i, r in enumerate(np.concatenate([base, base @ rng.normal(size=(2, 2))], axis=1))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    cols = list("abcd")
    for share in (50_000, 100):  # one share, and four whose weights are averaged
        first, losses = autoencoder(df.repartition(3), "k", cols, 2, epochs=12, batch=32, rounds=3, share=share)
        again, same = autoencoder(df.repartition(8), "k", cols, 2, epochs=12, batch=32, rounds=3, share=share)
        assert losses == same and all((w == v).all() and (b == c).all() for (w, b), (v, c) in zip(first, again))
    assert autoencoder(df.limit(0), "k", cols, 2)[1] == []
    got = np.array([tuple(r)[5:] for r in encode(df, cols, first).orderBy("k").collect()])
    x = np.array([r[1:] for r in rows])
    assert np.allclose(got, np.maximum(x @ first[0][0] + first[0][1], 0) @ first[1][0] + first[1][1])


@pytest.mark.parametrize(("share", "times"), [(50_000, 1.0), (400, 1.05)])
def test_trained_encoder_is_no_worse_than_linear(spark, small, share, times):
    from graincloak.functions.latent import autoencoder
    from graincloak.queries import DIMS, encoded

    rows = encoded(spark, small)
    x = np.array(rows.select(*DIMS).toPandas())
    linear = np.linalg.eigvalsh(np.cov(x.T, bias=True))[:-3].sum() / x.shape[1]
    assert autoencoder(rows, "row_key", DIMS, 3, share=share)[1][-1] < times * linear
    narrow = autoencoder(rows, "row_key", DIMS, 3, hidden=(4,), share=share)[1]  # no room for a linear start
    assert narrow[-1] < narrow[0]


@pytest.mark.parametrize("least", [2048, 40])
def test_linkage_with_wide_groups(spark, least, monkeypatch):
    """Groups of all widths against every row, by plain comparison, in one block and in many; unknown values meet nothing."""
    monkeypatch.setattr(boxes, "LEAST", least)
    monkeypatch.setattr(boxes, "SHARE", least)
    from graincloak.config import People
    from graincloak.operators.metrics import linkage, with_size

    rng = np.random.default_rng(6)
    who = People("k", ("a", "b"), ("c",), "s")
    groups = []
    for i in range(300):
        lo, width = rng.uniform(0, 100, 2), rng.choice([0, 0.1, 1, 30, 100], 2)
        groups.append((int(rng.integers(1, 9)), *(float(v) for p in zip(lo, lo + width) for v in p), sorted({f"v{j}" for j in rng.integers(0, 40, int(rng.choice([1, 2, 30])))})))
    rows = [(i, float(rng.uniform(-5, 150)), float(rng.uniform(0, 120)), f"v{rng.integers(0, 42)}", "x") for i in range(400)]
    released = spark.createDataFrame(groups, "group_size long, a_lo double, a_hi double, b_lo double, b_hi double, c_set array<string>")
    rows += [(400, None, 50.0, "v1", "x"), (401, 50.0, 50.0, None, "x"), (402, 50.0, 50.0, "", "x")]
    external = spark.createDataFrame(rows, "k long, a double, b double, c string, s string")
    want, plain = {}, {}
    for k, a, b, c, _ in rows:
        near = [g for g in groups if a is not None and g[1] <= a <= g[2] and g[3] <= b <= g[4]]
        plain[k] = len(near)
        want[k] = (len(hit := [g[0] for g in near if c in g[5]]), sum(hit))
    assert {r.k: r.n_match for r in linkage(released, external, People("k", ("a", "b"), (), "s")).collect()} == plain
    assert linkage(released.limit(0), external, who, tested=True).agg(F.sum("n_match") + F.sum("n_tested")).first()[0] == 0
    assert {r.k: (r.n_match, r.rows_match) for r in linkage(released, external, who).collect()} == want and any(n for n, _ in want.values())
    assert {r.group_size for r in with_size(released.drop("group_size")).collect()} == {8}
