import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graincloak.llm import collocations as phrases
from graincloak.llm import hard_negatives as negatives
from graincloak.llm import meeting, queries, vp_trees
from graincloak.llm.collocations import collocations, phrase_counts
from graincloak.llm.hard_negatives import hard_negatives
from graincloak.llm.vp_trees import Tree, nearest_neighbours
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, v string, shard int, n_cuts int"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_vp_trees", "op13_slot_negatives"])
def test_equal_to_sql(spark, small, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], small)


def odd_vectors(seed=3):
    """Clusters, copies, ties, repeated ids, and everything that takes no part."""
    rng, nan, inf = np.random.default_rng(seed), float("nan"), float("inf")
    x = (rng.integers(-3, 4, (300, 4)) / 4).tolist() + (rng.normal(size=(300, 4)) * 0.01 + 5).tolist() + [[1.0, 2.0, 3.0, 4.0]] * 200
    rows = [(i, [float(np.float32(v)) for v in r], int(rng.integers(0, 4))) for i, r in enumerate(x)]
    rows += [(0, [9.0, 9.0, 9.0, 9.0], 1), (20, rows[20][1], 2), (21, rows[21][1], rows[21][2]), (-40, [1.0, 2.0], 1), (-60, [2.0, 1.0], 0), (-80, [2.0, 2.0], 1)]
    rows += [(1000, None, 1), (1020, [1.0, None, 0.0, 0.0], 1), (1040, [nan, 0.0, 0.0, 0.0], 1), (1060, [inf, 0.0, 0.0, 0.0], 1), (1080, [0.0] * 4, 1), (None, [1.0] * 4, 1), (1100, [], 2), (1120, [1.0, 1.0, 1.0, 1.0], None), (1140, [2.0**127, 2.0**127, 1.0, 1.0], 3), (1160, [2.0**127, 1.0, 1.0, 1.0], 3)]
    return rows


def usable(rows, zero):
    return [(i, np.array(v, float), c) for i, v, c in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or np.any(v))]


@pytest.mark.parametrize("cores", [1, 5])
def test_neighbours_of_odd_rows(spark, cores, monkeypatch):
    """Equal to the distances of all pairs, however many shards there are; a hot vector is cut over several."""
    monkeypatch.setattr(meeting, "LEAST", 100)
    monkeypatch.setattr(vp_trees, "LEAST", 100)
    monkeypatch.setattr(meeting, "SHARD", (64 << 20) // cores**5)
    monkeypatch.setattr(vp_trees, "SAMPLE", 64)
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=4).collect())
    good, want, asked = usable(rows, False), [], {}
    for i, v, _ in good:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, (float("inf"),)), tuple(v))
    for i, q in asked.items():
        far = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(q, v)))), j) for j, v, _ in good if j != i and len(v) == len(q))
        want += [(i, r + 1, j, d) for r, (d, j) in enumerate(far[:4])]
    assert got == sorted(want)
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_relaxed_pruning():
    """Factor one finds all; larger factors look at fewer nodes and still find most in data with clusters."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(250, 16)) for c in centres])
    ids, q = np.arange(len(x)), x[::100]
    tree, found, looked = Tree(ids, x, 11), {}, {}
    for factor in (1.0, 2.0, 8.0):
        calls, plain = [0], vp_trees.squares

        def counted(a, b, calls=calls, plain=plain):
            calls[0] += len(a) * len(b)
            return plain(a, b)

        vp_trees.squares = counted
        at, near, _ = tree.search(ids[::100], q, np.full(len(q), np.inf), 10, factor)
        vp_trees.squares = plain
        found[factor], looked[factor] = set(zip(at.tolist(), near.tolist())), calls[0]
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    d[np.arange(len(q)), ids[::100]] = np.inf
    want = {(i, int(j)) for i in range(len(q)) for j in np.argsort(d[i])[:10]}
    assert found[1.0] == want and looked[1.0] < len(q) * len(x) / 4
    assert looked[8.0] < looked[2.0] < looked[1.0] and len(found[2.0] & want) > 0.9 * len(want)


@pytest.mark.parametrize("cores", [1, 5])
def test_negatives_of_odd_rows(spark, cores, monkeypatch):
    monkeypatch.setattr(meeting, "LEAST", 100)
    monkeypatch.setattr(meeting, "SHARD", (64 << 20) // cores**5)
    monkeypatch.setattr(negatives, "CELLS", 20_000 // cores)
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 20 == 0).collect())
    whole = [(i, [int(np.floor(256 * a)) for a in v], str(c)) for i, v, c in usable(rows, True) if c is not None]
    plain = {(i, c): v for i, v, c in usable(rows, True) if c is not None}
    anchors = {}
    for (i, c), v in plain.items():
        if i % 20 == 0:
            anchors[i] = min(anchors.get(i, ("~",)), (str(c), tuple(v)))
    want, most = [], 2**63 - 1
    for i, (label, v) in anchors.items():
        q = [int(np.floor(256 * a)) for a in v]
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q, w)))), j, c) for j, w, c in whole if j != i and len(w) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            want += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(inside)]
    assert got == sorted(want) and any(abs(r[4]) == most for r in got) and any(r[0] == -80 for r in got)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def counted(rows, most=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, " ".join(w[i : i + k])] += 1
    return f, n


ODD = [("New York, new york. NEW\tYORK\x0bnew  york!" * 3, "en"), (None, "en"), ("", None), ("une été É Été été", None), ("a a a a a a a a", "en"), ("x" * 50_000 + " y", "de"), ("new york city " * 2000, "und"), ("a\x00b ￾ c ", "en")]


@pytest.mark.parametrize(("bits", "held"), [(64, 2_000_000), (7, 40)])
def test_phrase_counts(spark, bits, held, monkeypatch):
    """Counts are those of texts, also where fingerprints of many phrases collide and where tasks hold few of them."""
    monkeypatch.setattr(phrases, "HELD", held)
    rows = [r for r in ODD for _ in range(12)]
    df = spark.createDataFrame([(i % 5, t, lang, "k", 1) for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string, key string, mark int").repartition(4)
    got, words = phrase_counts(df, bits=bits)
    f, n = counted(rows)
    assert {(r.lang, r.phrase): r.f for r in got.collect()} == {k: v for k, v in f.items() if v >= 30}
    assert {r.lang: r.n for r in words.collect() if r.n} == {k: v for k, v in n.items() if v}
    assert collocations(df.limit(0)).count() == 0
