"""Hard negatives against brute force and SQL."""

import math

import numpy as np
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from packetlane.llm import negatives, queries


def brute(rows):
    e = [(u, i, lab, [math.floor(256 * x) for x in v]) for u, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    e = [r for r in e if sum(x * x for x in r[3]) < 2**62]
    out = []
    for u, i, lab, v in e:
        if i % 50:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, x, k) for x, j, k, w in e if x != u and len(w) == len(v))
        for s, pid, _, _ in [o for o in others if o[3] == lab][:5]:
            hits = [o for o in others if o[3] != lab and 50 * -s <= 100 * -o[0] <= 95 * -s][:3]
            out += [(i, pid, k, o[1], -s, -o[0]) for k, o in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "leaf", "spread"), [(8192, 24, 0.2), (40, 2, 0.05), (100, 3, 1.0)])
def test_same_as_brute_force(spark, monkeypatch, block, leaf, spread):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    r = np.random.default_rng(leaf)
    centres = r.normal(size=(6, 5))
    rows = []
    for k in range(600):
        c = int(r.integers(6))
        v = (centres[c] + spread * r.normal(size=5)) * (0.5 + r.random())
        rows.append((k, [float(x) for x in v], int(r.integers(3)) if k % 3 else c % 3))
    rows += [(1000 + k, [1.0, 0.5, 0.25, 0.0, -1.0], k % 2) for k in range(80)]  # equal vectors
    rows += [(2000, None, 1), (2050, [1.0, None, 0.0, 0.0, 0.0], 1), (2100, [float("nan")] * 5, 1), (2150, [float("inf")] * 5, 0), (None, [1.0] * 5, 0), (2200, [1.0] * 5, None), (2250, [0.0] * 5, 1), (2300, [1.0, 2.0], 0), (2301, [1.0, 2.1], 0), (2302, [0.9, 1.5], 1), (2350, [], 0), (2351, [], 0), (2352, [], 1), (2400, [1e300] * 5, 0), (50, [0.3] * 5, 2), (2450, [3e6, -1.0, 2e6, 0.0, 1.0], 0), (2451, [3e6, 5.0, 2e6, 0.0, 1.0], 0), (2452, [2e6, -1.0, 2e6, 7.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).withColumns({"width": F.lit("clash"), "uid": F.lit(1), "number": F.lit(2)})
    got = negatives.hard_negatives(df, F.col("id") % 50 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_tree_covers_and_skips():
    r = np.random.default_rng(1)
    v = np.floor(256 * (np.repeat(r.normal(size=(40, 16)), 50, axis=0) + 0.05 * r.normal(size=(2000, 16)))).astype(np.int64)
    n = np.arange(2000)
    tree = negatives.CoverTree.load(negatives.CoverTree.build(v, n, n, n % 3, 6).dump())
    assert (tree.children > 0).sum() > 40
    anchors = v[::100]
    low, high = tree.bounds(anchors)
    products = anchors @ tree.points.T
    for k, (a, b) in enumerate(zip(tree.first, tree.last, strict=True)):
        assert (products[:, a:b] >= low[:, [k]]).all()
        assert (products[:, a:b] <= high[:, [k]]).all()
    seen: dict = {}
    tree.best(anchors[3], 0, True, 300, 5, -np.inf, np.inf, low[3].tolist(), high[3].tolist(), seen)
    assert sum(map(len, seen.values())) < 500  # of 2,000


def test_query(spark, data):
    same_rows(queries.op11_hard_negatives(spark, str(data)), negatives.SQL, data)
    assert queries.op11_hard_negatives(spark, str(data)).count() > 30
