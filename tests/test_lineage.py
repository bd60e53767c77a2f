"""Contracted lineage against plain walks, and what its rounds keep."""

from random import Random

import pytest
from pyspark.sql import functions as F

from packetlane.operators import lineage

def middle():
    return F.substring("node", 1, 1) == "m"


def walked(edges):
    after = {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        if a[:1] == "m":
            continue
        todo, seen = list(after[a]), set()
        while todo:
            x = todo.pop()
            if x[:1] != "m":
                out.add((a, x))
            elif x not in seen:
                seen.add(x)
                todo += after.get(x, ())
    return out


def rows(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


@pytest.mark.parametrize("seed", range(3))
def test_contracted_against_walks(spark, seed):
    """Circles, loops, repeats, dead ends, nulls, edges between outer nodes."""
    rng = Random(seed)
    names = [*[f"m{k}" for k in range(30)], *[f"a{k}" for k in range(8)], ""]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(55 + 10 * seed)] + [("m1", "m1"), ("a1", "m1"), ("a1", "m1"), (None, "m2"), ("m2", None), ("a2", "a3")]
    got = [tuple(r) for r in lineage.contracted(rows(spark, edges), middle()).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(edges)


def test_contracted_without_inner_edges(spark):
    assert [tuple(r) for r in lineage.contracted(rows(spark, [("a", "m"), ("m", "b")]), middle()).collect()] == [("a", "b")]
    assert lineage.contracted(rows(spark, []), middle()).count() == 0
    assert lineage.contracted(rows(spark, [("m1", "m2"), ("m2", "m1"), ("a", "m1")]), middle()).count() == 0


def test_contracted_keeps_no_pairs_between(spark, monkeypatch):
    """No table of a round is larger than the edges, neither for a long chain nor for the many that enter a short one."""
    sizes, written = [], lineage.written

    def counted(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(lineage, "written", counted)
    chain = [("a", "m0"), *[(f"m{k}", f"m{k + 1}") for k in range(100)], ("m100", "b")]
    assert [tuple(r) for r in lineage.contracted(rows(spark, chain), middle()).collect()] == [("a", "b")]
    assert max(sizes) == len(chain)
    sizes.clear()
    many = [*[(f"a{k % 7}", f"mo{k}") for k in range(200)], *[(f"mo{k}", f"m{k % 20}") for k in range(200)], ("m0", "m50"), ("m50", "m51"), *[(f"m{k}", "b") for k in (*range(20), 51)]]
    assert len(lineage.contracted(rows(spark, many), middle()).collect()) == 7
    assert max(sizes) == len(many)
