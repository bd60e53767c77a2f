"""Periodic runs against brute force: every cut into appends, odd rows, the query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlane.llm import periods, queries


def brute(w):
    """Every stretch whose words equal those q later, for each q; a multiple of a smaller period of the same stretch is no period."""
    out = []
    for q in range(1, len(w) // 4 + 2):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q) and not any(s <= start and i + q <= e and q % p == 0 for s, e, p in out):
                out.append((start, i + q, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(r, n, kinds):
    w = []
    while len(w) < n:
        unit = [r.randrange(kinds) for _ in range(r.choice([1, 2, 3, 5, 7, 8, 9, 13]))]
        w += (unit * 8)[: r.randrange(1, 8 * len(unit))] if r.random() < 0.5 else [r.randrange(kinds)]
    return w[:n]


@pytest.mark.parametrize("step", [1, 3, 16, 1000])
def test_runs(step):
    r = random.Random(step)
    for _ in range(300):
        w = made(r, r.choice([0, 1, 5, 6, 7, 20, 60, 200]), r.choice([1, 2, 3, 5]))
        assert periods.runs_of(np.array(w, dtype=np.int64), step) == brute(w)


@pytest.mark.parametrize("words", [np.zeros(200_000), np.arange(200_000) % 7, np.arange(200_000) % 49_999, np.arange(200_000) // 6])
def test_long(words):
    got = periods.runs_of(words.astype(np.int64), 4096)
    assert len(got) == (33_333 if words[-1] == 33_333 else 1)
    assert got[0][0] == 0


def test_equal_names_are_compared_by_word(monkeypatch):
    monkeypatch.setattr(periods, "mix64", lambda x: x % np.uint64(2))  # nearly all blocks seem equal
    r = random.Random(8)
    for _ in range(60):
        w = made(r, 80, 4)
        assert set(periods.runs_of(np.array(w, dtype=np.int64), 7)) <= set(brute(w))


def expected(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def columns(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(data)).collect()}
    assert len(got) == len(docs)
    assert sum(r.n_runs > 0 for r in got.values()) > 5
    for d in docs:
        if len(d.text or "") < 6000:
            assert columns(got[d.doc_id]) == expected(d.doc_id, d.text)


def test_odd_rows(spark):
    r = random.Random(2)
    texts = [None, "", " \t\r\n", "a", "a a a a a a", "A a a a a a a", "x\x1cy \x85 \xa0", "é é é é é é", "b " * 5, *[" ".join(map(str, made(r, 300, 3))) for _ in range(40)], "u v w " * 50_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a a a a a a a"), (4, "a a a a a a"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_runs": F.lit("clash"), "start": F.lit(1)})
    got = periods.periodic_runs(df, change=periods.rotated).collect()
    assert len(got) == len(rows)
    long = [x for x in got if x.n_words > 100_000]
    assert [x.n_runs for x in long] == [1]
    assert sorted(map(str, map(columns, [x for x in got if x.n_words < 100_000]))) == sorted(str(expected(k, t)) for k, t in rows if len(t or "") < 100_000)
    assert periods.periodic_runs(df.limit(0)).count() == 0


def test_texts_and_lists(spark):
    df = spark.createDataFrame([(1, "say go on go on go on go on now")], "doc_id long, text string")
    row = periods.periodic_runs(df, keep=True).first()
    assert row.collapsed == "say go on now"
    assert [tuple(x) for x in row.runs] == [(1, 8, 2)]
