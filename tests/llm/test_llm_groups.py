"""Operators on pairs and groups of rows against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlane.llm import bwt, embeddings, graph, minhash, mixing, store, substrings, tools


def words_of(t):
    low = (t or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def closure(ids, linked):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " \t", "Same words", "same WORDS", "one two three four", "é b c d e f"]
    for _ in range(12):
        base = r.choices(vocabulary, k=r.choice([8, 60, 300]))
        for _ in range(r.choice([1, 4, 40])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    out.append(" ".join(r.choices(vocabulary, k=30_000)))
    return out


@pytest.mark.parametrize("small", [2, 32])
def test_minhash(spark, texts, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)  # 2: nearly all buckets go to tiles
    monkeypatch.setattr(minhash, "LARGE", small)  # and most classes of copies are broadcast
    sets = [words_of(t) for t in texts]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    want = closure(range(len(texts)), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"component_id": F.lit("clash"), "bands": F.lit(1)})
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_empty_null_and_repeated(spark):
    one, two = "a b c d e f g", "h i j k l m n"
    rows = [(1, "a b"), (1, "a b"), (2, "A B"), (None, "a b"), (None, one), (7, one), (7, two), (8, two), (5, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(df).collect()), key=repr)
    want = [(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (None, None, 1, True), (None, None, 3, True), (5, 5, 3, True), (8, 5, 3, False)] + [(7, 5, 3, False)] * 2
    assert got == sorted(want, key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_beyond_the_bitmap(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash, "FILTER_BITS", 16)  # texts and ids are joined
    monkeypatch.setattr(minhash, "HELD_KEYS", 100)
    monkeypatch.setattr(minhash, "PART_KEYS", 100)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == want


def test_sketches_fill():
    s = minhash.sketches([np.arange(n, dtype=np.uint64) * 7919 + 1 for n in (1, 3, 50, 2000)])
    assert (s != minhash._NONE).all()
    assert minhash.sketches([np.zeros(0, dtype=np.uint64)]).shape == (1, minhash.COORDINATES)


def brute_cut(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [3, 2000])
def test_substrings(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)  # 3: most anchors count as hot
    r = random.Random(6)
    passage = ["".join(r.choices("abcde é", k=k)) for k in (49, 50, 51, 80, 200)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 300), (4, "x" * 120), (5, "ab" * 200), (6, "ba" * 100), (7, "\x00" * 90), (8, "\x00" * 60)]
    for i in range(9, 60):
        rows.append((i, "".join(r.choices("abcdefg ", k=r.randrange(150))) + "".join(r.choices(passage, k=2)) + "".join(r.choices("abcdefg ", k=r.randrange(99)))))
    rows += [(i + 100, t) for i, t in rows[3:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"whole": F.lit("clash"), "found": F.lit(1)})
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.dedup(df, carry=["whole"]).collect()}
    assert got == brute_cut(rows)
    assert substrings.dedup(df.limit(0)).count() == 0


def test_substrings_null_ids_long_texts_and_whole_characters(spark):
    r = random.Random(8)
    long = "".join(r.choices("abcdefghij ", k=3 << 20))  # more than one chunk
    # 60 equal bytes begin inside the first é and end inside the last one
    left, right = "\u00e9" + "x" * 58 + "\u00e9", "\u0129" + "x" * 58 + "\u00ea"
    rows = [(None, long), (None, long), (1, long), (2, "head " + long[1000:2_500_000] + " tail"), (3, None), (4, left), (5, right)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in substrings.dedup(df).collect()), key=repr)
    cut = brute_cut([x for x in rows if x[0]])
    kept = (None, len(long), 0, hashlib.sha256(long.encode()).hexdigest())
    assert got == sorted([kept, kept] + [(i, c[0], c[1], c[3]) for i, c in cut.items()], key=repr)
    assert cut[5][1] == 60 and {x.doc_id: bytes(x.kept).decode() for x in substrings.dedup(df.where("doc_id >= 4"), keep_text=True, characters=True).collect()} == {4: left, 5: "\u0129\u00ea"}


def test_bwt_classes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 60, 200):
        t = rng.integers(97, 100, n).astype(np.uint16)
        for least in (1, 4, 9):
            c = bwt.equal_classes(t, least)
            s = [t[i : i + least].tobytes() for i in range(max(0, n - least + 1))]
            assert all((c[i] == c[j]) == (s[i] == s[j]) for i in range(len(s)) for j in range(i))


@pytest.mark.parametrize("tile", [16, 64, 2048])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    v = np.vstack([base, base[:20] + rng.normal(scale=0.25, size=(20, 24)), base[:1] + rng.normal(scale=0.1, size=(60, 24)), base[:3]])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [float("inf")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, []), (906, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "tile": F.lit("clash")})
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = closure(range(len(v)), zip(*map(list, np.nonzero(link)), strict=True))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, tile=tile).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_links == link[i].sum() and got[i].component_id == want[i] and got[i].kept == (i == want[i]) for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 907))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    rows = [(None, a), (None, a), (3, a), (3, a), (3, c), (5, b), (4, c), (9, [2.0, 0.0])]
    want = [(None, 0, None, True)] * 2 + [(3, 3, 3, True)] * 2 + [(3, 1, 3, True), (4, 1, 3, False), (5, 3, 3, False), (9, 3, 3, False)]
    for kind in ("float", "double"):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_tiles_of_alike_vectors_need_little_memory(spark, monkeypatch):
    n, width = 3000, 48
    v = np.ones((n, width)) + np.random.default_rng(3).normal(scale=0.01, size=(n, width))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(rows, tile=1500).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id} == {(n - 1, 0, False)} and len(got) == n


def test_forest():
    r = random.Random(3)
    for n in (1, 2, 30, 200):
        a, b = (np.array([r.randrange(n) for _ in range(n)]) for _ in range(2))
        label = np.arange(n)
        first = embeddings.forest(label, a[: n // 2], b[: n // 2])
        second = embeddings.forest(label, a[n // 2 :], b[n // 2 :]) + n // 2
        kept = np.concatenate([first, second])
        want = closure(range(n), list(zip(a.tolist(), b.tolist(), strict=True)))
        assert closure(range(n), list(zip(a[kept].tolist(), b[kept].tolist(), strict=True))) == want
        assert len(kept) == n - len(set(want.values())) and all((label[i] == label[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 520)] + [(5, 5)]
    want = closure({x for e in edges for x in e}, edges)
    got = {x.id: x.component_id for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in want.items() if k in got} == got and all(k in got for k, v in want.items() if v != k)


@pytest.mark.parametrize("shape", ["path", "zigzag", "star"])
def test_components_take_few_rounds(spark, shape, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "written", lambda df: tables.append(1) or graph_written(df))
    graph_written = store.written
    n = 2000
    place = {"path": range(n), "zigzag": [i // 2 if i % 2 else n - i // 2 for i in range(n)]}.get(shape)
    edges = [(n, i) for i in range(n)] if shape == "star" else list(zip(place, list(place)[1:]))
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x for e in edges for x in e}) and {x.component_id for x in got} == {min(x for e in edges for x in e)}
    assert len(tables) < 30


def test_mixing_meets_targets(spark):
    rows = [(i, "word " * (1 + i % 9), f"s{i % 3}" if i % 5 else None, "ab"[i % 2]) for i in range(600)] + [(1000, None, "s0", "a"), (1001, "", "s0", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"weight": F.lit("clash")})
    goal = {"lang": {"a": 0.3, "b": 0.7}}
    out = mixing.mix(df, targets=goal, topics=F.lit("t"), budget=0.3, rounds=12)
    got = out.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability") * F.col("weight")).alias("w")).collect()
    total = sum(r.w for r in got)
    assert abs({r.lang: r.w / total for r in got}["a"] - 0.3) < 1e-3
    assert out.count() == len(rows) and out.where("tokens = 0").count() == 2
    kept = out.where("sampled").agg(F.sum("tokens")).first()[0] / out.agg(F.sum("tokens")).first()[0]
    assert 0.2 < kept < 0.4
    assert mixing.mix(df.limit(0)).count() == 0
    again = mixing.mix(df, targets=goal, topics=F.lit("t"), budget=0.3, rounds=12, drop_text=True)
    assert "text" not in again.columns and sorted(map(tuple, again.drop("weight").collect()), key=repr) == sorted(map(tuple, out.select(again.drop("weight").columns).collect()), key=repr)


def test_mixing_residuals(spark, data):
    out = corpus = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"), drop_text=True)
    for dim in ("source", "lang", "topic"):
        got = mixing.residuals(corpus, dim).collect()
        assert abs(sum(r.got for r in got) - 1) < 1e-9 and max(r.residual for r in got) < 1e-3, (dim, got)
    assert mixing.residuals(out.limit(0), "lang").count() == 0


def test_bounded_mixing_meets_budget_and_targets_without_weights(spark):
    rows = [(i, "w " * 10, "a" if i < 900 else "b", "x" if i % 10 else "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = F.sum(F.col("tokens") * F.col("probability"))

    def shares(goal, budget):
        out = mixing.mix(df, targets=goal, topics=F.lit("t"), budget=budget, bounded=True)
        assert out.where("probability > 1 or weight != 1").isEmpty() and out.count() == 1000
        total = out.agg(kept).first()[0]
        assert abs(total - budget * 10_000) < 1
        return {d: {r[0]: r[1] / total for r in out.groupBy(d).agg(kept).collect()} for d in ("source", "lang")}

    # the cell (b, y) would need a probability of 2.4: it is held at 1 and the cell (b, x) makes up for it
    got = shares({"source": {"a": 0.84, "b": 0.16}, "lang": {"x": 0.85, "y": 0.15}}, 0.6)
    assert abs(got["source"]["b"] - 0.16) < 1e-3 and abs(got["lang"]["y"] - 0.15) < 1e-3
    # b has a tenth of all tokens, half of what its goal asks for: kept whole, and the budget still holds
    assert abs(shares({"source": {"a": 0.75, "b": 0.25}}, 0.8)["source"]["b"] - 0.125) < 1e-3
    assert mixing.mix(df.limit(0), bounded=True).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "add", '{"y": 2, "x": 1}', []), (1, 2, "b", "add", '{"x": "no"}', ["a", "zz"]), (1, 4, "c", "none", "[1]", ["b", "a"]), (1, 4, "c", "none", "[1]", ["b", "a"]), (2, 0, "p", "add", None, ["q"]), (2, 1, "q", None, "{}", ["p"]), (3, 0, None, "add", "{}", None)],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 1, "a", 'say "hi"\n'), (1, 9, "a", "later"), (1, 3, "ghost", "x"), (1, 3, None, None)], "conv_id long, turn long, call_id string, content string")
    schema = {"add": {"x": {"type": "integer", "required": True}, "y": {"type": "integer"}}}
    got = {r.call_id: r for r in tools.link_tool_calls(calls, results, schema).collect() if r.call_id}
    assert {k: r.topo_level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "p": None, "q": None, "ghost": None}
    assert got["a"].message_json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"say \\"hi\\"\\n"}'
    assert (got["a"].status, got["a"].n_results, got["b"].status, got["ghost"].status, got["c"].n_calls) == ("linked", 2, "no_result", "orphan_result", 2)
    assert got["a"].arguments_valid and got["b"].errors == "x: not integer" and got["c"].errors == "arguments: not an object"
    assert got["p"].errors == "arguments: not an object" and got["q"].errors == "unknown tool: null"
    assert tools.link_tool_calls(calls, results, schema).count() == 8
    assert tools.link_tool_calls(calls.limit(0), results.limit(0), schema).count() == 0


def test_tool_calls_of_several_conversations_and_null_identifiers(spark):
    calls = spark.createDataFrame(
        [(1, 0, "call_0", "f", "{}", None), (1, 1, "call_1", "f", "{}", ["call_0"]), (2, 0, "call_0", "f", "{}", ["call_1", "call_9"]), (3, 0, None, "f", "{}", None), (3, 0, None, "f", "{}", None), (4, 5, None, "f", "{}", ["call_0"]), (None, 7, "call_0", "f", "{}", None)],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 1, "call_0", "one"), (2, 1, "call_0", "two"), (3, 1, None, "x"), (3, 1, None, "x"), (4, 1, None, "y"), (2, 3, "call_1", "z"), (None, 8, "call_0", "n")], "conv_id long, turn long, call_id string, content string")
    got = [(r.conv_id, r.turn, r.call_id, r.status, r.topo_level, r.n_calls, r.n_results, '"result":null' in r.message_json) for r in tools.link_tool_calls(calls, results, {"f": {}}).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, 0, "call_0", "linked", 0, 1, 1, False), (1, 1, "call_1", "no_result", 1, 1, 0, True), (2, 0, "call_0", "linked", 0, 1, 1, False), (2, 3, "call_1", "orphan_result", None, 0, 1, False)]
        + [(3, 0, None, "no_result", None, 1, 0, True)] * 2
        + [(4, 5, None, "no_result", None, 1, 0, True), (None, 7, "call_0", "no_result", None, 1, 0, True)]
        + [(3, 1, None, "orphan_result", None, 0, 1, False)] * 2
        + [(4, 1, None, "orphan_result", None, 0, 1, False), (None, 8, "call_0", "orphan_result", None, 0, 1, False)],
        key=repr,
    )


def test_long_chains_take_few_rounds(spark):
    chain = [(f"n{i}", f"n{i - 1}") for i in range(1, 70)] + [("join", "n69"), ("join", "n3"), ("after", "join")]
    ids = sorted({x for e in chain for x in e})
    got = {r.call_id: r.topo_level for r in tools.levels(spark.createDataFrame([(i,) for i in ids], "call_id string"), spark.createDataFrame(chain, "child string, parent string")).collect()}
    assert got == {f"n{i}": i for i in range(70)} | {"join": 70, "after": 71}


def test_embeddings_of_any_magnitude_and_width(spark):
    rows = [(1, [1e200, 0.0, 1e199]), (2, [1e-200, 0.0, 0.0]), (3, [1.0, 0.0, 0.05]), (4, [0.0, 1.0, 0.0]), (5, [5e-324, 0.0, 0.0]), (6, [1.7e308, 1.7e308, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.01]), (9, [0.0, 3.0]), (10, [2.0]), (11, [-7.0]), (12, [9e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    links = [(i, j) for i, a in rows for j, b in rows if i < j and len(a) == len(b) and cosine(a, b) >= 0.9]
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in links) for i, _ in rows}
    assert {i: r.component_id for i, r in got.items()} == closure([i for i, _ in rows], links)
    assert len(links) == 8
