"""The n-gram model against a plain one with dictionaries, odd rows, the query."""

import glob
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetlane.llm import ngram, queries
from packetlane.llm.sampling import crc_mod


def tokens(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


class Plain:
    def __init__(self, texts, order):
        self.sums = {}
        self.order, seqs = order, [["<s>"] * (order - 1) + tokens(t) for t in texts]
        self.counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.unigrams = Counter(w for s in seqs for w in s[order - 1 :])
        self.follow = {k: defaultdict(list) for k in range(1, order + 1)}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.follow[k][g[:-1]].append(n)
        self.d = {k: ngram.discounts([sum(n == j for n in c.values()) for j in (1, 2, 3, 4)]) for k, c in self.counts.items()}

    def p(self, g):
        k = len(g)
        low = self.p(g[1:]) if k > 1 else 1 / (len(self.unigrams) + 1)
        if g[:-1] not in self.follow[k]:
            return low if k > 1 else 1.0
        d, n = (0, *self.d[k]), self.counts[k].get(g, 0)
        if (k, g[:-1]) not in self.sums:
            after = self.follow[k][g[:-1]]
            self.sums[k, g[:-1]] = sum(after), sum(d[min(x, 3)] for x in after)
        total, freed = self.sums[k, g[:-1]]
        return (n - d[min(n, 3)] + freed * low) / total

    def score(self, text):
        s = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(s[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(s)))

    def base(self, text):
        n, v = sum(self.unigrams.values()), len(self.unigrams)
        return sum(math.log10((self.unigrams[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def same(rows, got, order):
    plain = Plain([t for k, t in rows if not held(k)], order)
    want = sorted((str(k), held(k), len(tokens(t)), sum(w in plain.unigrams for w in tokens(t)), sum(plain.unigrams.values()), round(plain.base(t), 6), round(plain.score(t), 6)) for k, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    return plain


@pytest.mark.parametrize(("order", "shard_text", "hold"), [(2, 1 << 20, 3_000_000), (2, 3000, 500), (3, 3000, 700), (4, 1 << 20, 100)])
def test_same_as_plain(spark, monkeypatch, order, shard_text, hold):
    monkeypatch.setattr(ngram, "SHARD_TEXT", shard_text)
    monkeypatch.setattr(ngram, "HOLD", hold)
    monkeypatch.setattr(ngram, "SEGMENT", hold)
    r = random.Random(order)
    vocabulary = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(vocabulary[int(120 * r.random() ** 3)] for _ in range(r.choice([1, 2, 30, 90])))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "W1 w1 É é never\x1cseen"), (204, "A b"), (204, "a B"), (None, "w1 w2 w3"), (205, "w1 w2 " * 600), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"held_out": F.lit("clash"), "shard": F.lit(1), "data": F.lit(2)})
    out = crc_mod(F.col("doc_id"), 5) == 1
    model = ngram.train(df.where(~F.coalesce(out, F.lit(False))), order=order, shard_text=shard_text)
    assert (model.shards > 1) == (shard_text == 3000)
    plain = same(rows, ngram.score(df, model, F.coalesce(out, F.lit(False))).collect(), order)
    model.drop(spark)
    known = [*plain.unigrams, "unknown"]
    for context in [("w1",) * (order - 1), ("<s>",) * (order - 1), ("unknown",) * (order - 1)]:
        assert sum(plain.p((*context, w)) for w in known) == pytest.approx(1)


def test_large_counts(tmp_path):
    import numpy as np

    keys, stats = np.arange(10, dtype=np.uint64) * np.uint64(7), np.array([[1, 254, 255, 256, 2**40, 0, 3, 255, 9, 10]])
    ngram.save(f"{tmp_path}/a/0", keys, stats)
    shard = ngram.Shard(f"{tmp_path}/a/0", 1)
    hit, at = shard.find(np.array([0, 1, 14, 21, 28, 63, 99], dtype=np.uint64))
    assert hit.tolist() == [True, False, True, True, True, True, False]
    assert shard.values(0, at).tolist() == [1, 255, 256, 2**40, 10]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = ngram.score_all(df, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert ngram.score_all(df.limit(0), F.lit(True)).count() == 0


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op13_lm_score(spark, str(data)).collect()
    same(docs, got, ngram.ORDER)
    out = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in out) > 1.02 * sum(r.base_score for r in out)  # less improbable
    assert not glob.glob(spark.conf.get("spark.checkpoint.dir") + "/packetlane-ngram-*")
