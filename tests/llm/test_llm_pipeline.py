import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from packetlane.llm import minhash


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, str(data)))
        names.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if name == "minhash_near_dedup":
            want = {r.component_id for r in minhash.near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want
    assert names == ["language_id", "minhash_near_dedup", "suffix_dedup", "mixing", "byte_bpe"]
    assert 0 < docs.count() < 200 and docs.where("n_tokens = 0").isEmpty()


def test_null_ids_stay(spark):
    words = [f"word{i}" for i in range(60)]
    texts = {None: " ".join(words), 1: " ".join(reversed(words)), 2: " ".join(reversed(words))}
    rows = [(i, x, "en", f"s{i}", len(x)) for i, x in texts.items()] + [(None, "another text " * 9, "fr", "other", 117)]
    docs = corpus_pipeline.written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    left = [(None, "en", "sNone"), (None, "fr", "other"), (1, "en", "s1")]
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_strings):
        got = stage(spark, docs, "").select("doc_id", "lang", "source").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(left, key=repr)


def odd_documents(spark):
    """Null ids, texts, languages and sources, repeated rows, an empty text and a long one."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, long = text(60), text(60), text(30_000)
    rows = [(1, a, "en", "s1"), (2, a, None, None), (3, None, "en", "s1"), (4, "", "en", None), (None, b, "en", "s2"), (None, None, None, None), (5, long, "de", "s1"), (6, b, "fr", "s2"), (6, b, "fr", "s2"), (7, "12 34 !!", "en", "s1"), (8, text(3), "en", "s1")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_on_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = corpus_pipeline.written(odd_documents(spark))
    got = [tuple(r) for r in stage(spark, docs, "").collect()]
    ids = sorted((r[0] for r in got), key=repr)
    if name == "language_id":  # what has no letter is rejected, whatever its id
        assert {3, 4, 7}.isdisjoint(ids) and set(got) <= {tuple(r) for r in docs.collect()}
    elif name == "minhash_near_dedup":  # copies go, rows without an id or repeated under one stay
        assert ids == sorted([1, 3, 4, None, None, 5, 6, 6, 7, 8], key=repr)
    elif name == "suffix_dedup":  # a copy has nothing left and goes, as do empty texts
        assert ids == sorted([1, None, 5, 6, 6, 7, 8], key=repr)
        assert {r[2:4] for r in got if r[0] is None} == {("en", "s2")}
    elif name == "mixing":
        assert set(got) <= {tuple(r) for r in docs.collect()}
    else:
        assert len(got) == docs.count()
    empty = stage(spark, docs.limit(0), "")
    assert empty.count() == 0 and (name == "byte_bpe" or empty.columns == docs.columns)


@pytest.mark.parametrize("k", [0, 3])
def test_filtering_stages_pass_clashing_columns(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    clash = {"score": F.lit("x"), "kept": F.lit(7), "component_id": F.lit("y"), "topic": F.lit("z"), "probability": F.lit("p"), "rejected": F.lit("q")}
    docs = corpus_pipeline.written(odd_documents(spark).where("length(text) > 20").withColumns(clash))
    got = stage(spark, docs, "")
    assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
