"""Operators on single texts: exact round trips, held-out accuracy, odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from packetlane.llm import bpe, html_text, langid, ogg, toxicity
from packetlane.llm.queries import QUERIES, tokenizer

ODD = [None, "", " ", "a", "a" * 70_000, "\x00\n\t x", "日本語 😀 ß", "The cat's 123 mats!!", "The cat's 123 mats!!"]


def odd(spark, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(data):
    return pd.read_parquet(data / "documents.parquet")


def test_bpe_is_tiktoken(spark, data, docs):
    import tiktoken

    path, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    c = bpe.codec(path, pattern)
    for t in [*docs.text, *ODD, "ab" * 3000, " " * 999 + "x", "<|endoftext|>"]:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t or "")
        assert c.decode(ids) == (t or "").encode()
    got = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, str(data)).collect()}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_odd_rows(spark):
    got = bpe.encode_decode(odd(spark, n_tokens="clash", extra=1), *tokenizer(), ids=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:3]] == [0, 0, 1] and all(r.extra == 1 and len(r.ids) == r.n_tokens for r in got)
    assert got[7].ids_sha256 == got[8].ids_sha256
    assert bpe.encode_decode(empty(spark), *tokenizer()).count() == 0


def test_bpe_long_pieces_and_memo(spark, monkeypatch):
    import tiktoken

    c = bpe.codec(*tokenizer())
    plain = tiktoken.Encoding("own", pat_str=tokenizer()[1], mergeable_ranks=c.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "MEMO", 3)
    texts = ["ab" * 20_000, "один" * 3000, "a b c d e f a b c", "=" * 5000 + "x"]
    assert [c.encode(t) for t in texts] == [plain.encode_ordinary(t) for t in texts]
    assert all(len(s.encode()) <= bpe.PIECE_BYTES for s in c.pieces) and len(c.pieces) <= 3
    got = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *tokenizer(), ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {k: plain.encode_ordinary(t) for k, t in enumerate(texts)}


def test_ogg_checksum():
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = ((c << 1) ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
        return c

    for b in (b"", b"a", b"OggS" * 99):
        assert ogg.checksum(b) == slow(b)


def test_ogg_round_trip_and_damage():
    for n in (0, 1, 254, 255, 256, 4000, 65025, 300_000):
        payload = bytes(i * 7 % 251 for i in range(n))
        s = ogg.read(ogg.write(payload))[ogg.SERIAL]
        assert s.samples == payload and s.ended and s.seconds == n / ogg.RATE
    a, b = ogg.paginate([(b"head", 0), (b"x" * 90_000, 7)], 1), ogg.paginate([(b"h", 0), (b"y" * 70_000, 9)], 2)
    mixed = [p for pair in zip(a, b, strict=False) for p in pair] + a[len(b) :] + b[len(a) :]
    got = ogg.read(b"".join(mixed))
    assert got[1].packets == [b"head", b"x" * 90_000] and got[2].packets == [b"h", b"y" * 70_000]
    bad = bytearray(ogg.write(b"z" * 9000))
    bad[-1] ^= 1
    with pytest.raises(ValueError):
        ogg.read(bytes(bad))
    assert ogg.read(bytes(bad), errors="skip")[1].packets


def test_ogg_rows(spark):
    got = ogg.media_column(odd(spark, media="clash"), keep_media=True).orderBy("doc_id").collect()
    for r, t in zip(got, ODD, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.media) == r.media_bytes
    assert ogg.media_column(empty(spark)).count() == 0


def test_language_held_out(spark):
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()
    assert got.rejected.mean() < 0.02


def test_language_odd_rows(spark):
    model = langid.fit(["der die und das ist nicht"] * 9 + ["the and of that with from"] * 9, ["de"] * 9 + ["en"] * 9, [i % 3 == 0 for i in range(18)])
    got = langid.identify(odd(spark, score="clash", lang="x"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert got[7].lang_pred == got[8].lang_pred == "en"
    assert langid.identify(empty(spark), None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd(spark), None).collect()} == {"und"}
    assert langid.learn(odd(spark, lang=None)) is None


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.1
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_learns_words_and_stems(spark):
    clean, bad = "the cat sat on a mat near the house by the river", "the cat is an awfulguy on a mat near the house"
    texts, labels = [f"{clean} {i % 5}" for i in range(60)] + [f"{bad} {i % 5}" for i in range(60)], [0] * 60 + [1] * 60
    model = toxicity.fit(texts, labels, [i % 4 == 0 for i in range(120)])
    s = model.scores([b"a mat by the river", b"what an AWFULGUY near the river", b"an awfulgirl near the river", b""])
    assert s[0] < 0.5 and s[1] >= 0.7 and s[3] < 0.7
    got = toxicity.score(odd(spark, predicted="clash"), model).orderBy("doc_id").collect()
    assert len(got) == len(ODD) and got[7].score == got[8].score
    none = toxicity.fit([], [], [])
    assert toxicity.score(empty(spark), none).count() == 0 and none.scores([b"x"])[0] == 0.0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a>Home</a></li></ul></nav><header>Top</header>
<article><h1>Head &amp; line</h1><p>First  paragraph of <b>some</b> length that goes on and on.<p>Short.<div class="comments"><p>Reader says hi</p></div>
<script>var t="</p>";</script><form>Name</form></article><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_html():
    assert html_text.extract(PAGE) == "Head & line\nFirst paragraph of some length that goes on and on.\nShort."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x</script>") == ""
    plain = "<div><a>x</a><a>y</a></div><div><a>z</a></div>" * 3 + "<div>" + "A long line of running text in no marked part. " * 5 + "</div>" + "<div><a>q</a></div>" * 3
    assert html_text.extract(plain) == ("A long line of running text in no marked part. " * 5).strip()
    assert html_text.extract("<p>unclosed <b>bold") == "unclosed bold"


@pytest.mark.parametrize("n", [3, 70, 5000])
def test_html_without_end_tags(n):
    tail = "<p>The text after it is long enough to be the article of this page.</p>"
    text = "The text after it is long enough to be the article of this page."
    for head in ("<form><select>" + "<option>x" * n + "</select></form>", "<nav><ul>" + "<li><a>x</a>" * n + "</ul></nav>", "<nav>" + "<b>x" * n + "</nav>"):
        assert html_text.extract(head + tail) == text
    items = [f"Item {i} of the article" for i in range(n)]
    for one in ("<ul><li>", "<dl><dd>", "<table><tr><td>"):
        start = one[one.rindex("<", 0, -2) if one.count("<") < 3 else one.index("<tr") :]
        page = "<article>" + one.removesuffix(start) + "".join(start + x for x in items) + f"</article>{tail}"
        assert html_text.extract(page) == "\n".join(items)
    # an item that is left out ends where the next one starts, but not where an inner list starts
    assert html_text.extract('<article><ul><li class="ad">Buy<ul><li>This</ul><li>Kept<dl><dt hidden>No<dd>Yes</dl></ul></article>') == "Kept\nYes"
    assert html_text.extract("<article><table><tr><td hidden>A<table><tr><td>B</table><td>C<tr hidden><td>D<tr><td>E</table></article>") == "C\nE"


def plain_logits(model, text):
    """Average of the rows of all grams, one at a time, plus the bias."""
    data = [b + 32 if 65 <= b <= 90 else b for b in b"\x20" + text.encode() + b"\0" * 4]
    n, total = len(data) - 4, np.zeros(len(model.languages))
    for size in langid.GRAMS:
        for at in range(n):
            code = sum(data[at + j] << (8 * j) for j in range(size))
            total += model.table[:, (((code + size * 0x51ED) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BITS)].astype(float)
    return total / (len(langid.GRAMS) * n) + model.bias


def test_language_scores_by_brute_force(docs):
    rows = [r for r in docs.itertuples() if r.lang and r.text][:60]
    model = langid.fit([r.text for r in rows], [r.lang for r in rows], [i % 5 == 0 for i in range(len(rows))])
    held = [r.text[:400] for r in rows[:12]] + ["", "A", "é"]
    for text, got in zip(held, model.probabilities([t.encode() for t in held]), strict=True):
        z = plain_logits(model, text) / model.temperature
        want = [math.exp(v - max(z)) for v in z]
        assert np.allclose(got, np.array(want) / sum(want), atol=1e-6)


def test_toxicity_scores_by_brute_force():
    """A plain forward pass: every window of every width, the largest value of each filter, one unit on top."""
    good, bad = "the sun is warm and the sea is calm today", "you are an awful stupid person go away"
    model = toxicity.fit([good + f" {i}" for i in range(20)] + [bad + f" {i}" for i in range(20)], [0] * 20 + [1] * 20, [i % 4 == 0 for i in range(40)])
    half = 1 << toxicity.BITS

    def bucket(b):
        h = int(toxicity.words([b], toxicity.LETTERS)[0][0])
        return (h >> (64 - toxicity.BITS)) % (half - 1) + 1

    for text in (good, bad, "stupid", "", "one two", bad + " " + good, "1 2 3"):
        tokens = [w for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())]
        pairs = [(bucket(w), bucket(w[: toxicity.STEM]) + half) for w in tokens]
        pooled = []
        for width, by_offset in zip(toxicity.WIDTHS, model.tables, strict=True):
            for f in range(toxicity.FILTERS):
                values = [0.0]  # the window of padding alone
                for at in range(len(pairs)):
                    inside = pairs[at : at + width]
                    values.append(sum(by_offset[j][a][f] + by_offset[j][b][f] for j, (a, b) in enumerate(inside)) + sum(2 * 0.0 for _ in range(width - len(inside))))
                pooled.append(max(values))
        z = float(np.maximum(0, np.array(pooled) + model.bias) @ model.out + model.out_bias)
        z = z + model.offsets[0]
        want = 1 / (1 + math.exp(-min(40, max(-40, model.slope * z))))
        assert abs(float(model.scores([text.encode()])[0]) - want) < 1e-4, text


def test_toxicity_repeated_rows_and_labels(spark):
    rows = [(i, ("awful stupid person " if i % 2 else "warm calm sea ") + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:10] + [(None, "x"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 72 and all(0 <= r.score <= 1 for r in got)
    assert all(len({r.score for r in got if r.doc_id == i}) == 1 for i in range(10))
    none = toxicity.learn(docs.limit(0), labels)
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_smoothing_and_threshold_by_brute_force():
    r = random.Random(4)
    for n in (1, 2, 3, 9, 40):
        x = np.array([r.random() * 10 for _ in range(n)])
        weight = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
        want = [sum(w * x[min(max(i + k, 0), n - 1)] for k, w in zip(range(-3, 4), weight, strict=True)) / sum(weight) for i in range(n)]
        assert np.allclose(html_text.smooth(x), want)
        cut = html_text.threshold(x)
        low, high = [v for v in x if v < cut], [v for v in x if v >= cut]
        assert high and (not low or abs(cut - (sum(low) / len(low) + sum(high) / len(high)) / 2) < 1e-6)


@pytest.mark.parametrize("change", [{}, {"article": "div"}, {"article": "section", ' class="ad"': ""}])
def test_html_regions_decide_without_marks(data, change, monkeypatch):
    rows = pq.read_table(f"{data}/pages.parquet", columns=["html"]).column(0).to_pylist()
    kept = wanted = found = 0
    for h in rows:
        want = html_text.extract(h)
        for a, b in change.items():
            h = h.replace(f"<{a}>", f"<{b}>").replace(f"</{a}>", f"</{b}>").replace(a, b if a.startswith(" ") else a)
        got = html_text.extract(h)
        both = sum((collections.Counter(got.split()) & collections.Counter(want.split())).values())
        kept, wanted, found = kept + len(got.split()), wanted + len(want.split()), found + both
    assert found >= 0.95 * wanted and found >= 0.95 * kept
    # the clusters decide: without a threshold nothing is told apart
    monkeypatch.setattr(html_text, "threshold", lambda x: -100.0)
    assert "Ad text" in html_text.extract(f"<body><div>Ad text</div><div><p>{'word ' * 80}<p>{'more ' * 90}</div></body>")
    monkeypatch.undo()
    assert "Ad text" not in html_text.extract(f"<body><div>Ad text</div><div><p>{'word ' * 80}<p>{'more ' * 90}</div></body>")


def test_html_names_weigh_and_do_not_rule():
    body = "<h1>Title</h1>" + "".join(f"<p>{'text ' * 60}{k}" for k in range(4))
    plain = html_text.extract(f"<div>{body}</div>")
    assert html_text.extract(f'<div class="share-page">{body}</div>') == plain != ""  # all is lowered: nothing is
    assert html_text.extract(f'<article><header>{body}</header></article>') == plain
    assert html_text.extract(f'<div>{body}</div><div class="comments"><p>{"reply " * 200}</div>') == plain
    assert html_text.extract(f'<article><div class="ad">Buy now</div>{body}<div class="promo">Offer</div><p>End</article>') == plain + "\nEnd"
    assert html_text.extract(f"<article>{body}</article><article>{body}</article>") == plain + "\n" + plain


@pytest.mark.parametrize("name", ["plain", "related-work", "share-of-market", "hidden-gems", "notice", "promo"])
def test_html_named_text_in_articles(name):
    page = lambda name: f'<article><h1>Title</h1><p>{"intro " * 30}</p><section class="{name}">' + "".join(f"<p>{'text ' * 60}{k}</p>" for k in range(20)) + f"</section><p>{'end ' * 40}</p></article>"
    want = html_text.extract(page("plain"))
    assert want.count("text") == 1200
    assert html_text.extract(page(name)) == want


@pytest.mark.parametrize("name", ["comments", "comment-list", "respond", "box comments", "site-comments section"])
def test_html_comments_in_articles(name):
    got = html_text.extract(f'<article><h1>Title</h1><p>{"intro " * 30}</p><div class="{name}">' + "".join(f"<p>{'reply ' * 60}{k}</p>" for k in range(20)) + "</div></article>")
    assert "reply" not in got and "intro" in got


@pytest.mark.parametrize("name", ["ad", "ad-box", "cookie-banner", "share links", "related", "sidebar_left", "notice"])
def test_html_small_named_parts(name):
    links = "".join(f'<p><a href="x">{"word " * 25}</a></p>' for _ in range(5))
    got = html_text.extract(f'<article><h1>Title</h1><p>{"intro " * 30}</p><div class="{name}">Buy now</div><div class="{name}">{links}</div><p>{"end " * 40}</p></article>')
    assert got == f"Title\n{'intro ' * 30}".strip() + "\n" + ("end " * 40).strip()


def test_html_dropped_within_a_line():
    assert html_text.extract("<p>Press <button>OK</button> to go on.</p>") == "Press to go on."
    assert html_text.extract("<p>One <script>x()</script>two <svg><text>no</text></svg>three<span hidden>no</span> four.</p>") == "One two three four."
    assert html_text.extract("<article><p>Text before it.<form><p>Name</form><p>Text after it.</article>") == "Text before it.\nText after it."


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", PAGE), (4, "v", "<p>" + "x" * 200_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.main_text(df).orderBy("page_id").collect()
    assert got[0].text == got[2].text and got[1].text == "" and got[3].n_chars == 200_000 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(df.limit(0)).count() == 0
