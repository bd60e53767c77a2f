"""Marks on pages against plain loops over pixels; headers against unicodedata; kept results; sinks that change as a whole."""

import json
import math
import unicodedata
from random import Random

import numpy as np
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from packetlane.functions import header as H
from packetlane.functions import imaging
from packetlane.functions import marks as M
from packetlane.operators import marks, reuse
from packetlane.plans import catalog, scans  # noqa: F401 - scans adds its queries to the catalogue
from packetlane.sources import versions

PAGE = "id int, form_type string, side string, pixels binary, width int, height int"
REGION = "form_type string, side string, name string, question string, letter string, x double, y double, w double, h double, image_width int, image_height int"


def region(name, x, y, w, h, size=(40, 30)):
    return ("7", "a", name, name[:-1], name[-1], float(x), float(y), float(w), float(h), *size)


def test_blur_against_loops():
    rng = np.random.default_rng(1)
    f, sigma = rng.random((9, 12)), 1.0
    r = 3
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]

    def mirrored(i, n):
        return -i if i < 0 else 2 * (n - 1) - i if i >= n else i

    want = [[sum(k[a] * k[b] * f[mirrored(y + a - r, 9), mirrored(x + b - r, 12)] for a in range(7) for b in range(7)) / sum(k) ** 2 for x in range(12)] for y in range(9)]
    assert np.allclose(M.blurred(f, sigma), want)
    assert np.array_equal(M.blurred(f, 0), f)
    assert np.allclose(M.blurred(np.ones((1, 3)), 5.0), 1)


def test_resize():
    c = np.array([[0, 100], [200, 40]], dtype=np.uint8)
    assert M.resized(c, 4, 4).tolist()[0] == [0, 25, 75, 100]
    assert np.array_equal(M.resized(c, 2, 2), c)
    assert (M.resized(np.full((5, 7), 9, np.uint8), 13, 3) == 9).all()
    assert M.resized(np.array([[5]], np.uint8), 2, 3).tolist() == [[5] * 3] * 2


def test_edge_weights():
    w = M.edge_weights(5, 5)
    assert w[2, 2] == 0 and w[0, 0] == 1 and w[2, 3] == pytest.approx((1 / math.hypot(2, 2) / 0.3) ** 2 if 1 / math.hypot(2, 2) < 0.3 else 1)
    assert M.edge_weights(1, 1).tolist() == [[0]]


@pytest.mark.parametrize("limit", [marks.BROADCAST_BYTES, -1])
def test_answers(spark, limit):
    """A marked choice wins over printed ink; ties go by alphabet; odd pages answer nothing; both ways to join agree."""
    template = np.full((30, 40), 255, np.uint8)
    template[:, 10:20] = 0  # printed ink below choice b
    drawn, tied = template.copy(), template.copy()
    drawn[2:8, 22:28] = 0
    tied[2:8, 2:8], tied[2:8, 22:28] = 60, 60
    large = np.kron(drawn, np.ones((2, 2), np.uint8))
    rows = [(1, "7", "a", drawn.tobytes(), 40, 30), (2, "7", "a", tied.tobytes(), 40, 30), (3, "7", "a", None, 40, 30), (4, "7", "a", b"short", 40, 30), (5, "7", "b", drawn.tobytes(), 40, 30), (6, "7", "a", template.tobytes(), 40, 30), (7, None, "a", drawn.tobytes(), 40, 30), (8, "7", "a", large.tobytes(), 80, 60)]
    pages = spark.createDataFrame(rows, PAGE)
    regions = spark.createDataFrame([region("1a", 0, 0, 10, 10), region("1b", 10, 0, 10, 10), region("1c", 20, 0, 10, 10), region("2a", 90, 90, 5, 5)], REGION)
    templates = spark.createDataFrame([("7", "a", template.tobytes(), 40, 30)], "form_type string, side string, pixels binary, width int, height int")
    got = {(r["id"], r["question"]): r for r in marks.mark_answers(pages, regions, templates, pad=0, sigma=0.0, limit=limit).collect()}
    assert {k: r["answer"] for k, r in got.items()} == {(1, "1"): "c", (1, "2"): "", (2, "1"): "a", (2, "2"): "", (3, "1"): "", (3, "2"): "", (4, "1"): "", (4, "2"): "", (6, "1"): "", (6, "2"): "", (8, "1"): "c", (8, "2"): ""}
    assert got[1, "1"]["scores"]["c"] == pytest.approx(36 * 0.95**3) and got[1, "1"]["scores"]["b"] == 0
    assert got[3, "1"]["scores"] is None
    wide = {(r["id"], r["question"]): r["answer"] for r in marks.mark_answers(pages, regions, templates, limit=limit).collect()}
    assert wide[1, "1"] == "c" and wide[6, "1"] == ""


@pytest.mark.parametrize("graduated", [False, True])
def test_filled(spark, graduated):
    rng = np.random.default_rng(2)
    page = rng.integers(0, 256, (30, 40)).astype(np.uint8)
    page[0:6, 0:6] = 255
    regions = spark.createDataFrame([region("1a", 0, 0, 6, 6), region("1b", 7.9, 3, 9, 5), region("1c", 35, 28, 20, 20), region("1d", 100, 100, 5, 5)], REGION)
    asked = spark.createDataFrame([("7", "a", n) for n in ("1a", "1b", "1c", "1d", "9z", None)], "form_type string, side string, name string")
    pages = spark.createDataFrame([(1, "7", "a", page.tobytes(), 40, 30), (2, "7", "a", None, None, None)], PAGE)
    got = {(r["id"], r["name"]): r for r in marks.filled_marks(pages, regions, asked, graduated=graduated).collect()}
    assert len(got) == 10 and not any(got[2, n]["filled"] for n in ("1a", "1b", "1c", "1d", "9z"))
    assert not got[1, "1a"]["filled"] and got[1, "1a"]["flat"] == 0 and not got[1, "9z"]["filled"]
    for name, (x, y, w, h) in {"1b": (7, 3, 9, 5), "1c": (35, 28, 5, 2), "1d": (39, 29, 1, 1)}.items():
        crop = page[y : y + h, x : x + w]
        assert got[1, name]["flat"] == pytest.approx(float(np.mean((255 - crop.astype(float)) / 255)))
        assert got[1, name]["filled"] == (got[1, name]["graduated" if graduated else "flat"] >= 0.15)


def test_compatibility_forms(spark):
    """All single code points that this Python knows, and runs of letters and marks that compose."""
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    rng = Random(1)
    pool = known[0x41:0x5B] + [chr(c) for c in [*range(0x300, 0x345), *range(0x1100, 0x1113), *range(0x1161, 0x1176), 0xFB01, 0x2168, 0x1D57, 0x1E9B]]
    texts = [*known, *["".join(rng.choices(pool, k=6)) for _ in range(5000)], "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").repartition(8).select("k", "x", H.nfkc(F.col("x")).alias("n")).collect()
    assert [r["x"] for r in rows if r["n"] != (None if r["x"] is None else unicodedata.normalize("NFKC", r["x"]))] == []


def test_second_run_computes_nothing(spark, tmp_path):
    seen = []

    def make(new):
        seen.append(sorted(bytes(r["c"]) for r in new.collect()))
        return new.select(reuse.KEY, F.length("c").alias("n"))

    rows = spark.createDataFrame([(1, b"aa"), (2, b"b"), (3, b"aa"), (4, None), (5, b"")], "id int, c binary")
    run = lambda df, **p: {r["id"]: (r["n"], r["reused"]) for r in reuse.reused(df, "c", p, make, f"{tmp_path}/kept").collect()}
    assert run(rows, size=1, mode="x") == {1: (2, False), 2: (1, False), 3: (2, False), 4: (None, False), 5: (0, False)}
    assert run(rows, mode="x", size=1) == {1: (2, True), 2: (1, True), 3: (2, True), 4: (None, False), 5: (0, True)}
    assert run(rows.where("id = 2"), mode="y", size=1) == {2: (1, False)}
    more = rows.union(spark.createDataFrame([(6, b"new")], rows.schema))
    assert run(more, size=1, mode="x")[6] == (3, False)
    assert run(rows.limit(0), size=3) == {}
    assert seen == [[b"", b"aa", b"b"], [], [b"b"], [b"new"], []]


def test_sets_change_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "sink")
    one, two = spark.range(3).selectExpr("id", "id % 2 AS g"), spark.range(10, 12).selectExpr("id", "id % 2 AS g")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    first = versions.commit(one, path, "20260101", partition_by=("g",))

    @F.udf("long")
    def breaks(x):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        versions.commit(two.withColumn("id", breaks("id")), path, "20260102")
    assert sorted(r["id"] for r in versions.read(spark, path).collect()) == [0, 1, 2]
    second = versions.commit(two, path, "20260103")
    assert sorted(r["id"] for r in versions.read(spark, path).collect()) == [10, 11]
    assert sorted(r["id"] for r in versions.read(spark, path, first).collect()) == [0, 1, 2]
    assert versions.sets(spark, path) == [first, second]
    third = versions.commit(one.limit(0), path, "20260104")
    assert versions.vacuum(spark, path, keep=1) == [first] and versions.sets(spark, path) == [second, third]
    assert versions.read(spark, path).count() == 0


def test_documents(spark):
    runs = spark.createDataFrame([("r", "p.pdf", '{"n":1}', None), ("e", None, None, "[2]")], "pdf_stem string, pdf_path string, post_normalize string, human_review string")
    items = spark.createDataFrame([("r", k, f"n{k}", None if k == 2 else 'a"b', 1) for k in (3, 1, 2)], "pdf_stem string, k int, name string, text string, _pass int")
    got = {(r["pdf_stem"], r["part"]): json.loads(r["document"]) for r in versions.recognition_documents(runs, items, "pdf_stem", "k", ("post_normalize", "human_review"), part_items=2).collect()}
    assert got == {
        ("r", 0): {"pdf_stem": "r", "pdf_path": "p.pdf", "item_count": 3, "items": [{"name": "n1", "text": 'a"b'}, {"name": "n2", "text": None}], "post_normalize": {"n": 1}},
        ("r", 1): {"pdf_stem": "r", "part": 1, "items": [{"name": "n3", "text": 'a"b'}]},
        ("e", 0): {"pdf_stem": "e", "item_count": 0, "items": [], "human_review": [2]},
    }


def lines(h=300, w=400):
    """A page with broken lines of dark bars."""
    rng = np.random.default_rng(5)
    page = np.full((h, w), 240, np.uint8)
    for y in range(40, h - 40, 16):
        for x in range(60, w - 60, 20):
            page[y : y + 6, x : x + int(rng.integers(6, 17))] = 30
    return page


@pytest.mark.parametrize("degrees", [-7.3, -2.15, 0.0, 0.4, 1.0, 5.6])
def test_skew(degrees):
    turned = imaging.turned(lines(), degrees)
    found = imaging.skew(turned)
    assert abs(found - degrees) <= 0.2
    assert abs(imaging.skew(imaging.turned(turned, -found))) <= 0.2


def test_skew_of_plain_pages():
    assert imaging.skew(np.full((50, 50), 255, np.uint8)) == 0 and imaging.skew(np.zeros((20, 20), np.uint8)) == 0
    assert np.array_equal(imaging.turned(lines(), 0), lines())


@pytest.mark.parametrize(("h", "w", "clip", "tiles"), [(32, 40, 2.0, 4), (33, 41, 2.0, 4), (64, 64, 40.0, 2), (24, 24, 0, 2)])
def test_equalized_against_loops(h, w, clip, tiles):
    page = np.random.default_rng(3).normal(120, 30, (h, w)).clip(0, 255).astype(np.uint8)
    th, tw = math.ceil(h / tiles), math.ceil(w / tiles)

    def at(y, x):
        return int(page[y if y < h else 2 * (h - 1) - y, x if x < w else 2 * (w - 1) - x])

    tables = {}
    for a in range(tiles):
        for b in range(tiles):
            n = [0] * 256
            for y in range(a * th, (a + 1) * th):
                for x in range(b * tw, (b + 1) * tw):
                    n[at(y, x)] += 1
            if clip:
                limit = max(int(clip * th * tw / 256), 1)
                over = sum(max(c - limit, 0) for c in n)
                n = [min(c, limit) + over // 256 for c in n]
                left, k = over % 256, 0
                step = max(256 // left, 1) if left else 1
                while left and k < 256:
                    n[k] += 1
                    left, k = left - 1, k + step
            tables[a, b] = [min(255, round(sum(n[: k + 1]) * (255 / (th * tw)))) for k in range(256)]
    for y in range(0, h, 3):
        for x in range(0, w, 3):
            fy, fx = y / th - 0.5, x / tw - 0.5
            a, b = math.floor(fy), math.floor(fx)
            inside = lambda k: min(max(k, 0), tiles - 1)
            want = sum((fy - a if i else 1 - fy + a) * (fx - b if j else 1 - fx + b) * tables[inside(a + i), inside(b + j)][int(page[y, x])] for i in (0, 1) for j in (0, 1))
            assert abs(int(imaging.equalized(page, clip, tiles)[y, x]) - want) <= 0.5 + 1e-9


def test_binarized_and_contrast():
    page = np.full((40, 40), 200, np.uint8)
    page[10:14, 10:14] = 20
    out = imaging.binarized(page, block=10)
    assert (out[10:14, 10:14] == 0).all() and out[30, 30] == 255 and set(np.unique(out)) == {0, 255}
    assert imaging.contrast(np.full((3, 3), 7, np.uint8)).tolist() == [[7] * 3] * 3
    ramp = np.arange(256, dtype=np.uint8).reshape(16, 16)
    assert np.array_equal(imaging.contrast(ramp, 0, 100), ramp) and imaging.contrast(ramp, 0, 100, 2.0)[8, 0] == int((128 / 255) ** 2 * 255)


def test_clean_pages(spark):
    page = imaging.turned(lines(), 2.0)
    rows = [(1, page.tobytes(), 400, 300), (2, None, 1, 1), (3, b"x", 5, 5), (4, lines().tobytes(), 400, 300)]
    got = {r["id"]: r for r in marks.clean_pages(spark.createDataFrame(rows, "id int, pixels binary, width int, height int"), deskew=True).collect()}
    assert abs(got[1]["skew"] - 2) <= 0.2 and got[4]["skew"] == 0 and (got[2]["skew"], got[2]["pixels"]) == (None, None) and bytes(got[3]["pixels"]) == b"x"
    upright = np.frombuffer(got[1]["pixels"], np.uint8).reshape(300, 400)
    assert set(np.unique(upright)) == {0, 255} and abs(imaging.skew(upright)) <= 0.2


def test_contrast_as_its_sql(spark, tmp_path):
    """Pages with pixels whose stretched level is a whole number, which the last bit of a percentile decides."""
    keys = (18372, 18976, 19813, 40431, 41197, 170466, 175076, 348989, 353261, 367167, 501679, 510206)
    spark.createDataFrame([(k, k % 25) for k in keys], "c_custkey long, c_nationkey int").coalesce(1).toPandas().to_parquet(tmp_path / "customer.parquet")
    same_rows(catalog.QUERIES["page_contrast"](spark, str(tmp_path)), catalog.SQL["page_contrast"], tmp_path)


def test_percentile():
    page = np.array([[9, 3], [7, 3]], np.uint8)
    assert [imaging.percentile(page, p) for p in (0, 20, 50, 75, 100)] == [3, 3, 5, 7.5, 9]
    assert imaging.percentile(np.array([[4]], np.uint8), 99) == 4
    many = np.random.default_rng(4).integers(0, 256, (31, 17)).astype(np.uint8)
    assert all(imaging.percentile(many, p) == pytest.approx(np.percentile(many, p), abs=1e-12) for p in (0, 1, 2.5, 50, 99, 100))
