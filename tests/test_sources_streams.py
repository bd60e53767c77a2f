import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlane.functions import marks, scanner
from packetlane.sources import json_sources, ndjson, xlsx
from packetlane.streaming import packets


def test_json_documents(spark, tmp_path):
    (tmp_path / "6pre_a.json").write_text(json.dumps({"image_width": 10, "image_height": 20, "rois": [{"name": "1a", "x": 1}, {"name": " "}, {"name": "id", "x": 2.5, "y": 1, "w": 3, "h": 4}]}))
    (tmp_path / "schema_sideb.json").write_text(json.dumps({"rois": [{"name": "9"}]}))
    (tmp_path / "bad_a.json").write_text("{nothing")
    got = json_sources.region_schemas(spark, str(tmp_path)).orderBy("form_type", "pos").collect()
    assert [(r.form_type, r.side, r.name, r.x, r.h) for r in got] == [(None, "b", "9", 0.0, 0.0), ("6pre", "a", "1a", 1.0, 0.0), ("6pre", "a", "id", 2.5, 4.0)]


def test_manifest_and_mapping(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.sources.json").write_text(json.dumps({"sources": [{"source_index": 0, "page_count": 2}], "pages": [{"merged_page": 1, "source_page": 3}, {"merged_page": "x"}]}))
    assert json_sources.manifest_pages(spark, str(tmp_path / "m")).count() == 2
    assert json_sources.manifest_sources(spark, str(tmp_path / "m")).first().page_count == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.json").write_text(json.dumps({"form_type": "6pre", "sheet": "S", "start_row": 4, "mappings": [{"type": "static", "column": "A", "value": "1"}]}))
    assert json_sources.mapping_entries(spark, str(tmp_path / "p"), {"6pre": "T"}).first().sheet == "T"
    (tmp_path / "p/y.json").write_text(json.dumps({"sheet": "S"}))
    with pytest.raises(Exception, match="lacks a required key"):
        json_sources.mapping_entries(spark, str(tmp_path / "p")).collect()


def test_item_shapes(spark, tmp_path):
    for name, value in {"a": {"items": [{"id": 1}, 7, {"id": 2}]}, "b": [{"id": 3}], "c": {"id": 4}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    got = json_sources.items(spark, str(tmp_path)).select(F.try_variant_get("item", "$.id", "int").alias("i")).collect()
    assert sorted(r.i for r in got) == [1, 2, 3, 4]


def test_xlsx_round_trip(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxSource)
    df = spark.createDataFrame([("1", "a<b>&"), ("2", None), ("=1+1", " x\ty ")], "k string, v string")
    df.write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("xlsx").load(str(tmp_path / "out"))
    assert back.columns == ["k", "v"] and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_letters():
    assert [xlsx.letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and xlsx.number("AB12") == 28


def stream(spark, tmp_path, df):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, tmp_path, out, mode, name):
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(str, spark.table(name).collect()))


def until(spark, name, n, most=60):
    """Rows of a memory sink once there are n: queries with timers run empty batches for ever, so there is no end to wait for."""
    began = time.time()
    while spark.table(name).count() < n and time.time() - began < most:
        time.sleep(0.3)
    return spark.table(name).collect()


def started(out, tmp_path, name):
    return out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()


def test_windows_batch_equals_stream(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value")
    plan = lambda df: packets.windowed(df, "ts", ["event_type"], "1 day", n=F.count(F.lit(1)), total=F.round(F.sum("value"), 6))
    assert run(spark, tmp_path, plan(stream(spark, tmp_path, e)), "complete", "w") == sorted(map(str, plan(e).collect()))
    assert packets.sessions(e, "ts", ["event_type"], "1 hour").agg(F.sum("n")).first()[0] == e.count()


@pytest.fixture
def rocks(spark):
    spark.conf.set(packets.STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(packets.STORE)


def test_early_stop_state(rocks, tmp_path):
    """Every cut into chunks, in any order over batches, gives what one pass over the whole text gives."""
    r = random.Random(6)
    texts = {"a": 'x {"k": "v"} tail {"k": "w"}', "b": "not yet", "c": '{"Record ID: "8011576A"} more', "d": "one and the same words again " * 4, "e": '{"o": {"n": [1, "}"]}} {"t": "é"}!'}
    rows = []
    for k, t in texts.items():
        cuts = sorted({0, len(t), *(r.randrange(len(t)) for _ in range(5))})
        rows += [(k, n, t[x:y], n == len(cuts) - 2 and k == "b") for n, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
    r.shuffle(rows)
    schema = "request string, seq int, text string, last boolean"
    for n in range(3):
        rocks.createDataFrame([*rows[n::3], rows[0]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = started(packets.early_stop(chunks).drop("chunks"), tmp_path, "s")
    got = sorted(map(str, until(rocks, "s", 5)))
    q.stop()
    whole = rocks.createDataFrame([(k, 0, t, k == "b") for k, t in texts.items()], schema)
    assert got == sorted(map(str, packets.stopped(whole).drop("chunks").collect()))
    assert [x.split("'")[3] for x in got] == ["json_object", "end", "malformed_json_object", "repeated_tail", "malformed_json_object"]


def test_chunks_of_growing_files(rocks, tmp_path):
    rocks.dataSource.register(ndjson.NdjsonChunks)
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda **x: json.dumps(x) + "\n"
    (folder / "a.ndjson").write_text(line(request="r", response='{"k": ') + "no json\n[1]\n" + line(request="s", response="open") + '{"request": "r", "resp')
    chunks = rocks.readStream.format("ndjson_chunks").load(str(folder))
    q = started(packets.early_stop(chunks, idle_ms=6000), tmp_path, "n")
    with (folder / "a.ndjson").open("a") as f:
        f.write('onse": "\\"v\\"}"}\n')
    assert [tuple(x) for x in until(rocks, "n", 1)] == [("r", "json_object", "json_completion", '{"k": "v"}', 2)]
    (folder / "b.ndjson").write_text(line(request="t", response="x", done=True))
    got = until(rocks, "n", 3)
    q.stop()
    assert sorted(tuple(x)[:4] for x in got)[1:] == [("s", "idle", None, "open"), ("t", "end", None, "x")]


def test_scanner_against_plain_decoding():
    bits = ["{", "}", "[", "]", '"a"', '"b{"', '"\\""', '"\\u00e9"', '"\\x"', ":", ",", "1", "-0.5e3", "01", "true", "nul", "NaN", " ", "\n", "text", '"x', '{"a": 1}', '{"a":{"b":"c"}}', '{"e": ""}', "\\", "-"]
    r, decoder = random.Random(1), json.JSONDecoder()
    for _ in range(3000):
        s, want = "".join(r.choices(bits, k=r.randrange(1, 14))), []
        for start in (m.start() for m in re.finditer(r"\{", s)):
            try:
                obj, end = decoder.raw_decode(s[start:])
            except ValueError:
                continue
            if scanner.first_value(obj) is not None:
                want.append((start, start + end, obj))
        assert repr(scanner.text_blocks(s)) == repr(want)
        cut, scan, got = 0, scanner.StreamScanner(), None
        while cut < len(s) and not got:
            n = r.randrange(1, 6)
            got = scan.feed(s[cut : cut + n])
            cut, scan = cut + n, scanner.StreamScanner(json.loads(json.dumps(scan.dump())))
        assert got == scanner.StreamScanner().feed(s)


def test_blocks_as_a_table(spark):
    spark.udtf.register("json_blocks", scanner.JsonBlocks)
    df = spark.createDataFrame([(1, 'a {"x": {"y": "v"}} {"t": 5, "s": ""}'), (2, None), (3, "{")], "id int, text string")
    got = df.lateralJoin(scanner.JsonBlocks(F.col("text").outer())).select("id", "pos", "start", "end", "value", "canonical").collect()
    assert [tuple(x) for x in got] == [(1, 0, 8, 18, "v", '{"y":"v"}'), (1, 1, 20, 37, "5", '{"s":"","t":5}')]
    row = spark.createDataFrame([("x",)], "a string").select(scanner.json_from_text(F.lit('{"Record ID" "80A"}')).alias("r"), scanner.json_from_text(F.lit('{"b": 2}')).alias("o")).first()
    assert (json.loads(row.r), json.loads(row.o)) == ({"detected_text": "80A"}, {"b": 2, "detected_text": 2})


def test_marks(spark):
    dark, light = bytes([0] * 16), bytes([255] * 16)
    df = spark.createDataFrame([(dark, light, 4, 4), (light, light, 4, 4), (dark, dark, 4, 4), (None, None, 4, 4)], "c binary, t binary, w int, h int")
    got = df.select(marks.mark_score("c", "t", "w", "h").alias("s"), marks.mean_darkness("c").alias("m"), marks.radial_darkness("c", "w", "h").alias("r")).collect()
    assert [r.s for r in got] == [1.0, 0.0, 0.0, None] and [r.m for r in got] == [1.0, 0.0, 1.0, None] and 0 < got[0].r < 1
    assert marks.stretch(np.array([[10, 20]], dtype=np.uint8)).tolist() == [[0, 255]]
    assert marks.adaptive_threshold(np.array([[200] * 9] * 4 + [[0] + [200] * 8], dtype=np.uint8))[4, 0] == 0
