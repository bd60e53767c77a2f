"""Operator 2: near-duplicate documents by MinHash.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; a text's set holds the 64-bit
hashes of its distinct 5-word shingles (with fewer words: of the whole sequence). Sketches have COORDINATES
bins and are filled in rounds: in each of the first rounds every element falls into a random bin and keeps
the least value there; from round COORDINATES on, each round fills one bin with the least value of all
elements. A value of an earlier round is always less, and a set is done as soon as all of its bins are full:
large sets after one or two rounds, any set after twice COORDINATES.

Equal sets are one class. Representatives whose sketches agree in one of BANDS bands of ROWS bins are
candidates, and every link is confirmed on the full sets: first each document with one of its buckets' most
connected members; then, only in buckets whose members are still in different components, all other
pairs, small buckets pair by pair, large ones as tiles in which intersections of all pairs are counted by a
product of incidence matrices. A tile sends back a spanning forest, so neither groups of copies nor buckets
of any size make quadratic output, and no candidate is dropped. Sets with a similarity of 0.75 share a band
with a probability of over 0.9999.

Cases: null and empty texts and texts without words have an empty set and link with nothing; texts of any
length are taken whole; equal texts link; rows repeated under one id are one document with several texts, each
row comes back, and links of one hold for all; a row with a null id links with nothing, has a null
component and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.llm.batches import SPACE, chunks, mix64, slices, words
from packetlane.llm.embeddings import forest
from packetlane.llm.graph import components
from packetlane.llm.store import dropped, written

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
#: Buckets up to this size are compared pair by pair.
SMALL = 32
#: Band keys that one task holds before it deals them out, and keys of one part.
HELD_KEYS, PART_KEYS = 4 << 20, 1 << 20
#: Bits of the bitmap of ids whose sets are wanted: 8 MB.
FILTER_BITS = 1 << 26
TILE = 512
#: Classes of equal sets above LARGE rows, and above this part of all rows, reach their rows by a broadcast.
HOT_CLASSES, LARGE = 10_000, 1000
#: Documents compared with one centre in one group.
FAN = 256

_SEEDS = np.random.default_rng(20170406).integers(1, 2**63, 2 * COORDINATES + WIDTH + 4, dtype=np.uint64)
_PLACE = _SEEDS[2 * COORDINATES :] | np.uint64(1)
_NONE = np.uint64(2**64 - 1)


def shingle_sets(held: list[bytes]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    w, counts = words(held, ~SPACE)
    n = len(w)
    five = np.zeros(max(0, n - WIDTH + 1), dtype=np.uint64)
    for k in range(WIDTH):
        five += w[k : k + len(five)] * _PLACE[k]
    five = mix64(five)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WIDTH:
            out.append(np.unique(five[at : at + c - WIDTH + 1]))
        elif c:
            out.append(mix64(np.sum(w[at : at + c] * _PLACE[:c], keepdims=True) + _PLACE[WIDTH : WIDTH + 1] * np.uint64(c)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES values for each set; a row of an empty set has none."""
    t = COORDINATES
    size = np.array([len(s) for s in sets])
    flat, doc = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), np.repeat(np.arange(len(sets)), size)
    out = np.full(len(sets) * t, _NONE, dtype=np.uint64)
    for r in range(2 * t):
        if not len(flat):
            break
        h = mix64(flat ^ _SEEDS[r])
        place = (h % np.uint64(t)).astype(np.int64) if r < t else r - t
        np.minimum.at(out, doc * t + place, (h >> np.uint64(10)) | np.uint64(r) << np.uint64(54))
        if r < 3 or r % 4 == 0:
            live = (out.reshape(-1, t) == _NONE).any(axis=1)[doc]
            flat, doc = flat[live], doc[live]
    return out.reshape(-1, t)


def band_keys(sk: np.ndarray) -> np.ndarray:
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(sk), axis=0)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sk.reshape(-1, BANDS, ROWS)[:, :, k])
    return key.view(np.int64)


def signatures(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a 128-bit fingerprint of the set) and bands (BANDS keys as bytes)."""

    def run(batches):
        for b in slices(batches, 2048):
            ids = b.column(0)
            for first, held in chunks(b.column(1).to_pylist()):
                sets = shingle_sets(held)
                keys = band_keys(sketches(sets))
                prints = [(int(np.sum(mix64(s ^ _PLACE[0])).view(np.int64)), int(np.sum(mix64(s ^ _PLACE[1])).view(np.int64))) if len(s) else (0, 0) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(held)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return texts.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands binary")


def bucket_members(reps: DataFrame, n_parts: int) -> DataFrame:
    """band, doc_id, n, members: the members of each bucket of two or more. reps: doc_id, n, bands.

    Keys travel as packed blocks, one for each part that a task's rows have keys of, and are matched by sorting.
    """
    modulus = np.uint64(n_parts)

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        held, rows = [], 0

        def blocks():
            ids, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            keys = np.concatenate([h[2] for h in held])
            part = (keys % modulus).astype(np.int64)
            order = np.argsort(part, kind="stable")  # by part, then in the order of documents
            at, doc = np.searchsorted(part[order], np.arange(n_parts + 1)), order // BANDS
            full = np.flatnonzero(np.diff(at))
            cut = [slice(at[p], at[p + 1]) for p in full]
            short = (keys >> np.uint64(32)).astype(np.uint32)[order]
            columns = [[short[c].tobytes() for c in cut], [pack(np.diff(ids[doc[c]], prepend=0).tobytes()) for c in cut], [pack(n[doc[c]].tobytes()) for c in cut]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["part", "keys", "ids", "sizes"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int32), np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint64)))
            rows += b.num_rows
            if rows * BANDS >= HELD_KEYS:
                yield blocks()
                held, rows = [], 0
        if rows:
            yield blocks()

    def match(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        keys = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in t.column("keys")])
        ids = np.concatenate([np.cumsum(np.frombuffer(unpack(x.as_py()), dtype=np.int64)) for x in t.column("ids")])
        n = np.concatenate([np.frombuffer(unpack(x.as_py()), dtype=np.int32) for x in t.column("sizes")])
        order = np.argsort(keys)
        start = np.flatnonzero(np.diff(keys[order], prepend=np.int64(-1)))
        members = np.diff(np.append(start, len(keys)))
        members = np.repeat(members, members)
        order, members = order[members > 1], members[members > 1]
        band = keys[order].astype(np.int64) << 32 | t.column("part")[0].as_py()
        return pa.table({"band": band, "doc_id": ids[order], "n": n[order].astype(np.int64), "members": members})

    dealt = reps.select("doc_id", "n", "bands").mapInArrow(deal, "part int, keys binary, ids binary, sizes binary")
    return dealt.groupBy("part").applyInArrow(match, "band long, doc_id long, n long, members long")


def sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and set (its hashes as bytes) of the texts named in ids, and of a few others.

    Where a bitmap of FILTER_BITS can tell the ids apart, it goes to the tasks in place of a shuffle of texts, and joins on doc_id
    drop what it lets through beside them. Beyond that, texts and ids are joined.
    """
    ids = written(ids.select("doc_id").distinct())
    n = ids.count()
    bits = 1 << max(10, (16 * n).bit_length())
    texts = texts.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    if bits > FILTER_BITS:
        wanted, shared = texts.join(ids, "doc_id", "left_semi").withColumn("place", F.lit(0)), None
    else:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        marks = ids.select(F.floor(place / 32).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit"))
        got = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 32 rows
        bitmap = np.zeros(bits // 32, dtype=np.int64)
        bitmap[got.column(0).to_numpy()] = got.column(1).to_numpy()
        wanted, shared = texts.withColumn("place", place), texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in slices(batches):
            if shared is not None:
                p = b.column(2).to_numpy()
                b = b.filter(pa.array((shared.value[p // 32] >> (p % 32) & 1).astype(bool)))
            for first, held in chunks(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), pa.array([s.tobytes() for s in shingle_sets(held)], pa.binary())], names=["doc_id", "set"])

    found = written(wanted.mapInArrow(run, "doc_id long, set binary"))
    dropped(ids)
    return found


def similar(common, a: int, b: int):
    return DENOMINATOR * common >= NUMERATOR * (a + b - common)


def may_be_similar(a: Column, b: Column) -> Column:
    """By their sizes alone."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (hub, doc_id), those with similar sets, as edges (a, b). A hub's pairs are dealt to groups of about FAN."""
    pairs = written(pairs.distinct())
    fans = pairs.groupBy("hub").agg((F.floor(F.count(F.lit(1)) / FAN) + 1).cast("int").alias("fans"))
    left = pairs.join(fans, "hub").withColumn("fan", F.pmod(F.xxhash64("doc_id"), "fans").cast("int")).select("hub", "fan", "doc_id").join(sets.hint("merge"), "doc_id")
    hub_sets = sets.select(F.col("doc_id").alias("hub_id"), F.col("set").alias("hub_set"))
    right = fans.join(hub_sets.hint("merge"), fans["hub"] == hub_sets["hub_id"]).select("hub_id", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("hub_fan"), "hub_set")

    def run(members: pa.Table, hubs: pa.Table) -> pa.Table:
        found = []
        if members.num_rows and hubs.num_rows:
            hub = hubs.column("hub_id")[0].as_py()
            of_hub = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in hubs.column("hub_set")]  # several only where rows repeat its id
            for d, s in zip(members.column("doc_id").to_pylist(), members.column("set"), strict=True):
                x = np.frombuffer(s.as_py(), dtype=np.uint64)
                for h in of_hub:
                    at = np.minimum(np.searchsorted(h, x), max(0, len(h) - 1))
                    if len(h) and similar(int((h[at] == x).sum()), len(h), len(x)):
                        found.append((hub, d))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    edges = written(left.groupBy("hub", "fan").cogroup(right.groupBy("hub_id", "hub_fan")).applyInArrow(run, "a long, b long"))
    dropped(pairs)
    return edges


def tiled(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join what the links inside each cluster join. members: cluster, doc_id, label."""
    size = members.groupBy("cluster").agg((F.floor(F.count(F.lit(1)) / TILE) + 1).cast("int").alias("tiles"))
    rows = members.join(size, "cluster").withColumn("tile", F.pmod(F.xxhash64("doc_id"), "tiles").cast("int")).join(sets.hint("merge"), "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = rows.select("cluster", "doc_id", "label", "tile", "set", other).select("cluster", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "doc_id", "label", "set")

    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        tile, ids = np.array(t.column("tile").to_pylist()), np.array(t.column("doc_id").to_pylist())
        _, label = np.unique(t.column("label").to_pylist(), return_inverse=True)
        sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in t.column("set")]
        rows_a, rows_b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        found_a, found_b = np.zeros(0, int), np.zeros(0, int)
        if len(rows_a) and len(rows_b):
            size = np.array([len(s) for s in sets])
            every, column = np.unique(np.concatenate(sets), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), size)
            shared = np.flatnonzero(np.bincount(column, minlength=len(every)) > 1)
            common = np.zeros((len(rows_a), len(rows_b)), dtype=np.float32)
            place = np.full(len(every), -1)
            place[shared] = np.arange(len(shared))
            column = place[column]
            for at in range(0, len(shared), 2048):
                inside = (column >= at) & (column < at + 2048)
                m = np.zeros((len(sets), min(2048, len(shared) - at)), dtype=np.float32)
                m[row[inside], column[inside] - at] = 1
                common += m[rows_a] @ m[rows_b].T
            link = DENOMINATOR * common >= NUMERATOR * (size[rows_a][:, None] + size[rows_b][None] - common)
            link &= label[rows_a][:, None] != label[rows_b][None]
            x, y = np.nonzero(link)
            found_a, found_b = rows_a[x], rows_b[y]
        # nodes are labels here: what is joined already needs no second edge
        at = forest(np.arange(len(ids)), label[found_a], label[found_b])
        return pa.table({"a": ids[found_a[at]].astype(np.int64), "b": ids[found_b[at]].astype(np.int64)})

    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row."""
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    signed = written(signatures(texts))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    prints = ["f1", "f2", "n_shingles"]
    total = signed.count()
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * BANDS // PART_KEYS))
    reps = full.groupBy(*prints).agg(F.min("doc_id").alias("doc_id"), F.min_by("bands", "doc_id").alias("bands")).withColumnRenamed("n_shingles", "n")
    members = written(bucket_members(reps, n_parts))
    degree = members.groupBy("doc_id").agg(F.sum("members").alias("degree"))
    centre = members.join(degree, "doc_id").groupBy("band").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"))).alias("c")).select("band", "c.hub", "c.hub_n")
    placed = written(members.join(centre, "band"))
    # each document first meets the centre that it shares most buckets with
    star = placed.where((F.col("hub") != F.col("doc_id")) & may_be_similar(F.col("n"), F.col("hub_n"))).groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("shared"))
    star = star.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("hub")).alias("hub"))).alias("c")).select((-F.col("c.hub")).alias("hub"), "doc_id")
    sets = sets_of(texts, members)
    dropped(members)
    edges = confirmed(star, sets)
    label = components(edges)
    named = placed.join(label.select(F.col("id").alias("doc_id"), F.col("component_id").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    named = written(named)
    dropped(placed)
    apart = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    split = written(named.join(apart, "band", "left_semi"))
    dropped(named)
    few = split.where(F.col("members") <= SMALL).select("band", "doc_id", "n", "label")
    other = few.select("band", F.col("doc_id").alias("hub"), F.col("n").alias("m"), F.col("label").alias("hub_label"))
    pairs = few.join(other, "band").where((F.col("hub") < F.col("doc_id")) & (F.col("label") != F.col("hub_label")) & may_be_similar(F.col("n"), F.col("m"))).select("hub", "doc_id")
    more = [confirmed(pairs, sets)]
    many = written(split.where(F.col("members") > SMALL))
    if not many.isEmpty():
        cluster = components(many.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))
        crowd = written(many.select("doc_id", "label").distinct().join(cluster.select(F.col("id").alias("doc_id"), F.col("component_id").alias("cluster")), "doc_id"))
        more.append(written(tiled(crowd, sets)))
    dropped(split, many, sets)
    classes = full.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    repeated = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    more.append(full.join(repeated, "doc_id", "left_semi").join(classes, prints).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = written(reduce(DataFrame.unionByName, more))
    label = written(label if found.isEmpty() else components(edges.unionByName(found)))
    dropped(edges, found, *more)
    found = F.coalesce("component_id", "rep").alias("component_id")
    joined = written(classes.join(label.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select(*prints, found, "copies"))
    # classes with more than a share of all rows: there can't be more than HOT_CLASSES of them, so their rows need no shuffle
    hot = F.broadcast(joined.where(F.col("copies") > max(LARGE, total // HOT_CLASSES)).select(*prints, "component_id"))
    rows = signed.select("doc_id", *prints)
    counted = rows.where("n_shingles > 0 and doc_id is not null")
    alone = rows.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    others = counted.join(hot, prints, "left_anti").join(joined.select(*prints, "component_id"), prints)
    out = reduce(DataFrame.unionByName, [alone, counted.join(hot, prints), others])
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
