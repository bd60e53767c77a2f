"""Operator 5: removal of byte strings that an earlier document has, by suffix-array intervals.

Every string of LENGTH bytes has an anchor: the least hash of the GRAM-byte grams inside it. Equal strings
have equal anchors at equal offsets, so only strings whose anchor stands in two documents can matter:

1. anchors of all texts are dealt by hash to parts (as packed blocks, with a fingerprint of the text); in each part
   equal texts count as one, with its smallest doc_id, and anchors stay that two different texts share;
2. texts that a smaller doc_id has too go whole;
3. the pieces of text around shared anchors are dealt by the same hash; in each part, equal pieces collapse
   to one with its smallest doc_id, and the distinct pieces of anchors that have several go through a
   Burrows-Wheeler transform, whose intervals of common prefixes, expanded breadth-first up to LENGTH, are
   the classes of equal strings;
4. a string is removed where its class has a smaller doc_id; runs are merged by document.

A task that deals pieces settles equal ones among its own rows: only the smallest doc_id's goes on. An anchor in
over HOT texts would still load one task: its pieces are cut into single strings, dealt by their own hash and a salt
of the task; equal strings are settled in these groups, and what is left of them is joined by a second deal without
salt. No string of any text is left out.

Cases: null and empty texts have 0 bytes and keep nothing; texts shorter than LENGTH lose nothing; equal texts
lose all but the smallest doc_id's; rows repeated under one id don't remove each other, and places found in one
count in the others; rows with a null id keep all of their text and remove nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlane.llm.batches import chunks, encoded, mix64, piece_hashes, powers, prefix_hash, slices, span_hashes
from packetlane.llm.bwt import equal_classes
from packetlane.llm.store import dropped, written

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
HOT = 2000
#: Groups that the strings of hot anchors are dealt to before equal ones meet.
SALTS = 16
#: Bytes of text for one part; its anchors and shared pieces fit in a task's memory several times over.
PART_BYTES = 4 << 20
#: Bytes of text whose anchors are computed at once.
CHUNK = 1 << 20
#: Distinct pieces of this many bytes are transformed at once.
BLOCK = 1 << 20


def anchors(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, anchor, text, start, length) of runs of strings with one anchor. start: in data, of the first string."""
    size = np.array([len(b) for b in held])
    data = np.frombuffer(b"".join(held) + bytes(LENGTH + 16), dtype=np.uint8)
    h = prefix_hash(data)
    g = mix64((h[GRAM:] - h[:-GRAM]) * powers(len(data) + 1)[1][: len(h) - GRAM])
    m, width = g, 1
    while width * 2 <= WINDOW:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (WINDOW - width)], m[WINDOW - width :])
    begin = np.cumsum(size) - size
    count = np.maximum(0, size - LENGTH + 1)
    text = np.repeat(np.arange(len(held)), count)
    place = np.arange(len(text)) + np.repeat(begin - (np.cumsum(count) - count), count)
    m = m[place]
    cut = np.ones(len(m), dtype=bool)
    cut[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, len(m)))
    # one gram at two places can go on for longer than one anchor's strings
    if len(length) and length.max() > WINDOW:
        parts = -(-length // WINDOW)
        first = np.repeat(first, parts) + WINDOW * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.diff(np.append(first, len(m)))
    return data, m[first], text[first], place[first], length


def _blocks(parts: np.ndarray, n_parts: int, columns: list[np.ndarray]):
    """(part, slice of each column) after dealing rows to parts."""
    order = np.argsort(parts, kind="stable")
    bounds = np.searchsorted(parts[order], np.arange(n_parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]], [c[bounds[p] : bounds[p + 1]] for c in columns]


def _read(t: pa.Table, name: str, kind, unpack=bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *(np.frombuffer(unpack(x.as_py()), dtype=kind) for x in t.column(name))])


def _unpacker():
    d = zstandard.ZstdDecompressor()
    return lambda x: d.decompress(x) if x is not None else b""


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, h1 (a hash of the text), the text as compressed bytes, for shuffles, and any other columns as they are."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    more = "".join(f", `{c}` {dict(rows.dtypes)[c]}" for c in rest)

    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, 2048):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else c.compress(encoded(t)) for t in b.column(2).to_pylist()], pa.binary()), *b.columns[3:]], names=["doc_id", "h1", "text", *rest])

    return rows.select("doc_id", F.xxhash64("text").alias("h1"), "text", *rest).mapInArrow(run, "doc_id long, h1 long, text binary" + more)


def _short(a: np.ndarray, n_parts: int) -> np.ndarray:
    """32 bits of an anchor above its part in the lowest 24."""
    return (a >> np.uint64(32) << np.uint64(24)) | (a % np.uint64(n_parts))


def _record(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def shared_anchors(texts: DataFrame, n_parts: int) -> DataFrame:
    """doc_id, anchor, hot: anchors that stand in two different texts or more, for the smallest doc_id of each text."""
    names = ["part", "anchors", "index", "ids", "prints"]

    def deal(batches):
        for b in slices(batches, 4096):
            all_ids = b.column(0).to_numpy()
            for first, held in chunks(b.column(1).to_pylist(), CHUNK):
                _, a, text, _, _ = anchors(held)
                ids = all_ids[first : first + len(held)].astype(np.int64)
                whole = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in held], dtype=np.uint64)
                rows = []
                for p, _, (v, t) in _blocks((a % np.uint64(n_parts)).astype(np.int64), n_parts, [(a >> np.uint64(32)).astype(np.uint32), text]):
                    here, index = np.unique(t, return_inverse=True)
                    rows.append((p, v.tobytes(), index.astype(np.int32).tobytes(), ids[here].tobytes(), whole[here].tobytes()))
                if rows:
                    yield _record(rows, names)

    def join(t: pa.Table) -> pa.Table:
        part = np.uint64(t.column("part")[0].as_py())
        d, w = [], []
        for index, ids, prints in zip(t.column("index"), t.column("ids"), t.column("prints"), strict=True):
            i = np.frombuffer(index.as_py(), dtype=np.int32)
            d.append(np.frombuffer(ids.as_py(), dtype=np.int64)[i])
            w.append(np.frombuffer(prints.as_py(), dtype=np.uint64)[i])
        a, d, w = _read(t, "anchors", np.uint32), np.concatenate(d), np.concatenate(w)
        order = np.lexsort((d, w, a))
        a, d, w = a[order], d[order], w[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        a, d = a[new], d[new]
        cut = np.ones(len(a), dtype=bool)
        cut[1:] = a[1:] != a[:-1]
        n = np.diff(np.append(np.flatnonzero(cut), len(a)))
        n = np.repeat(n, n)
        keep = n > 1
        key = (a[keep].astype(np.uint64) << np.uint64(24)) | part
        return pa.table({"doc_id": d[keep], "anchor": key.view(np.int64), "hot": n[keep] > HOT})

    dealt = texts.mapInArrow(deal, "part int, anchors binary, index binary, ids binary, prints binary")
    return dealt.groupBy("part").applyInArrow(join, "doc_id long, anchor long, hot boolean")


BLOCKS = "part int, salt int, ids binary, anchors binary, starts binary, lengths binary, bytes binary"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _block(part: int, salt: int, columns: tuple) -> tuple:
    pack = zstandard.ZstdCompressor(level=1).compress
    return (part, salt, *(None if c is None else pack(c.tobytes()) for c in columns))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=_NAMES)


def _settled(ids: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether an equal piece with a smaller doc_id stands among these. same: hashes of pieces."""
    order = np.lexsort((ids, same))
    new = np.ones(len(order), dtype=bool)
    new[1:] = same[order][1:] != same[order][:-1]
    least = ids[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    out = np.empty(len(order), dtype=bool)
    out[order] = ids[order] > least
    return out


def pieces(listed: DataFrame, n_parts: int) -> DataFrame:
    """Blocks of the pieces around shared anchors; those without bytes are settled: all of their strings go. listed: doc_id, text, found (array of anchor, hot)."""

    def run(batches):
        unpack = _unpacker()
        turn = 0
        for b in slices(batches, 512):
            all_ids = b.column(0).to_numpy()
            lists = b.column(2)
            for first, held in chunks([unpack(x) for x in b.column(1).to_pylist()], CHUNK):
                data, a, text, place, length = anchors(held)
                begin = np.cumsum([0, *map(len, held)])
                found = lists.slice(first, len(held))
                owner = np.repeat(np.arange(len(held)), np.asarray(found.value_lengths()))
                flat = found.flatten()
                known = flat.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
                heat = np.asarray(flat.field("hot").to_numpy(zero_copy_only=False), dtype=bool)
                # (text, anchor) as one number: anchors are hashes already
                tag = lambda t, x: mix64(x + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                k = tag(owner, known)
                o = np.argsort(k)
                k, heat = k[o], heat[o]
                if not len(k):
                    continue
                mine = tag(text, _short(a, n_parts))
                at = np.minimum(np.searchsorted(k, mine), len(k) - 1)
                hit = np.flatnonzero(k[at] == mine)
                hot = heat[at[hit]]
                a, text, place, length = a[hit], text[hit], place[hit], length[hit]
                if hot.any():  # single strings, dealt by their own hash
                    n = length[hot]
                    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    alone = np.repeat(place[hot], n) + j
                    own = span_hashes(data, alone, alone + LENGTH)
                    a, text = np.concatenate([a[~hot], own]), np.concatenate([text[~hot], np.repeat(text[hot], n)])
                    place, length = np.concatenate([place[~hot], alone]), np.concatenate([length[~hot], np.ones(len(alone), dtype=length.dtype)])
                    hot = np.arange(len(a)) >= len(a) - len(alone)
                size = length + LENGTH - 1
                ids = all_ids[first + text].astype(np.int64)
                starts, short = (place - begin[text]).astype(np.int64), length.astype(np.uint8)
                gone = _settled(ids, span_hashes(data, place, place + size) ^ mix64(a))
                rows = []
                if gone.any():
                    rows.append(_block(int(ids[gone][0]) % n_parts, 0, (ids[gone], None, starts[gone], short[gone], None)))
                turn += 1
                salt = 1 + int(mix64(a[:1] + np.uint64(turn))[0] % np.uint64(SALTS)) if len(a) else 1
                for heated in (False, True):
                    left = np.flatnonzero(~gone & (hot == heated))
                    for p, index, (aa, pp) in _blocks((a[left] % np.uint64(n_parts)).astype(np.int64), n_parts, [a[left], place[left]]):
                        index = left[index]
                        ss = size[index]
                        cells = np.repeat(pp - (np.cumsum(ss) - ss), ss) + np.arange(int(ss.sum()))
                        rows.append(_block(p, salt * heated, (ids[index], aa, starts[index], short[index], data[cells])))
                if rows:
                    yield _table(rows)

    return listed.mapInArrow(run, BLOCKS)


def _loaded(t: pa.Table, settled: bool) -> tuple[np.ndarray, ...]:
    """ids, anchors, starts, lengths and bytes of the blocks."""
    t = t.filter(pa.compute.is_null(t.column("bytes")) if settled else pa.compute.is_valid(t.column("bytes")))
    unpack = _unpacker()
    kinds = (np.int64, np.uint64, np.int64, np.uint8, np.uint8)
    return tuple(_read(t, n, k, unpack) for n, k in zip(_NAMES[2:], kinds, strict=True))


def _marks(part: int, ids, starts, masks) -> pa.RecordBatch:
    """A block of places to be removed: the masks stand where other blocks have their bytes, and there are no anchors."""
    keep = masks != 0
    return _table([_block(part, -1, (ids[keep].astype(np.int64), None, starts[keep].astype(np.int64), None, masks[keep].astype(np.int64)))] if keep.any() else [])


def _full(lengths: np.ndarray) -> np.ndarray:
    return (np.int64(1) << lengths.astype(np.int64)) - 1


def covered(blocks: DataFrame) -> DataFrame:
    """Blocks again: with salt -1 places to be removed, and with salt 0 what is left of salted blocks."""

    def run(t: pa.Table) -> pa.Table:
        part, salt = t.column("part")[0].as_py(), t.column("salt")[0].as_py()
        ids, _, starts, length, _ = _loaded(t, True)
        out = [_marks(part, ids, starts, _full(length))]
        ids, a, starts, length, data = _loaded(t, False)
        if salt and len(ids):
            end = np.cumsum(length.astype(np.int64) + LENGTH - 1)
            begin = end - (length.astype(np.int64) + LENGTH - 1)
            gone = _settled(ids, piece_hashes(data, end) ^ mix64(a))
            out.append(_marks(part, ids[gone], starts[gone], _full(length[gone])))
            cells = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(x, y) for x, y in zip(begin[~gone].tolist(), end[~gone].tolist(), strict=True))])
            out.append(_table([_block(part, 0, (ids[~gone], a[~gone], starts[~gone], length[~gone], data[cells]))]))
        elif len(ids):
            out.append(_marks(part, ids, starts, removable(ids, a, length.astype(np.int64), data)))
        return pa.Table.from_batches(out)

    return blocks.groupBy("part", "salt").applyInArrow(run, BLOCKS)


def removable(ids: np.ndarray, a: np.ndarray, length: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each piece, the mask of its strings that a piece with a smaller doc_id has too."""
    size = length + LENGTH - 1
    end = np.cumsum(size)
    same = piece_hashes(data, end) ^ mix64(a)
    order = np.lexsort((ids, same, a))
    cut = np.ones(len(order), dtype=bool)
    cut[1:] = same[order][1:] != same[order][:-1]
    first = order[cut]  # of equal pieces, the row with the smallest doc_id
    piece = np.empty(len(order), dtype=np.int64)
    piece[order] = np.cumsum(cut) - 1
    by = a[first]
    edge = np.ones(len(first), dtype=bool)
    edge[1:] = by[1:] != by[:-1]
    start_of = np.flatnonzero(edge)
    n = np.diff(np.append(start_of, len(first)))
    # smallest doc_id of each string of each distinct piece; a piece alone under its anchor has its own
    width = int(length.max()) if len(length) else 1
    low = np.repeat(ids[first][:, None], width, axis=1)
    several = np.flatnonzero(n > 1)
    bytes_of = np.add.reduceat(size[first] + 1, start_of) if len(first) else np.zeros(0, dtype=int)
    batch = np.cumsum(bytes_of[several]) // BLOCK
    for k in np.unique(batch):
        groups = several[batch == k]
        rows = np.repeat(start_of[groups] - (np.cumsum(n[groups]) - n[groups]), n[groups]) + np.arange(int(n[groups].sum()))
        own = first[rows]
        total = size[own] + 1
        put = np.cumsum(total) - total
        text = np.full(int(total.sum()), 256, dtype=np.uint16)
        cell = np.arange(int(size[own].sum())) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        text[np.repeat(put, size[own]) + cell] = data[np.repeat(end[own] - size[own], size[own]) + cell]
        classes = equal_classes(text, LENGTH)
        j = np.arange(int(length[own].sum())) - np.repeat(np.cumsum(length[own]) - length[own], length[own])
        row = np.repeat(rows, length[own])
        c = classes[np.repeat(put, length[own]) + j]
        least = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, c, low[row, j])
        low[row, j] = least[c]
    bits = np.zeros(len(ids), dtype=np.int64)
    for j in range(width):
        bits |= ((low[piece, j] < ids) & (j < length)).astype(np.int64) << j
    return bits


def places(blocks: DataFrame) -> DataFrame:
    """doc_id, start, mask of blocks of places: bit k of the mask marks the string at start + k for removal."""

    def run(batches):
        unpack = _unpacker()
        for b in slices(batches, 64):
            columns = [_read(b, name, np.int64, unpack) for name in ("ids", "starts", "bytes")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "mask"])

    return blocks.mapInArrow(run, "doc_id long, start long, mask long")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(texts: DataFrame, keep_text: bool = False, characters: bool = False) -> DataFrame:
    """texts: doc_id, text (packed), whole (all removed), found (array of start, mask) and any other columns, which stay. characters: no character goes in part."""
    rest = [c for c in texts.columns if c not in ("text", "whole", "found")]
    source = texts.select(*rest, "text", "whole", "found")
    schema = ", ".join(f"`{c}` {dict(texts.dtypes)[c]}" for c in rest) + ", " + RESULT + ", kept binary" * keep_text

    def run(batches):
        unpack = _unpacker()
        for b in slices(batches, 1024):
            n = b.num_columns
            out = []
            for text, whole, found in zip(b.column(n - 3), b.column(n - 2).to_pylist(), b.column(n - 1), strict=True):
                raw = unpack(text.as_py())
                if whole:
                    out.append((len(raw), len(raw), 1, b""))
                    continue
                if not found.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                start, mask = (found.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "mask"))
                edge = np.zeros(len(raw) + LENGTH + 64, dtype=np.int32)
                for k in range(int(mask.max()).bit_length()):
                    at = start[(mask >> k) & 1 == 1] + k
                    at = at[at < len(raw)]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + LENGTH, -1)
                gone = np.cumsum(edge)[: len(raw)] > 0
                if characters:
                    lead = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
                    gone = np.logical_and.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()))
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)] + [pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())] + [pa.array([x[3] for x in out], pa.binary())] * keep_text
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 3], *columns], names=[*rest, *[f.split()[0] for f in RESULT.split(", ")], *["kept"] * keep_text])

    return source.mapInArrow(run, schema)


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep_text: bool = False, characters: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes kept, and the row's own columns that are carried along) of every row.

    characters: a character at a border stays whole, so that what is kept is text again.
    """
    more = [F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(carry)]).alias("more")] if carry else []
    every = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), *more)
    rows = every.where("doc_id is not null").select("doc_id", "text")
    prints = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.reverse(F.md5(F.col("text").cast("binary")))).alias("h2"), F.octet_length("text").alias("size")]
    digest = written(rows.where(F.octet_length("text") >= LENGTH).select("doc_id", *prints))
    total = digest.agg(F.sum("size")).first()[0] or 0
    n_parts = min(1 << 24, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES)))
    lists = written(shared_anchors(rows, n_parts).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot")).alias("found")))
    listed = packed(rows).select("doc_id", "text").join(lists.hint("merge"), "doc_id")
    first = written(covered(pieces(listed, n_parts)))
    dropped(lists)
    marks = [places(first.where("salt < 0"))]
    left = first.where("salt >= 0")
    if not left.isEmpty():
        marks.append(places(covered(left)))
    # a text that a smaller doc_id has too: its hash in place of a mask, at start -1
    copies = digest.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    whole = digest.join(copies.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id > rep").select("doc_id", F.lit(-1).cast("long").alias("start"), F.col("h1").alias("mask")).distinct()
    found = reduce(DataFrame.unionByName, [*marks, whole]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "mask")).alias("all"))
    out = packed(every).join(found.hint("merge"), "doc_id", "left")
    gone = F.coalesce(F.exists("all", lambda m: (m["start"] < 0) & (m["mask"] == F.col("h1"))), F.lit(False))
    spots = F.filter("all", lambda m: m["start"] >= 0)
    done = cut(out.select("doc_id", "text", *["more"] * bool(carry), gone.alias("whole"), F.when(F.size(spots) > 0, spots).alias("found")), keep_text, characters)
    if not carry:
        return done
    return done.select(*[c for c in done.columns if c != "more"], *[F.col(f"more.c{k}").alias(c) for k, c in enumerate(carry)])
