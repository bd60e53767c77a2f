"""Operator 7: near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned into the axes of their principal components, largest variance
first; sums for the axes are gathered as one matrix of the width of a vector. Equal vectors are one node with a number of
copies. Nodes are dealt by a hash to tiles of about TILE_BYTES, in the precision of the input. Each pair of tiles is one unit of work: products of the leading
axes are accumulated step by step, the rest is bounded by the product of the suffix norms, and pairs that
cannot reach the threshold any more are dropped; what survives is computed in full in double precision on
the original components.

A pair of tiles is compared ROWS rows at a time and checked PAIRS pairs at a time, so a tile of near-equal vectors
takes no more memory than any other; it sends back counts and a spanning forest of its links, never its list of pairs. Vectors of each width are
compared among themselves, one width after the other. A vector is divided by its largest component first, so its length neither
overflows nor vanishes. Cases: vectors that are null, zero, or that hold null or
non-finite components link with nothing and keep themselves, as do rows with a null id; equal vectors are linked; rows
repeated under one id are vectors of their own, each comes back and counts as a link of others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlane.llm.graph import components
from packetlane.llm.store import dropped, written

THRESHOLD = 0.9
#: Bytes of a tile in double precision: two of them, twice over, are what a task holds.
TILE_BYTES = 4 << 20
#: Rows of a tile compared at once, and pairs computed in full at once.
ROWS, PAIRS = 256, 1 << 16
#: Leading axes added at each step.
STEPS = (16, 16, 32)
SLACK = 1e-5


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that join what all of them join. label: of each node, a root with label[root] = root; brought up to date."""
    live, kept = np.arange(len(a)), []
    while True:
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, high, low = live[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        if not len(live):
            return np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *kept]))
        # each root above another one is hung below one of these: no circle can arise
        up, first = np.unique(high, return_index=True)
        kept.append(live[first])
        to = np.arange(len(label))
        to[up] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of rows of unit length and PCA order with cosine of at least the threshold, by early stopping."""
    at = sum(STEPS[:1])
    tail_x, tail_y = np.linalg.norm(x[:, at:], axis=1), np.linalg.norm(y[:, at:], axis=1)
    reach = x[:, :at] @ y[:, :at].T
    # threshold - reach <= tail_x * tail_y, one row of the tile at a time to stay in cache
    i, j = np.nonzero(reach + tail_x[:, None] * tail_y[None, :] >= threshold - SLACK)
    dots = reach[i, j].astype(np.float64)
    for width in STEPS[1:]:
        if at >= x.shape[1] or not len(i):
            break
        end = min(x.shape[1], at + width)
        dots = dots + np.einsum("ij,ij->i", x[i, at:end], y[j, at:end])
        at = end
        rest = np.linalg.norm(x[:, at:], axis=1)[i] * np.linalg.norm(y[:, at:], axis=1)[j]
        live = dots + rest >= threshold - SLACK
        i, j, dots = i[live], j[live], dots[live]
    return i, j


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows in double precision with a largest component of 1 or -1: the same directions, at any magnitude."""
    v = v.astype(np.float64)
    # by a power of two first, which loses nothing and keeps the inverse of the smallest numbers finite
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0.0))[1])
    return v / np.abs(v).max(axis=1, keepdims=True, initial=0.0)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row."""
    single = dict(vectors.dtypes)[vector] == "array<float>"  # then nothing is lost by keeping four bytes
    every = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<float>" if single else "array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    every = written(every.select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), F.when(good, F.col("v")).alias("v")))
    usable = every.where("v is not null")
    widths = [r["w"] for r in usable.select(F.size("v").alias("w")).distinct().orderBy("w").toLocalIterator()]  # a few kinds of vectors
    if not widths:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = [linked(usable.where(F.size("v") == w), w, single, threshold, tile) for w in widths]
    whole = F.col("v").isNotNull()
    out = every.select("vec_id", "h1", "h2", whole.alias("whole")).join(reduce(DataFrame.unionByName, known), ["h1", "h2"], "left")
    component = F.coalesce(F.when(F.col("whole"), F.col("smallest")), "vec_id")
    return out.select("vec_id", F.coalesce(F.when(F.col("whole"), F.col("n")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def linked(usable: DataFrame, width: int, single: bool, threshold: float, tile: int | None) -> DataFrame:
    """h1, h2, n (links of each row) and smallest (least id of its component) of each distinct vector of one width."""
    # equal vectors are one node
    nodes = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    axes = usable.sparkSession.sparkContext.broadcast(principal_axes(usable, width))
    kind = np.dtype(np.float32 if single else np.float64)
    n_tiles = -(-nodes.count() // (tile or max(256, TILE_BYTES // (8 * width))))

    def pack(batches):
        """Rows of a partition as a few blocks for each tile: nodes, copies and vectors as bytes."""
        held: dict[int, list] = {}
        for b in batches:
            t, ids, copies = (b.column(k).to_numpy() for k in (3, 0, 1))
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
            for k in np.unique(t):
                held.setdefault(int(k), []).append((ids[t == k], copies[t == k], v[t == k]))
        for k, parts in held.items():
            columns = [np.concatenate(c).tobytes() for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]], names=["tile", "ids", "copies", "v"])

    tiles = nodes.select("node", "copies", "v", F.pmod(F.xxhash64("node"), F.lit(n_tiles)).cast("int").alias("tile")).repartition(n_tiles, "tile").mapInArrow(pack, "tile int, ids binary, copies binary, v binary")
    tiles = written(tiles)
    # each tile meets itself and those up to half-way round the circle of tiles
    half = n_tiles // 2
    once = ~((F.col("s") == half) & (F.col("a") >= half)) if n_tiles % 2 == 0 else F.lit(True)
    steps = F.explode(F.sequence(F.lit(0), F.lit(half))).alias("s")
    block = ["ids", "copies", "v"]
    firsts = tiles.select(F.col("tile").alias("a"), steps, *block).where(once).select("a", F.pmod(F.col("a") + F.col("s"), F.lit(n_tiles)).alias("b"), F.lit(0).alias("side"), *block)
    seconds = tiles.select(F.col("tile").alias("b"), steps, *block).withColumn("a", F.pmod(F.col("b") - F.col("s"), F.lit(n_tiles))).where(once).select("a", "b", F.lit(1).alias("side"), *block)
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        side = np.array(t.column("side").to_pylist())

        def load(which):
            rows = t.filter(pa.array(side == which))
            read = lambda name, k: np.concatenate([np.zeros(0, dtype=k), *(np.frombuffer(x.as_py(), dtype=k) for x in rows.column(name))])
            return read("ids", np.int64), read("copies", np.int64), scaled(read("v", kind).reshape(-1, width))

        (ia, ma, va), (ib, mb, vb) = load(0), load(1)
        same = t.column("a")[0].as_py() == t.column("b")[0].as_py()
        na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
        xa, xb = (((v / n[:, None]) @ axes.value).astype(np.float32) for v, n in ((va, na), (vb, nb)))
        count_a, count_b = np.zeros(len(ia), dtype=np.int64), np.zeros(len(ib), dtype=np.int64)
        shift = 0 if same else len(ia)
        label, left, right = np.arange(shift + len(ib)), [], []
        for at in range(0, len(ia), ROWS):
            i, j = close_pairs(xa[at : at + ROWS], xb, threshold)
            i += at
            if same:
                i, j = i[i < j], j[i < j]
            sure = np.zeros(len(i), dtype=bool)
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                sure[k : k + PAIRS] = np.einsum("ij,ij->i", va[p], vb[q]) / (na[p] * nb[q]) >= threshold
            i, j = i[sure], j[sure]
            count_a += np.bincount(i, weights=mb[j], minlength=len(ia)).astype(np.int64)
            count_b += np.bincount(j, weights=ma[i], minlength=len(ib)).astype(np.int64)
            new = forest(label, i, j + shift)
            left.append(ia[i[new]])
            right.append(ib[j[new]])
        hit_a, hit_b, edges = np.flatnonzero(count_a), np.flatnonzero(count_b), np.concatenate(left)
        node = np.concatenate([ia[hit_a], ib[hit_b], edges])
        n = np.concatenate([count_a[hit_a], count_b[hit_b], np.zeros(len(edges), dtype=np.int64)])
        other = pa.concat_arrays([pa.nulls(len(hit_a) + len(hit_b), pa.int64()), pa.array(np.concatenate(right))])
        return pa.Table.from_arrays([pa.array(node), pa.array(n), other], schema=schema)

    found = written(firsts.unionByName(seconds).groupBy("a", "b").applyInArrow(compare, "node long, n long, other long"))
    dropped(tiles)
    links = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    reach = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = written(nodes.select("h1", "h2", "node", "least", "copies").join(links, "node", "left").join(reach.withColumnRenamed("id", "node"), "node", "left").withColumn("component_id", F.coalesce("component_id", "node")))
    least = known.groupBy("component_id").agg(F.min("least").alias("smallest"))
    out = written(known.join(least, "component_id").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "smallest"))
    dropped(nodes, found, known)
    return out


def principal_axes(usable: DataFrame, width: int) -> np.ndarray:
    """Columns: eigenvectors of the mean outer product of the unit vectors, largest eigenvalue first."""

    def sums(batches):
        total = np.zeros((width, width))
        for b in batches:
            v = _vectors(b.column(0), width)
            v = v / np.linalg.norm(v, axis=1)[:, None]
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["r", "s"])

    parts = usable.select("v").mapInArrow(sums, "r int, s array<double>")
    rows = parts.groupBy("r").agg(*[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(width)]).collect()
    m = np.zeros((width, width))
    for r in rows:
        m[r["r"]] = r[1:]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
