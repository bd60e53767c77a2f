"""Operator 11: hard negatives by cover trees over norm-augmented candidates.

Candidates are dealt by a hash to blocks of about BLOCK rows, and each block becomes one cover tree. A further component makes all
vectors of a block equally long, so that the largest inner product with an anchor is the nearest candidate and balls bound products:
with a node's centre c, covering radius r and an anchor q, every product below the node lies within q.c - |q| r and q.c + |q| r.
A node's children are centres more than half of its level's radius apart that cover its vectors; each keeps the radius that its own
vectors need. Where half the radius covers next to nothing, as in few and far points, the node stays a leaf.

An anchor descends best first: nodes whose bounds lie outside its window of scores are skipped, the node with the
highest bound within the window opens next, leaves are verified by exact integer products, and the descent
ends when no open node can reach the last of the best so far. Anchors are packed and sent to all blocks, where they stream past
the tree; a block answers with the best few of each anchor (and window), which a ranking by anchor joins. First the nearest
of the same label are found, then, in the windows that their scores give, the others.

Equal vectors are one point of a tree with its rows by label and id; of more rows than can ever be asked for, with one vector and label,
the first by id stay. Rows go to blocks by a hash of themselves, so neither a frequent label nor a frequent vector makes a block large.

Cases: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do those so long that
scores would not fit a long (squared length of 2**62 or more); vectors are compared with those of equal width only; ties
go to the smaller id, then to the row read first; a row repeated under one id is another row; anchors without positives, and positives
without negatives in their window give no rows; an empty table gives an empty result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlane.llm.store import dropped, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Least and most hundredths of the positive's score that a negative's has.
LOWEST, HIGHEST = 50, 95
#: Rows of a block, anchors sent as one row, and points that a node keeps without children.
BLOCK, PACK, LEAF = 8192, 512, 24
#: A node gets children only if there are at most so many for each of its points.
FAN = 0.34
SLACK = 1e-9


@dataclass
class CoverTree:
    """points: distinct vectors, those below a node together; rows of point k are first_row[k] to first_row[k + 1]."""

    points: np.ndarray
    first_row: np.ndarray
    ids: np.ndarray
    uids: np.ndarray
    labels: np.ndarray
    #: By node: the point that is its centre, covering radius, first and last point, first child and number of children.
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @staticmethod
    def build(v: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, keep: int) -> CoverTree:
        """v: a row of whole numbers for each candidate; keep: rows that can be asked for of one vector and label."""
        distinct, point = np.unique(v, axis=0, return_inverse=True)
        point = point.reshape(-1)
        order = np.lexsort((uids, ids, labels, point))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (point[order][1:] != point[order][:-1]) | (labels[order][1:] != labels[order][:-1])
        starts = np.flatnonzero(new)
        order = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < keep]
        x = distinct.astype(np.float64)
        squares = np.einsum("ij,ij->i", x, x)
        perm, nodes = grown(np.hstack([x, np.sqrt(squares.max() - squares)[:, None]]))
        place = np.argsort(perm)
        order = order[np.argsort(place[point[order]], kind="stable")]
        first_row = np.searchsorted(place[point[order]], np.arange(len(perm) + 1))
        centre, radius, first, last, child, children = (np.array(c) for c in zip(*nodes, strict=True))
        return CoverTree(distinct[perm], first_row, ids[order], uids[order], labels[order], place[centre], radius, first, last, child, children)

    def __post_init__(self):
        squares = np.einsum("ij,ij->i", *[self.points.astype(np.float64)] * 2)
        self.longest = float(np.sqrt(squares.max()))
        # products of doubles are exact while no sum can pass 2**53
        self.exact = self.points.astype(np.float64 if squares.max() < 2**52 else np.int64)
        bounds = [slice(a, b) for a, b in zip(self.first_row[self.first], self.first_row[self.last], strict=True)]
        #: Least and greatest label below each node.
        self.low, self.high = (np.array([f(self.labels[b]) for b in bounds]) for f in (np.min, np.max))

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = self.points.astype(np.int16 if np.abs(self.points).max(initial=0) < 2**15 else np.int64)
        np.savez(out, points=small, **{k: getattr(self, k) for k in FIELDS[1:]})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as got:
            parts = [got[k] for k in FIELDS]
        return CoverTree(parts[0].astype(np.int64), *parts[1:])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product that anything below each node can have with each anchor."""
        q = anchors.astype(np.float64)
        length = np.linalg.norm(q, axis=1)[:, None]
        near = q @ self.points[self.centre].astype(np.float64).T
        reach = length * self.radius + SLACK * (1 + length * self.longest)
        return near - reach, near + reach

    def best(self, anchor: np.ndarray, label: int, same: bool, own: int, k: int, low: float, high: float, least: list, most: list, seen: dict) -> list[tuple[int, int, int, int]]:
        """(score, id, uid, row) of the k best rows by score, then id, with a score from low to high and the same label or another; `own` is left out.

        least, most: this anchor's bounds by node. seen: scores of leaves that were verified for this anchor before.
        """
        found: list[tuple] = []
        heap = [(-min(most[0], high), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(found) == k and -bound < found[-1][0]:
                break
            if self.children[node]:
                for c in range(self.child[node], self.child[node] + self.children[node]):
                    outside = most[c] < low or least[c] > high
                    pure = self.low[c] == self.high[c]
                    unwanted = (label < self.low[c] or label > self.high[c]) if same else pure and self.low[c] == label
                    if not outside and not unwanted and not (len(found) == k and most[c] < found[-1][0]):
                        heapq.heappush(heap, (-min(most[c], high), c))
                continue
            a, b = self.first[node], self.last[node]
            if node not in seen:
                seen[node] = np.repeat(self.exact[a:b] @ anchor.astype(self.exact.dtype), np.diff(self.first_row[a : b + 1])).astype(np.int64)
            score, at = seen[node], self.first_row[a]
            rows = slice(at, self.first_row[b])
            wanted = ((self.labels[rows] == label) == same) & (score >= low) & (score <= high) & (self.uids[rows] != own)
            if len(found) == k:
                wanted &= score >= found[-1][0]
            hits = np.flatnonzero(wanted)
            if len(hits):
                hits = hits[np.lexsort((self.uids[rows][hits], self.ids[rows][hits], -score[hits]))[:k]]
                new = zip(score[hits].tolist(), self.ids[rows][hits].tolist(), self.uids[rows][hits].tolist(), (hits + at).tolist(), strict=True)
                found = sorted([*found, *new], key=lambda f: (-f[0], f[1], f[2]))[:k]
        return found


FIELDS = ("points", "first_row", "ids", "uids", "labels", "centre", "radius", "first", "last", "child", "children")


def grown(x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(order of points, nodes as centre, radius, first, last, first child, children) of a cover tree over rows of x."""
    squares = np.einsum("ij,ij->i", x, x)

    def distances(centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, squares[centre] + squares[members] - 2 * (x[members] @ x[centre])))

    order = np.arange(len(x))
    root = distances(0, order)
    nodes, level, at = [[0, root.max(), 0, len(x), 0, 0]], [root.max()], 0
    while at < len(nodes):
        centre, radius, first, last, _, _ = nodes[at]
        scale = level[at] / 2
        at += 1
        n = last - first
        if n <= LEAF or not radius:
            continue
        while scale >= radius:  # levels at which this node would be its own only child
            scale /= 2
        members = order[first:last].copy()
        near, of, centres = distances(centre, members), np.zeros(n, dtype=np.int64), [centre]
        while (near > scale).any() and len(centres) <= FAN * n:
            centres.append(int(members[near.argmax()]))
            new = distances(centres[-1], members)
            closer = new < near
            near[closer], of[closer] = new[closer], len(centres) - 1
        if (near > scale).any():
            continue  # a leaf: half the radius covers hardly more than centres
        by = np.argsort(of, kind="stable")
        order[first:last] = members[by]
        sizes = np.bincount(of, minlength=len(centres))
        nodes[at - 1][4:] = [len(nodes), len(centres)]
        start = first
        for k, size in enumerate(sizes.tolist()):
            nodes.append([centres[k], near[of == k].max(initial=0.0), start, start + size, 0, 0])
            level.append(scale)
            start += size
    slack = SLACK * (1 + float(np.sqrt(squares.max(initial=0))))
    return order, [[c, float(r) + slack, a, b, d, e] for c, r, a, b, d, e in nodes]


def usable(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """id, label, whole components and width of the rows that take part."""
    v = F.transform(vector, lambda x: F.lit(SCALE) * x.cast("double"))
    good = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    got = rows.select(rows[key].cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    got = got.where(F.col("id").isNotNull() & F.col("label").isNotNull() & good)
    got = got.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x).cast("double"), F.lit(2.0))) < 2.0**62)
    return got.select("id", "label", F.transform("v", lambda x: F.floor(x)).alias("v"), F.size("v").alias("width"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; those without components as a zero."""
    n, column = len(column), column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, width) if width else np.zeros((n, 1), dtype=np.int64)


def streamed(trees: DataFrame, packs: DataFrame, search, ddl: str) -> DataFrame:
    """Sends every pack of anchors to every block of its width; search(tree, pack) gives columns of answers."""
    blocks = trees.select("block", "width", F.lit(0).alias("kind"), "data")
    to = packs.join(F.broadcast(trees.groupBy("width").agg(F.max("number").alias("blocks"))), "width")
    to = to.select(F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("number"), "width", F.lit(1).alias("kind"), "data")
    both = blocks.unionByName(to.select(block_of("width", "number"), "width", "kind", "data"))
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])

    def run(batches):
        tree = None
        for b in batches:
            for kind, data in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                if kind == 0:
                    tree = CoverTree.load(data.as_py())
                    continue
                with np.load(io.BytesIO(data.as_py())) as got:
                    pack = {k: got[k] for k in got.files}
                rows = search(tree, pack)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, ddl)


def block_of(width: str, number: str) -> Column:
    return F.concat_ws("-", width, number).alias("block")


def packed(anchors: DataFrame, columns: list[str]) -> DataFrame:
    """Anchors of one width, PACK at a time, as (width, data)."""

    def run(batches):
        for b in batches:
            widths = b.column(0).to_numpy()
            for width in np.unique(widths).tolist():
                some = b.filter(pa.array(widths == width))
                for at in range(0, some.num_rows, PACK):
                    part, out = some.slice(at, PACK), io.BytesIO()
                    v = matrix(part.column(1), width)
                    np.savez(out, v=v.astype(np.int16 if np.abs(v).max(initial=0) < 2**15 else np.int64), **{c: np.array(part.column(c).to_pylist(), dtype=np.int64) for c in columns})
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["width", "data"])

    return anchors.select("width", "v", *columns).mapInArrow(run, "width int, data binary")


def hard_negatives(rows: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, block: int | None = None) -> DataFrame:
    """For each anchor row and each of its nearest rows of the same label, the nearest others whose score is lowest to highest hundredths of that.

    anchor: a condition on id, label.
    """
    block = block or BLOCK
    base = written(usable(rows, key, vector, F.col("label") if label is None else label).withColumn("uid", F.monotonically_increasing_id()))
    counts = base.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    dealt = base.join(F.broadcast(counts), "width")  # one row for each width of a vector
    number = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    keep = max(positives + 1, negatives)

    def tree(t: pa.Table) -> pa.Table:
        width = t.column("width")[0].as_py()
        ids, uids, labels = (t.column(c).to_numpy() for c in ("id", "uid", "label"))
        data = CoverTree.build(matrix(t.column("v"), width), ids, uids, labels, keep).dump()
        return pa.table({"width": pa.array([width], pa.int32()), "number": pa.array([t.column("number")[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    trees = dealt.select("width", number.alias("number"), "id", "uid", "label", "v").groupBy("width", "number").applyInArrow(tree, "width int, number int, data binary")
    trees = written(trees.select("width", "number", block_of("width", "number"), "data"))

    def nearest(tree: CoverTree, pack: dict) -> list[tuple]:
        low, high = tree.bounds(pack["v"])
        out = []
        for k, (i, u, lab) in enumerate(zip(pack["id"].tolist(), pack["uid"].tolist(), pack["label"].tolist(), strict=True)):
            for score, pid, puid, _ in tree.best(pack["v"][k].astype(np.int64), lab, True, u, positives, -np.inf, np.inf, low[k].tolist(), high[k].tolist(), {}):
                out.append((u, i, score, pid, puid))
        return out

    chosen = base.where(anchor)
    near = streamed(trees, packed(chosen, ["id", "uid", "label"]), nearest, "uid long, anchor_id long, score long, pid long, puid long")
    first = Window.partitionBy("uid").orderBy(F.desc("score"), "pid", "puid")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    windows = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "pid", "score"))).alias("p"))  # `positives` rows at most
    asked = chosen.join(windows, "uid").select("width", "v", "id", "uid", "label", F.transform("p", lambda p: p["pid"]).alias("pids"), F.transform("p", lambda p: p["score"]).alias("scores"))
    asked = asked.select("*", *[F.get(c, F.lit(k)).alias(f"{c}{k}") for c in ("pids", "scores") for k in range(positives)])
    asked = written(packed(asked.na.fill(0).withColumn("n", F.size("pids")), ["id", "uid", "label", "n", *[f"{c}{k}" for c in ("pids", "scores") for k in range(positives)]]))

    def between(tree: CoverTree, pack: dict) -> list[tuple]:
        least, most = tree.bounds(pack["v"])
        out = []
        for k, (i, u, lab, n) in enumerate(zip(*(pack[c].tolist() for c in ("id", "uid", "label", "n")), strict=True)):
            v, seen, a, b = pack["v"][k].astype(np.int64), {}, least[k].tolist(), most[k].tolist()
            for j in range(n):
                score, pid = int(pack[f"scores{j}"][k]), int(pack[f"pids{j}"][k])
                low, high = -(-lowest * score // 100), highest * score // 100
                if low <= high:
                    out += [(u, i, j, pid, score, s, nid, nuid) for s, nid, nuid, _ in tree.best(v, lab, False, u, negatives, low, high, a, b, seen)]
        return out

    got = streamed(trees, asked, between, "uid long, anchor_id long, place int, positive_id long, positive_score long, negative_score long, negative_id long, nuid long")
    first = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id", "nuid")
    got = got.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    got = written(got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    dropped(base, trees, asked)
    return got


SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.place <= {POSITIVES}
        AND {LOWEST} * p.score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
