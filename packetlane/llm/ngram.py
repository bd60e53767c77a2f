"""Operator 13: perplexity by an interpolated modified Kneser-Ney n-gram model.

Counting. A task turns its texts into 64-bit hashes of words, sorts its n-grams and sends each distinct one with its count, once
for every HOLD tokens, to the shard that the hash of the whole n-gram names: a frequent word or pair is one item of each task,
and no context or word has a shard to itself. A shard sums its n-grams, writes them as arrays sorted by hash,
and passes on what the level below is made of: for each distinct n-gram, one continuation of its last n-1 words and one
follower, of count 1, 2 or 3 and more, of its first n-1, summed within the shard first. So every level is the same job, down to words. The
discounts of a level come from four sums, all that reaches the driver.

Storing. A shard of a level is one file in the shared folder: sorted hashes, and small counts of one byte with the few larger
ones beside them. Its content depends on the corpus only and it is renamed into its place, so an attempt that comes again, or one that
is lost half-way, changes nothing. The folder must be a path that all workers can map (a local or mounted file system).

Scoring. Workers map the files and look up the distinct n-grams of a stretch of text in the order of their hashes, so that each
file is passed once from front to back for each stretch; pages are the operating system's, not the worker's. There is no shuffle and texts stay where they are.
Beyond what the workers' page caches hold, larger stretches (SEGMENT) make fewer passes.

With order 2 (the query's) the model takes less than twice the bytes of the compressed texts; each further order adds an array of most
of the corpus' n-grams.

Cases: null and empty texts are their end only; rows with a null id are training rows and come back; repeated rows count each time and come back each;
texts of any length are scored whole, a stretch at a time; unknown words share one further class, in the base and in the
model; without training tokens every probability is 1; columns of the input other than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlane.llm.batches import SPACE, chunks, mix64, slices, table, words
from packetlane.llm.store import dropped, renamed, shared_folder, written

ORDER = 2
#: Bytes of training text for each shard; bounds what a task that sums a shard holds.
SHARD_TEXT = 8 << 20
#: Tokens after which a task sends its n-grams on, and tokens that are looked up at once.
HOLD, SEGMENT = 2_000_000, 1_000_000
#: Files of the model that a worker has mapped at once.
OPEN = 512
#: Words that no text can hold: their hashes are constants.
START, END = np.uint64(0x53746172745F5F31), np.uint64(0x456E645F5F5F5F32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Sums kept for each k-gram: times it counts (n-gram: occurrences, else distinct words before it), its occurrences,
#: the sum of counts of what follows it, and how many followers count once, twice, more often.
STATS = ("count", "raw", "total", "once", "twice", "more")


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of words."""
    key = columns[0]
    for c in columns[1:]:
        key = mix64(key * _ODD + c)
    return key


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hashes, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def tokens(held: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of all texts with order - 1 starts before and an end after each text, place after each text's end)."""
    hashes, sizes = words(held, ~SPACE)
    ends = np.cumsum(sizes + order)
    out = np.full(int(ends[-1]), START, dtype=np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends - 1] = False
    for k in range(order - 1):
        inside[np.concatenate(([0], ends[:-1])) + k] = False
    out[inside] = hashes
    out[ends - 1] = END
    return out, ends


def summed(columns: list[np.ndarray], stats: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and the sums of their stats (one row of `stats` for each sum)."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(stats[:, order], at, axis=1) if len(at) else stats[:, :0]


def packed(columns: list[np.ndarray], stats: np.ndarray) -> bytes:
    """Rows in order as bytes: the first column by its differences, a byte plane at a time."""
    steps = np.diff(columns[0], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    raw = b"".join([np.array([len(columns[0]), len(columns), len(stats)], dtype=np.int64).tobytes(), steps.tobytes(), *(c.tobytes() for c in columns[1:]), stats.tobytes()])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, width, sums = np.frombuffer(raw, dtype=np.int64, count=3).tolist()
    first = np.cumsum(np.frombuffer(raw, dtype=np.uint8, count=8 * n, offset=24).reshape(8, n).T.copy().view(np.uint64).reshape(-1), dtype=np.uint64)
    rest = [np.frombuffer(raw, dtype=np.uint64, count=n, offset=24 + 8 * n * k) for k in range(1, width)]
    return [first, *rest], np.frombuffer(raw, dtype=np.int64, offset=24 + 8 * n * width).reshape(sums, n)


def dealt(columns: list[np.ndarray], stats: np.ndarray, shards: int):
    """(shard, rows in order as bytes) for each shard that has some."""
    to = shard_of(gram_keys(columns), shards)
    order = np.argsort(to, kind="stable")
    counts = np.bincount(to, minlength=1)
    at = 0
    for shard in np.flatnonzero(counts).tolist():
        part = order[at : at + counts[shard]]
        at += counts[shard]
        yield shard, packed([c[part] for c in columns], stats[:, part])


def save(path: str, keys: np.ndarray, stats: np.ndarray) -> None:
    """Sorted hashes and counts; counts of 255 and more stand beside the bytes, by place. The file appears whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    large = [np.flatnonzero(s >= 255) for s in stats]
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(np.array([len(keys), *map(len, large)], dtype=np.int64).tobytes())
        f.write(keys.tobytes())
        for s, at in zip(stats, large, strict=True):
            f.write(at.astype(np.int64).tobytes() + s[at].astype(np.int64).tobytes())
        for s in stats:
            f.write(np.minimum(s, 255).astype(np.uint8).tobytes())
    os.replace(draft, path)


class Shard:
    """A mapped file of `save`."""

    def __init__(self, path: str, sums: int):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        n, *large = data[: 8 * (1 + sums)].view(np.int64).tolist()
        at = 8 * (1 + sums)
        self.keys = data[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.large = []
        for k in large:
            self.large.append((data[at : at + 8 * k].view(np.int64), data[at + 8 * k : at + 16 * k].view(np.int64)))
            at += 16 * k
        self.small = [data[at + n * k : at + n * (k + 1)] for k in range(sums)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys in order -> (which are there, their places)."""
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        hit = np.zeros(len(keys), dtype=bool)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        return hit, at[hit]

    def values(self, k: int, at: np.ndarray) -> np.ndarray:
        out = self.small[k][at].astype(np.int64)
        over = np.flatnonzero(out == 255)
        if len(over):
            places, counts = self.large[k]
            out[over] = counts[np.searchsorted(places, at[over])]
        return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2, 3 and more, from how many k-grams count once, twice, three and four times; halves where these can't tell."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 < x <= k for k, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)


@dataclass
class Model:
    folder: str
    order: int
    shards: int
    #: By level, from 1: discounts.
    discount: list[tuple[float, float, float]]
    #: Of words: sum of continuation counts, number of those with count 1, 2, more; tokens and distinct words of training.
    continuations: int
    kinds: tuple[int, int, int]
    train_tokens: int
    distinct: int

    def sums(self, level: int) -> int:
        return 1 if level == self.order else len(STATS)

    def reader(self):
        """A function of (level, hashes in any order) to their stats, zeros for those the model hasn't."""
        held: dict[tuple[int, int], Shard] = {}

        def look_up(level: int, keys: np.ndarray, wanted: tuple[str, ...]) -> list[np.ndarray]:
            distinct, back = np.unique(keys, return_inverse=True)
            out = [np.zeros(len(distinct), dtype=np.int64) for _ in wanted]
            bounds = np.searchsorted(shard_of(distinct, self.shards), np.arange(self.shards + 1))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                path = f"{self.folder}/{level}/{s}"
                if (level, s) not in held:
                    if len(held) >= OPEN:
                        held.pop(next(iter(held)))
                    held[level, s] = Shard(path, self.sums(level)) if os.path.exists(path) else None
                if (shard := held[level, s]) is not None:
                    a, b = bounds[s], bounds[s + 1]
                    hit, at = shard.find(distinct[a:b])
                    for o, name in zip(out, wanted, strict=True):
                        o[a:b][hit] = shard.values(STATS.index(name), at)
            return [o[back] for o in out]

        return look_up

    def drop(self, spark: SparkSession) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def mapped_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as a path that workers can map."""
    shared = shared_folder(spark)
    path = re.sub(r"^file:(//)?(?=/)", "", shared)
    if "://" in path:
        raise ValueError(f"workers can't map files in {shared}; give a mounted path")
    return f"{os.path.abspath(path)}/packetlane-ngram-{uuid.uuid4().hex}"


def grams(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """(shard, data): the distinct n-grams of each task with their counts."""

    def run(batches):
        held, size = [], 0

        def flush():
            columns = [np.concatenate([h[k] for h in held]) for k in range(order)]
            held.clear()
            columns, stats = summed(columns, np.ones((1, len(columns[0])), dtype=np.int64))
            for shard, data in dealt(columns, stats, shards):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

        for b in slices(batches):
            for _, texts in chunks(b.column(0).to_pylist()):
                seq, ends = tokens(texts, order)
                last = np.ones(len(seq), dtype=bool)  # places where an n-gram ends
                for k in range(order - 1):
                    last[np.concatenate(([0], ends[:-1])) + k] = False
                last = np.flatnonzero(last)
                for at in range(0, len(last), HOLD):
                    part = last[at : at + HOLD]
                    held.append([seq[part - back] for back in range(order - 1, -1, -1)])
                    size += len(part)
                    if size >= HOLD:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "shard int, data binary")


def level_below(columns: list[np.ndarray], stats: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What distinct k-grams say of (k-1)-grams: one continuation of the last words, one follower of the first ones."""
    count, raw = stats[STATS.index("count")], stats[STATS.index("raw")]
    live = count > 0
    columns, count, raw = [c[live] for c in columns], count[live], raw[live]
    # summed apart, so that never more than four sums of all k-grams are held
    last, told = summed(columns[1:], np.stack([np.ones_like(count), raw]))
    first, kinds = summed(columns[:-1], np.stack([count, count == 1, count == 2, count > 2]).astype(np.int64))
    told, kinds = np.pad(told, ((0, 4), (0, 0))), np.pad(kinds, ((2, 0), (0, 0)))
    return summed([np.concatenate(c) for c in zip(last, first, strict=True)], np.concatenate([told, kinds], axis=1))


#: Of a shard: k-grams that count once, twice, three, four times, more than twice; all counts; all occurrences.
SUMS = ("n1", "n2", "n3", "n4", "many", "count", "raw")


def settling(level: int, folder: str, shards: int):
    """A function of a shard's blocks that saves them summed and gives the shard's sums and the blocks of the level below."""
    schema = pa.schema([("shard", pa.int32()), ("data", pa.binary()), *[(c, pa.int64()) for c in SUMS]])

    def settle(t: pa.Table) -> pa.Table:
        blocks = [unpacked(x.as_py()) for x in t.column("data")]
        columns, stats = [np.concatenate(c) for c in zip(*(b[0] for b in blocks), strict=True)], np.concatenate([b[1] for b in blocks], axis=1)
        del blocks
        columns, stats = summed(columns, stats)
        keys = gram_keys(columns)
        order = np.argsort(keys)
        save(f"{folder}/{level}/{t.column('shard')[0].as_py()}", keys[order], stats[:, order])
        count = stats[0]
        if len(stats) == 1:  # n-grams: what is counted are the occurrences
            stats = np.concatenate([stats, stats, np.zeros((len(STATS) - 2, stats.shape[1]), dtype=np.int64)])
        out = [(None, None, *(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count > 2).sum()), int(count.sum()), int(stats[1].sum()))]
        if level > 1:
            out += [(s, data, *[None] * len(SUMS)) for s, data in dealt(*level_below(columns, stats), shards)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return settle


def train(docs: DataFrame, *, text: str = "text", order: int = ORDER, shard_text: int = SHARD_TEXT) -> Model:
    """A model of all texts of docs."""
    spark, docs = docs.sparkSession, docs.select(docs[text].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, folder = -(-size // shard_text) or 1, mapped_folder(spark)
    parts, discount, totals = grams(docs, order, shards), [], [0] * len(SUMS)
    for level in range(order, 0, -1):
        done = written(parts.groupBy("shard").applyInArrow(settling(level, folder, shards), "shard int, data binary, n1 long, n2 long, n3 long, n4 long, many long, count long, raw long"))
        dropped(parts)
        totals = [x or 0 for x in done.agg(*[F.sum(c) for c in SUMS]).first()]
        discount.append(discounts(totals[:4]))
        parts = renamed(done, done.where("data is not null").select("shard", "data"))
    dropped(parts)
    n1, n2, _, _, more, count, raw = totals
    return Model(folder, order, shards, discount[::-1], count, (n1, n2, more), raw, n1 + n2 + more)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])


def log_probabilities(model: Model, look_up, seq: np.ndarray) -> tuple[np.ndarray, ...]:
    """(occurrences in training, log10 by the base, log10 by the model) of each place of a padded sequence but its first order - 1."""
    skip = model.order - 1
    count, raw, *context = look_up(1, seq, STATS)
    base = np.log10((raw[skip:] + 0.5) / (model.train_tokens + 0.5 * (model.distinct + 1)))

    def left(n: np.ndarray, level: int) -> np.ndarray:
        d = np.array([0.0, *model.discount[level - 1]])
        return n - d[np.minimum(n, 3)]

    if model.continuations:
        p = (left(count, 1) + sum(d * n for d, n in zip(model.discount[0], model.kinds, strict=True)) / (model.distinct + 1)) / model.continuations
    else:
        p = np.ones(len(seq))
    for level in range(2, model.order + 1):
        keys = gram_keys([seq[k : len(seq) - level + 1 + k] for k in range(level)])
        total, *kinds = (c[:-1] for c in context)  # of the words before each k-gram's last
        top = level == model.order
        count, *rest = look_up(level, keys, STATS[:1] if top else ("count", *STATS[2:]))
        context = rest
        p = p[1:]
        seen = total > 0
        freed = sum(d * n[seen] for d, n in zip(model.discount[level - 1], kinds, strict=True))
        p[seen] = (left(count[seen], level) + freed * p[seen]) / total[seen]
    return raw[skip:], base, np.log10(p)


def score(docs: DataFrame, model: Model, held: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: tokens, known tokens, log10 probability by the base and by the model, perplexity by the model."""
    skip = model.order - 1

    def run(batches):
        look_up = model.reader()
        for b in slices(batches, 4096):
            ids, out = b.column(0), b.column(1)
            for at, texts in chunks(b.column(2).to_pylist(), 6 << 20):
                seq, ends = tokens(texts, model.order)
                sums = np.zeros((3, len(texts)))
                for k in range(skip, len(seq), SEGMENT):
                    part = np.stack(log_probabilities(model, look_up, seq[k - skip : k + SEGMENT]))
                    part[0] = part[0] > 0
                    of = np.searchsorted(ends, np.arange(k, min(len(seq), k + SEGMENT)), side="right")
                    part[:, _starts(ends, k, len(part[0]), skip)] = 0  # starts are no tokens
                    for s, p in zip(sums, part, strict=True):
                        s += np.bincount(of, weights=p, minlength=len(texts))
                n = np.diff(ends, prepend=0) - skip
                yield table(SCHEMA, {"doc_id": ids.slice(at, len(texts)), "held_out": out.slice(at, len(texts)), "n_tokens": n, "n_known": sums[0].astype(np.int64), "train_tokens": np.full(len(texts), model.train_tokens), "base_score": sums[1], "score": sums[2], "perplexity": 10 ** np.minimum(300, -sums[2] / n)})

    rows = docs.select(docs[key].cast("long").alias("doc_id"), held.alias("held_out"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def _starts(ends: np.ndarray, first: int, n: int, skip: int) -> np.ndarray:
    """Places of the starts of texts among the n from `first` on, counted from there."""
    at = (np.concatenate(([0], ends[:-1]))[:, None] + np.arange(skip)).ravel() - first
    return at[(at >= 0) & (at < n)]


def score_all(docs: DataFrame, held: Column, *, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Learns from the rows that aren't held out and scores all rows; the model is deleted once the scores are written."""
    held = F.coalesce(held, F.lit(False))
    model = train(docs.where(~held), text=text, order=order)
    try:
        return written(score(docs, model, held, key=key, text=text))
    finally:
        model.drop(docs.sparkSession)
