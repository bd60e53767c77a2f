"""Operator 3: a convolutional text classifier for toxicity.

A word (a run of letters) is the sum of two hashed embeddings, of the word and of its first bytes, so that
inflected forms share one; filters of widths 1, 2 and 3 slide over the words, each
filter's largest value over the text is kept, and a logistic layer gives the score. All weights are
trained in numpy on at most about FIT_ROWS labelled texts. For scoring, each filter's product with every
embedding is tabled once, so that a convolution is a sum of table rows. Thresholds are calibrated by
language: from the text's predicted language an offset on the logit puts the best cut at CUT, and a
common slope turns scores into probabilities.

Cases: null and empty texts, and texts without a word, get the score of a text of padding; texts of any
length are taken whole; equal texts get equal scores; without labelled rows, or with one class only, all
scores are the share of label 1 (0 without rows); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlane.llm import langid
from packetlane.llm.batches import chunks, encoded, slices, table, words
from packetlane.llm.sampling import about, crc_mod

FIT_ROWS = 6000
BITS = 15
#: Bytes of a word that its second embedding stands for.
STEM = 5
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 10
BATCH = 16
CUT = 0.7

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PAD = max(WIDTHS) - 1


def ids_of(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(2 x n: buckets of words and of their stems, with PAD + 1 zeros after each text; where each text begins)."""
    full, stem, n = words(held, LETTERS, STEM)
    half = 1 << BITS
    starts = np.cumsum(n + PAD + 1) - (n + PAD + 1)
    out = np.zeros((2, int((n + PAD + 1).sum()) + PAD), dtype=np.int64)
    at = np.arange(len(full)) + np.repeat(starts - (np.cumsum(n) - n), n)
    out[0, at] = (full >> np.uint64(64 - BITS)).astype(np.int64) % (half - 1) + 1
    out[1, at] = (stem >> np.uint64(64 - BITS)).astype(np.int64) % (half - 1) + 1 + half
    return out, starts


@dataclass
class Model:
    tables: list[list[np.ndarray]]  # by width and offset: buckets x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: float | None = None
    slope: float = 1.0
    offsets: np.ndarray | None = None  # of the logit, by language
    languages: langid.Model | None = None

    def pooled(self, held: list[bytes]) -> np.ndarray:
        ids, starts = ids_of(held)
        n = ids.shape[1] - PAD
        tail = (np.append(starts[1:], n)[:, None] - 1 - np.arange(PAD)).ravel()
        parts = []
        for by_offset in self.tables:
            conv = np.zeros((n, FILTERS), dtype=np.float32)
            for j, t in enumerate(by_offset):
                conv += t[ids[0, j : n + j]]
                conv += t[ids[1, j : n + j]]
            conv[tail] = 0  # these windows reach the next text; over padding alone they are 0
            parts.append(np.maximum.reduceat(conv, starts, axis=0))
        return np.maximum(0, np.hstack(parts) + self.bias)

    def raw(self, held: list[bytes]) -> np.ndarray:
        return self.pooled(held).astype(np.float64) @ self.out + self.out_bias

    def scores(self, held: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(held), self.constant)
        z = self.raw(held)
        if self.offsets is not None:
            z = z + (self.offsets[self.languages.logits(held).argmax(axis=1)] if self.languages else self.offsets[0])
        return 1 / (1 + np.exp(-np.clip(self.slope * z, -40, 40)))


def _train(held: list[bytes], y: np.ndarray, rng) -> Model:
    size, many = 2 << BITS, FILTERS * len(WIDTHS)
    emb = rng.normal(0, 0.02, (size, DIM))
    emb[[0, 1 << BITS]] = 0
    filters = [rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)) for w in WIDTHS]
    bias, out, out_bias = np.zeros(many), rng.normal(0, 0.3, many), 0.0
    sq = {"emb": np.full(size, 1e-4), "f": [np.full(f.shape, 1e-3) for f in filters], "b": np.full(many, 1e-3), "o": np.full(many, 1e-3)}
    coded = [ids_of([b])[0] for b in held]
    weight = np.where(y > 0, min(8.0, max(1.0, (len(y) - y.sum()) / max(1, y.sum()) / 2)), 1.0)
    for epoch in range(EPOCHS):
        rate = 0.08 * (1 - 0.8 * epoch / EPOCHS)
        order = rng.permutation(len(held))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            pool, where = np.empty((len(batch), many)), np.empty((len(batch), many), dtype=np.int64)
            for r, i in enumerate(batch):
                x, n = emb[coded[i][0]] + emb[coded[i][1]], coded[i].shape[1] - PAD
                for k, w in enumerate(WIDTHS):
                    conv = sum(x[j : n + j] @ filters[k][j] for j in range(w))
                    c = slice(k * FILTERS, (k + 1) * FILTERS)
                    where[r, c] = conv.argmax(axis=0)
                    pool[r, c] = conv.max(axis=0)
            act = np.maximum(0, pool + bias)
            p = 1 / (1 + np.exp(-np.clip(act @ out + out_bias, -40, 40)))
            g = (p - y[batch]) * weight[batch] / len(batch)
            down = g[:, None] * out * (act > 0)
            step_o = act.T @ g + 1e-4 * out
            for k, w in enumerate(WIDTHS):
                c = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    ids = np.stack([coded[i][:, where[r, c] + j] for r, i in enumerate(batch)], axis=1)
                    x = emb[ids].sum(axis=0)
                    d = down[:, c]
                    step = np.einsum("rfd,rf->df", x, d)
                    back = np.broadcast_to(d[:, :, None] * filters[k][j].T[None], (2, *d.shape, DIM))
                    sq["f"][k][j] += step**2
                    filters[k][j] -= rate * step / np.sqrt(sq["f"][k][j])
                    flat, back = ids.ravel(), back.reshape(-1, DIM)
                    live = (flat > 0) & (back != 0).any(axis=1)
                    flat, back = flat[live], back[live]
                    np.add.at(sq["emb"], flat, (back**2).mean(axis=1))
                    np.add.at(emb, flat, -rate * back / np.sqrt(sq["emb"][flat])[:, None])
            step_b = down.sum(axis=0)
            sq["o"] += step_o**2
            sq["b"] += step_b**2
            out -= rate * step_o / np.sqrt(sq["o"])
            bias -= rate * step_b / np.sqrt(sq["b"])
            out_bias -= rate * g.sum()
    return Model([[(emb @ f[j]).astype(np.float32) for j in range(len(f))] for f in filters], bias.astype(np.float32), out, float(out_bias))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit cut with the best F1; half-way between neighbours."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    tp, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = 2 * tp / (n + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def fit(texts: list[str], labels: list[int], kept_back: list[bool], languages: langid.Model | None = None, seed: int = 3) -> Model:
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return Model([], np.zeros(0), np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    held = [encoded(t) for t in texts]
    back = np.array(kept_back)
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back = np.zeros(len(y), dtype=bool)
    model = _train([h for h, b in zip(held, back, strict=True) if not b], y[~back], np.random.default_rng(seed))
    back = back if back.any() else ~back
    z, yb = np.concatenate([model.raw([h]) for h, b in zip(held, back, strict=True) if b]), y[back]
    common = _best_cut(z, yb)
    spoken = np.concatenate([languages.logits([h]).argmax(axis=1) for h, b in zip(held, back, strict=True) if b]) if languages else np.zeros(len(z), int)
    cuts = []
    for k in range(len(languages.languages) if languages else 1):
        own = spoken == k
        n = int(yb[own].sum())
        cuts.append((n * _best_cut(z[own], yb[own]) + 20 * common) / (n + 20) if n else common)
    spread = np.abs(z - common).mean()
    model.slope = float(4.0 / spread) if spread > 0 else 1.0
    model.offsets = np.log(CUT / (1 - CUT)) / model.slope - np.array(cuts)
    model.languages = languages
    return model


def learn(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, held_out_mod: int = 3, languages: langid.Model | None = None) -> Model:
    """Fit on at most about fit_rows labelled rows (those with texts of over langid.FIT_TEXT bytes left out) whose crc32(doc_id) mod held_out_mod is not 1."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), held_out_mod) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = about(own, "doc_id", fit_rows)
    got = docs.select("doc_id", "text").where(F.octet_length("text") <= langid.FIT_TEXT).join(chosen, "doc_id").withColumn("back", crc_mod(F.concat(F.lit("back"), F.col("doc_id")), 5) == 0)
    got = sorted(got.collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in got], [int(r.toxic > 0) for r in got], [r.back for r in got], languages)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            texts, s = b.column(1).to_pylist(), []
            for _, held in chunks(texts):
                s += m.scores(held).tolist()
            yield table(SCHEMA, {"doc_id": b.column(0), "score": s, "predicted": [int(x >= CUT) for x in s]})

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
