"""Operator 8: language identification.

A text is the average of embeddings of its hashed subwords (byte 2-, 3- and 4-grams, lower-cased ASCII);
a linear softmax on top gives the language. Embeddings and softmax are trained together by stochastic
gradient descent in numpy on at most about FIT_ROWS texts of up to FIT_TEXT bytes. A fifth of these texts is kept from training
to fit a temperature, so that scores are probabilities, and the score below which a text is rejected.

Cases: null and empty texts, and texts without a letter, are `und` with score 0; texts of any length are
taken whole; ties go to the language that sorts first; without training rows every text is `und`; an
empty table gives an empty result; columns that clash with the new names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlane.llm.batches import LOWER, chunks, slices
from packetlane.llm.sampling import about, crc_mod

FIT_ROWS = 4000
#: Longer texts (in bytes) are not fitted on, so that what the driver gathers is bounded by FIT_ROWS times this.
FIT_TEXT = 1 << 16
BITS = 16
DIM = 16
EPOCHS = 8
GRAMS = (2, 3, 4)
#: A text is rejected if its score is below what this share of the kept-back texts has, and below 0.5.
REJECT_SHARE = 0.001
UNKNOWN = "und"


def subwords(held: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets at every byte, for each size of gram, and where each text begins and ends. A text's grams reach into the gap behind it, never into the next text."""
    gap = b"\0" * 4
    data = LOWER[np.frombuffer(b"".join(b"\x20" + b + gap for b in held) + gap, dtype=np.uint8)].astype(np.uint32)
    n = len(data) - 4
    code = data[:n] | data[1 : n + 1] << 8
    out = []
    for k in GRAMS:
        if k > 2:
            code = code | data[k - 1 : n + k - 1] << np.uint32(8 * (k - 1))
        out.append(((code + np.uint32(k * 0x51ED)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    lengths = np.array([len(b) + 5 for b in held])
    starts = np.cumsum(lengths) - lengths
    return out, starts, starts + lengths - 4


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of each bucket: its embedding times the softmax's weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, held: list[bytes]) -> np.ndarray:
        grams, starts, ends = subwords(held)
        edges = np.stack([starts, ends], axis=1).ravel()
        out = np.zeros((len(held), len(self.languages)))
        for g in grams:
            for k in range(len(self.languages)):
                out[:, k] += np.add.reduceat(self.table[k][g], edges, dtype=np.float64)[::2]
        return out / (len(GRAMS) * (ends - starts))[:, None] + self.bias

    def probabilities(self, held: list[bytes]) -> np.ndarray:
        z = self.logits(held) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], kept_back: list[bool], seed: int = 8) -> Model | None:
    """Train on the texts; those kept back set the temperature and the rejection score only."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng, size = np.random.default_rng(seed), 1 << BITS
    y = np.array([languages.index(x) for x in labels])
    emb = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.3, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    bags = []
    for t in texts:
        g, _, (end,) = subwords([t.encode("utf-8", "surrogatepass")])
        idx, n = np.unique(np.concatenate([x[:end] for x in g]), return_counts=True)
        bags.append((idx, (n / n.sum()).astype(np.float32)))
    train = [i for i in range(len(texts)) if not kept_back[i]] or list(range(len(texts)))
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            idx, x = bags[i]
            h = x @ emb[idx]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            down = w @ p
            w -= 0.1 * rate * np.outer(h, p)
            bias -= 0.01 * rate * p
            emb[idx] -= rate * 5 * np.outer(np.minimum(x, 0.02), down)
    model = Model(languages, np.ascontiguousarray((emb @ w).T), bias.astype(float))
    back = [i for i in range(len(texts)) if kept_back[i]] or train
    z = np.vstack([model.logits([texts[i].encode("utf-8", "surrogatepass")]) for i in back])
    best = np.inf
    for t in np.geomspace(0.25, 10, 60):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        loss = -s[np.arange(len(back)), y[back]].mean()
        if loss < best:
            best, model.temperature = loss, float(t)
            model.reject_below = float(min(0.5, np.quantile(np.exp(s.max(axis=1)), REJECT_SHARE)))
    return model


def learn(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, held_out_mod: int = 5) -> Model | None:
    """Fit on at most about fit_rows rows with lang and a text of up to FIT_TEXT bytes whose crc32(key) mod held_out_mod is not 0."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[lang].alias("l")).where(F.col("l").isNotNull() & F.col("k").isNotNull() & (crc_mod(F.col("k"), held_out_mod) != 0))
    got = about(rows.where(F.octet_length("t") <= FIT_TEXT), "k", fit_rows).withColumn("back", crc_mod(F.concat(F.lit("back"), F.col("k")), 5) == 0)
    got = sorted(got.collect())
    return fit([r.t for r in got], [r.l for r in got], [r.back for r in got])


def identify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to every row."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    rest = [c for c in docs.columns if c not in {f.name for f in new}]
    source = docs.select(*[docs[f"`{c}`"] for c in rest])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex

        letter, m = regex.compile(r"\p{L}").search, shared.value
        for b in slices(batches):
            texts = b.column(rest.index(text)).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for first, held in chunks(texts) if m else ():
                p = m.probabilities(held)
                for k, (best, top) in enumerate(zip(p.argmax(axis=1), p.max(axis=1), strict=True), first):
                    if texts[k] and letter(texts[k]):
                        langs[k], scores[k] = m.languages[best], min(1.0, float(top))
            reject = [x == UNKNOWN or s < m.reject_below for x, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(reject, pa.bool_())], names=[*rest, *[f.name for f in new]])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *new]))
