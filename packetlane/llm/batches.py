"""Helpers that the corpus operators share: Arrow batches in, numpy inside, Arrow out."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes at once; bounds a task's memory.
CHUNK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def encoded(text: str | bytes | None) -> bytes:
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def chunks(texts: list[str | None], most: int = CHUNK_BYTES):
    """(first, list of UTF-8 texts) with about `most` bytes in each; a longer text has its own."""
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        b = encoded(text)
        if held and size + len(b) > most:
            yield at, held
            at, held, size = k, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield at, held


def remainder(doc_id, divisor: int) -> int:
    """crc32 of doc_id as text, modulo divisor: the same rule as Spark's crc32(cast(doc_id as string))."""
    return zlib.crc32(str(doc_id).encode()) % divisor


def table(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches, rows: int = 512):
    """Arrow batches again, of at most `rows` rows."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, CHUNK_BYTES + 4096)
        _POWERS, _INVERSE = _powers(int(_ODD), n), _powers(pow(int(_ODD), -1, 2**64), n)
    return _POWERS, _INVERSE


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i], times the inverse base to the power i, a 64-bit hash of data[i:j]."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    h = prefix_hash(data)
    return mix64((h[ends] - h[starts]) * powers(len(data) + 1)[1][starts])


def piece_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes of pieces that follow each other, from 0 to ends[0], ends[0] to ends[1] and so on, some of them at a time."""
    out, first, at = np.empty(len(ends), dtype=np.uint64), 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, at + CHUNK_BYTES // 2, side="right")))
        e = ends[first:last] - at
        out[first:last] = span_hashes(data[at : at + e[-1]], np.concatenate(([0], e[:-1])), e)
        first, at = last, int(ends[last - 1])
    return out


def words(held: list[bytes], inside: np.ndarray, stem: int = 0) -> tuple[np.ndarray, ...]:
    """(hash of each word, with `stem` also of its first bytes, number of words in each text): words are runs of bytes marked in `inside`, lower-cased."""
    data = LOWER[np.frombuffer(b"\x20".join(held) + b"\x20", dtype=np.uint8)]
    mark = inside[data]
    edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    if len(mark) and mark[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(b) + 1 for b in held])
    each = (span_hashes(data, starts, ends), span_hashes(data, starts, np.minimum(ends, starts + stem))) if stem else (span_hashes(data, starts, ends),)
    return *each, np.diff(np.searchsorted(starts, bounds), prepend=0)
