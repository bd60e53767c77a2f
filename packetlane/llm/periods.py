"""Operator 12: periodic runs of words by online dyadic square catching.

Words are appended to `SquareCatchers`, one or many at a time. When a block of 2**k words at a multiple of 2**k is
complete, a catcher of level k waits with the block's name for the next two blocks of its size: every appended word
completes one suffix of 2**k words, and where its name equals that of a waiting block p words before, the text has period p there
(2**k <= p < 2**(k+1)). Neighbouring catches of one period merge into squares and these into runs; a run closes once
its next catcher has failed, and only then its ends, less than a block away on either side, are found word by word.
Names are 64-bit hashes made from the two halves; whatever they report is compared word by word before it counts.

A run of period p and exponent 4 holds two catching blocks in a row at least, whatever its place. Repetitions of a
multiple of a run's period lie within that run, which a lower level has closed by then, and are dropped there.
A level keeps the names of its last blocks only, so memory follows the text, and each word costs a few array steps a level.

A task takes its rows' texts one after the other through one catcher, with a word of its own after each, so no run
crosses texts. No shuffle, no state between tasks. Cases: null and empty texts, and texts of blanks, have no words and no runs
and the digests of an empty string; rows with a null id are not changed and keep their null; equal ids give equal rows each;
a text of any length is taken whole; ties of the exponent go to the smallest start, then period; other columns are ignored
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from packetlane.llm.batches import chunks, mix64, slices, table

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Words appended at once by the query.
STEP = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, dtype=np.int64)


class _Level:
    """Catchers of blocks of `size` words: names[i - base] names the `size` words from i on."""

    def __init__(self, size: int):
        self.size, self.base, self.names = size, 0, np.zeros(0, dtype=np.uint64)
        self.open = (_NONE, _NONE, _NONE)  # first block, last block and period of repetitions that may still grow

    @property
    def end(self) -> int:
        return self.base + len(self.names)

    def catch(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of new suffixes; where a waiting block's name comes again: (block, period)."""
        first, size = self.end, self.size
        self.names = np.concatenate([self.names, new])
        at = np.arange(max(first, size), self.end)
        block = (at // size - 1) * size
        hit = self.names[at - self.base] == self.names[block - self.base]
        at, block = at[hit], block[hit]
        return block, at - block

    def trim(self) -> None:
        """Blocks that still wait, and names that the next level has not used."""
        keep = max(self.base, (self.end // self.size - 1) * self.size)
        self.base, self.names = keep, self.names[keep - self.base :]

    def merge(self, block: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
        first, last, p = (np.concatenate(x) for x in zip(self.open, (block, block, period), strict=True))
        order = np.lexsort((first, p))
        first, last, p = first[order], last[order], p[order]
        if not len(p):
            return first, last, p
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (first[1:] != last[:-1] + self.size)
        starts = np.flatnonzero(new)
        return first[starts], last[np.append(starts[1:], len(p)) - 1], p[starts]


class SquareCatchers:
    """Runs of a sequence of words that comes in pieces of any length; `longest` bounds the length of a run, if known."""

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.text = np.zeros(0, dtype=np.int64)
        self.levels: list[_Level] = []
        self.found: list[tuple[int, int, int]] = []  # (start, end, period)
        self._known = (_NONE, _NONE)

    def append(self, words: np.ndarray) -> None:
        self.text = np.concatenate([self.text, words])
        n, size, k = len(self.text), 1, 0
        below = None
        while LEAST_EXPONENT * size <= (n if self.longest is None else min(n, self.longest)):
            if k == len(self.levels):
                self.levels.append(_Level(size))
            level = self.levels[k]
            if below is None:
                names = mix64(self.text[level.end :].astype(np.uint64))
            else:
                at, half = level.end - below.base, size // 2
                names = mix64(below.names[at : below.end - below.base - half] * _ODD + below.names[at + half :])
                below.trim()
            self._settle(level, *level.catch(names), done=False)
            below, size, k = level, 2 * size, k + 1
        # the last level keeps all names that a next one will want

    def _settle(self, level: _Level, block: np.ndarray, period: np.ndarray, done: bool) -> None:
        first, last, p = level.merge(block, period)
        closed = done | (last + 3 * level.size + p <= len(self.text))
        level.open = (first[~closed], last[~closed], p[~closed])
        first, last, p = first[closed], last[closed], p[closed]
        need = np.maximum(LEAST_WORDS - p, (LEAST_EXPONENT - 1) * p)  # words that equal the one p later
        live = last - first + level.size >= need - 2 * (level.size - 1)
        first, last, p, need = first[live], last[live], p[live], need[live]
        live = ~self._within(first, last + level.size + p)
        first, last, p, need = first[live], last[live], p[live], need[live]
        new = []
        for a, b, q, least in zip(first.tolist(), last.tolist(), p.tolist(), need.tolist(), strict=True):
            low, high = max(0, a - level.size), min(len(self.text) - q, b + 2 * level.size)
            off = np.flatnonzero(self.text[low:high] != self.text[low + q : high + q])
            edges = np.concatenate(([-1], off, [high - low]))
            for k in np.flatnonzero(np.diff(edges) > least):
                new.append((low + int(edges[k]) + 1, low + int(edges[k + 1]) + q, q))
        if new:
            inside = self._within(*np.array(new)[:, :2].T)  # where names were equal and words were not
            self.found = sorted({*self.found, *(r for r, x in zip(new, inside, strict=True) if not x)})
            starts, ends = np.array([r[0] for r in self.found]), np.array([r[1] for r in self.found])
            self._known = starts, np.maximum.accumulate(ends)

    def _within(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which stretches lie in a run that is known, of a lower level and so of a smaller period."""
        starts, reach = self._known
        if not len(starts):
            return np.zeros(len(first), dtype=bool)
        before = np.searchsorted(starts, first, side="right")
        return (before > 0) & (reach[before - 1] >= end)

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of all runs, by start, then period."""
        for level in self.levels:
            self._settle(level, _NONE, _NONE, done=True)
        return sorted(self.found, key=lambda r: (r[0], r[2]))


def runs_of(words: np.ndarray, step: int = STEP, longest: int | None = None) -> list[tuple[int, int, int]]:
    caught = SquareCatchers(longest)
    for at in range(0, len(words), step):
        caught.append(words[at : at + step])
    return caught.finish()


def rotated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's texts: one in ten, by the id's hash, goes round and round in a part of itself from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def _best(runs: list[tuple[int, int, int]]) -> tuple | None:
    best = None
    for start, end, q in runs:
        if best is None or (end - start) * best[2] > best[1] * q:
            best = (start, end - start, q)
    return best and (*best, 1000 * best[1] // best[2])


SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64())])
WHOLE = pa.schema([*SCHEMA, ("collapsed", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))])
DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", change=None, keep: bool = False) -> DataFrame:
    """One row for each row: its runs and what is left without their repetitions; keep: also the text that is left and the list of runs.

    change: a function of (words, id) that gives the words to look at.
    """
    schema, ddl = (WHOLE, f"{DDL}, collapsed string, runs array<struct<start long, length long, period long>>") if keep else (SCHEMA, DDL)

    def rows(ids: list, held: list[bytes]):
        parts = [t.split() for t in held]  # bytes: blanks are 0x20 and 0x09 to 0x0D
        if change is not None:
            parts = [change(w, k) for w, k in zip(parts, ids, strict=True)]
        sizes = np.array([len(w) for w in parts])
        firsts = np.concatenate(([0], np.cumsum(sizes + 1)))
        joined: list = []
        for w in parts:
            joined += w
            joined.append(None)
        codes = pd.factorize(np.array(joined, dtype=object))[0].astype(np.int64)
        codes[firsts[1:] - 1] = -1 - np.arange(len(parts))  # a word of its own after each text
        found = runs_of(codes, longest=int(sizes.max()))
        of = np.searchsorted(firsts, [r[0] for r in found], side="right") - 1
        lasts = np.searchsorted(of, np.arange(len(parts) + 1))
        for k, (doc, w) in enumerate(zip(ids, parts, strict=True)):
            own = [(s - firsts[k].item(), e - firsts[k].item(), q) for s, e, q in found[lasts[k] : lasts[k + 1]]]
            left = w
            if own:
                steps = np.zeros(len(w) + 1, dtype=np.int64)
                np.add.at(steps, [s + q for s, _, q in own], 1)
                np.add.at(steps, [e for _, e, _ in own], -1)
                left = [x for x, covered in zip(w, np.cumsum(steps[:-1]).tolist(), strict=True) if not covered]
            text_left = b" ".join(left)
            listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in own)
            row = (doc, len(own), *(_best(own) or (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text_left).hexdigest(), len(w), len(w) - len(left))
            yield (*row, text_left.decode("utf-8", "replace"), [{"start": s, "length": e - s, "period": q} for s, e, q in own]) if keep else row

    def run(batches):
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            for at, held in chunks(b.column(1).to_pylist()):
                got = list(zip(*rows(ids[at : at + len(held)], held), strict=True))
                yield table(schema, dict(zip(schema.names, map(list, got), strict=True)))

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text")).mapInArrow(run, ddl)
