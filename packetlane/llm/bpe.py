"""Operator 4: byte-level BPE encoding and decoding.

Tokens and texts are bytes mapped to Latin-1, so that one Aho-Corasick automaton over the vocabulary
finds, in one pass, the longest token that starts at each byte. The encoder walks from longest matches
and backtracks: a token may follow another only if the merges would leave the two side by side
(a memoised test on the pair), and a position that proved a dead end is not tried again. By the
uniqueness of such a chain of compatible tokens the result is the one that merging by rank gives.

Cases: null and empty texts have no ids; texts of any length are taken whole, piece by piece; equal
texts give equal ids; an empty table gives an empty result; columns that clash with the new names are
replaced, all other columns are kept.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packetlane.llm.batches import encoded

#: Pieces and pairs kept in memory by a task; beyond that the memo starts anew. Longer pieces are not kept.
MEMO, PIECE_BYTES = 400_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.ranks = read_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[str, int, bytes]] = {}  # ids as text, their number, the bytes that they decode to
        self.automaton = ahocorasick.Automaton()
        self.prefixes: dict[int, int | None] = {}
        for token, rank in self.ranks.items():
            if len(token) == 1 or self.merged(token) == [rank]:  # a token that merges never make can't be used
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """The definition: join the adjacent pair of least rank until there is none. Only for short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges leave these two tokens side by side."""
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if rank not in self.prefixes:
            b = self.bytes_of[rank]
            self.prefixes[rank] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n].decode("latin-1") in self.automaton), None)
        return self.prefixes[rank]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        longest: list[int | None] = [None] * n
        reach = [0] * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, rank
        dead = bytearray(n + 1)
        chain: list[int] = []
        at, token = 0, longest[0]
        while True:
            if token is None:  # nothing fits here: the last token was too long
                if not chain:
                    raise ValueError("the vocabulary has no token for a byte")
                dead[at] = 1
                last = chain.pop()
                at -= len(self.bytes_of[last])
                token = self.shorter(last)
                continue
            end = at + len(self.bytes_of[token])
            if dead[end] or (chain and not self.compatible(chain[-1], token)):
                token = self.shorter(token)
                continue
            chain.append(token)
            if end == n:
                return chain
            at, token = end, longest[end]

    def piece(self, s: str) -> tuple[str, int, bytes]:
        got = self.pieces.get(s)
        if got is None:
            raw = encoded(s)
            ids = self.encode_piece(raw)
            got = (",".join(map(str, ids)), len(ids), self.decode(ids))
            if len(raw) <= PIECE_BYTES:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[s] = got
        return got

    def forget(self) -> None:
        self.pieces.clear()
        self.pairs.clear()

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for s in self.find(text or "") for i in self.piece(s)[0].split(",")]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 (and with ids=True the ids) to every row of docs."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    rest = [c for c in docs.columns if c not in new]
    source = docs.select(*[docs[f"`{c}`"] for c in rest])
    schema = T.StructType([*[source.schema[c] for c in rest], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)

    def run(batches):
        c = codec(path, pattern)
        find, piece, known = c.find, c.piece, c.pieces
        for b in batches:
            counts, hashes, decoded, lists = [], [], [], []
            for t in b.column(rest.index(text)).to_pylist():
                parts = [known.get(s) or piece(s) for s in find(t or "")]
                all_ids = ",".join([p[0] for p in parts])
                counts.append(sum([p[1] for p in parts]))
                hashes.append(hashlib.sha256(all_ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                if ids:
                    lists.append([int(i) for i in all_ids.split(",") if i])
            out = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())] + [pa.array(lists, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*rest, *new])
        c.forget()  # the worker goes on to other tasks

    return source.mapInArrow(run, schema)
