"""Operator 6: Ogg as a media column.

`write` lays a payload out as a logical stream of Ogg pages (a header packet, then packets of samples);
`read` verifies each page's checksum, splits pages into segments by their lacing values, joins segments
to packets across pages, keeps logical streams apart by serial number, and derives timestamps from
granule positions.

Cases: a null or empty text is a payload of 64 zero bytes; texts of any length are kept whole; equal
texts give equal values; damaged pages raise ValueError in `read` and are skipped with errors="skip";
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from packetlane.llm.batches import encoded, table

MAGIC = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
#: The header packet: a name, then rate and bits for each sample.
INFO = struct.Struct("<8sIB")
RATE = 8000
SERIAL = 1
#: Bytes of samples in a packet.
PACKET = 4000
MAX_SEGMENTS = 255

_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, started at 0, by zlib's reflected CRC."""
    reflected = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def _lacing(size: int) -> list[int]:
    return [255] * (size // 255) + [size % 255]


def _page(flags: int, granule: int, serial: int, number: int, lacing: list[int], body: bytes) -> bytes:
    raw = HEAD.pack(MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + bytes(lacing) + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def paginate(packets: list[tuple[bytes, int]], serial: int = SERIAL) -> list[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); the first packet has a page of its own."""
    pages: list[bytes] = []
    lacing: list[int] = []
    body: list[bytes] = []
    granule, continued = -1, False

    def flush(last: bool, open_packet: bool):
        nonlocal lacing, body, granule, continued
        flags = (1 if continued else 0) | (2 if not pages else 0) | (4 if last else 0)
        pages.append(_page(flags, granule, serial, len(pages), lacing, b"".join(body)))
        lacing, body, granule, continued = [], [], -1, open_packet

    for k, (packet, position) in enumerate(packets):
        at = 0
        for size in _lacing(len(packet)):
            if len(lacing) == MAX_SEGMENTS:
                flush(False, at > 0)
            lacing.append(size)
            body.append(packet[at : at + size])
            at += size
        granule = position
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1, False)
    return pages


def write(payload: bytes, serial: int = SERIAL, rate: int = RATE) -> bytes:
    packets = [(INFO.pack(b"\x01samples", rate, 8), 0)]
    packets += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    return b"".join(paginate(packets, serial))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # -1: unknown, no page ended after this packet
    pages: int = 0
    ended: bool = False
    _part: bytes | None = None

    @property
    def rate(self) -> int:
        return INFO.unpack(self.packets[0])[1]

    @property
    def seconds(self) -> float:
        return max([0, *self.granules]) / self.rate

    @property
    def samples(self) -> bytes:
        return b"".join(self.packets[1:])


def read(media: bytes, errors: str = "raise") -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while (at := media.find(MAGIC, at)) >= 0:
        try:
            if len(media) < at + HEAD.size:
                raise ValueError("a page header is cut off")
            _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
            lacing = media[at + HEAD.size : at + HEAD.size + n]
            end = at + HEAD.size + n + sum(lacing)
            page = media[at:end]
            if version or len(lacing) < n or len(page) < end - at or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
                raise ValueError("a page is damaged")
            s = streams.setdefault(serial, Stream(serial))
            if number != s.pages:
                if errors == "raise":
                    raise ValueError("a page is missing")
                s._part = None
        except ValueError:
            if errors == "raise":
                raise
            at += 1
            continue
        s.pages = number + 1
        s.ended |= bool(flags & 4)
        part = s._part if flags & 1 else None
        lost = bool(flags & 1) and part is None
        body, i, done = at + HEAD.size + n, 0, 0
        pieces = [part] if part else []
        for size in lacing:
            pieces.append(media[body + i : body + i + size])
            i += size
            if size < 255:
                if not lost:
                    s.packets.append(b"".join(pieces))
                    s.granules.append(-1)
                    done += 1
                pieces, lost = [], False
        s._part = b"".join(pieces) if pieces else None
        if done:
            s.granules[-1] = granule
        at = end
    return streams


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = encoded(text)
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int64()), ("n_packets", pa.int64()), ("seconds", pa.float64())])
MEDIA = pa.schema([*SCHEMA, ("media", pa.binary())])


def media_column(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """For every row: the text's bytes stored as Ogg, read back, and what was read."""
    schema = MEDIA if keep_media else SCHEMA

    def run(batches):
        for b in batches:
            rows = {f.name: [] for f in schema}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, payload = payload_of(t)
                media = write(payload)
                s = read(media)[SERIAL]
                got = s.samples
                row = (k, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"ogg pages={s.pages} packets={len(s.packets)} seconds={s.seconds:.6f} ended={int(s.ended)}", s.pages, len(s.packets), s.seconds)
                for f, v in zip(schema, (*row, media), strict=False):
                    rows[f.name].append(v)
            yield table(schema, rows)

    kinds = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'double' if f.type == pa.float64() else 'long'}" for f in schema)
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, kinds)
