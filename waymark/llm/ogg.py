"""Media columns: an Ogg reader and writer, and the DataFrame operators over them.

The container is the public one of RFC 3533. A file here multiplexes two logical streams: 8-bit unsigned PCM in the OggPCM
mapping, and a check stream with the CRC-32 of every audio packet. Reading verifies each page's checksum, reassembles packets
from lacing values (also over pages), separates the streams by serial number and derives times from granule positions.

Edge cases: a null payload is written as an empty one; an empty payload is a file with headers and an empty last page; bytes
that are no Ogg give no streams; a page with a wrong checksum is skipped and counted, and packets it held part of are dropped
and counted as holes; repeated rows give equal bytes, as nothing depends on the row's identity; a very long text is one file;
extra columns stay, but those named like an added one are replaced; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, small_batches, table

RATE = 8000
#: Samples of a packet; above one page's 255 * 255 bytes a packet goes on in the next page.
PACKET = 4800
#: Packets that a page may finish before a new one begins.
PAGE_PACKETS = 12
PAD = 192
AUDIO, CHECKS = 0x5743_0001, 0x5743_0002
CONTINUED, BOS, EOS = 1, 2, 4
NO_GRANULE = 2**64 - 1

_HEAD = struct.Struct("<4sBBQIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's CRC (polynomial 0x04C11DB7, no reflection, start 0), by zlib's reflected one over reversed bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]], page_packets: int = PAGE_PACKETS) -> list[tuple[int, bytes]]:
    """(granule to sort by, page) of a logical stream; packets: (bytes, granule at its end). The first packet has a page of its own."""
    out: list[list] = []
    lacing, body, done, ends, flags = bytearray(), bytearray(), 0, NO_GRANULE, BOS

    def flush() -> None:
        nonlocal lacing, body, done, ends
        out.append([flags, ends, bytes(lacing), bytes(body)])
        lacing, body, done, ends = bytearray(), bytearray(), 0, NO_GRANULE

    for k, (packet, granule) in enumerate(packets):
        at, values = 0, [255] * (len(packet) // 255) + [len(packet) % 255]
        while values:
            room = 255 - len(lacing)
            if not room:
                flush()
                flags = CONTINUED if at else 0
                continue
            now, values = values[:room], values[room:]
            take = sum(now)
            lacing += bytes(now)
            body += packet[at : at + take]
            at += take
        done, ends = done + 1, granule
        if k == 0 or done >= page_packets:
            flush()
            flags = 0
    if lacing:
        flush()
    if out:
        out[-1][0] |= EOS
    keys = [g for _, g, _, _ in out]
    for n in range(len(keys) - 2, -1, -1):  # a page that ends no packet goes before the page that does
        keys[n] = keys[n + 1] if keys[n] == NO_GRANULE else keys[n]
    return [(key, _page(f, g, serial, n, la, bo)) for n, (key, (f, g, la, bo)) in enumerate(zip(keys, out, strict=True))]


def write(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file that holds the payload as unsigned 8-bit mono samples, with its check stream."""
    head = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, min(packet, 65535), 0)
    audio, checks = [(head, 0)], [(b"CRC32\0\0\0" + struct.pack("<I", rate), 0)]
    for at in range(0, len(payload), packet):
        part = payload[at : at + packet]
        audio.append((part, at + len(part)))
        checks.append((struct.pack("<I", zlib.crc32(part)), at + len(part)))
    a, c = pages_of(AUDIO, audio), pages_of(CHECKS, checks)
    # First pages of all streams first, then by time; at the same time the audio goes first.
    rest = sorted([(g, 0, n, p) for n, (g, p) in enumerate(a[1:])] + [(g, 1, n, p) for n, (g, p) in enumerate(c[1:])])
    return a[0][1] + c[0][1] + b"".join(x[3] for x in rest)


@dataclass
class Stream:
    """A logical stream: packets with their granule position, or None where a page ends more of them after it."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    holes: int = 0
    ended: bool = False
    begun: bool = False
    _next: int | None = None
    _part: bytearray | None = None


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many pages failed their checksum or their form."""
    streams: dict[int, Stream] = {}
    at, bad, n = 0, 0, len(data)
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > n:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        start = at + 27 + count
        end = start + sum(lacing)
        if version or len(lacing) < count or end > n or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad += 1
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if flags & BOS:  # also a chained file that uses the number again
            s.begun, s._next = True, number
        lost = s._next is not None and number != s._next
        s._next, s.pages, s.ended = (number + 1) % 2**32, s.pages + 1, bool(flags & EOS)
        skip = False
        if lost or (s._part is not None) != bool(flags & CONTINUED):
            s.holes += 1
            s._part, skip = None, bool(flags & CONTINUED)
        part, pos, first = s._part if s._part is not None else bytearray(), start, len(s.packets)
        open_ = False
        for v in lacing:
            part += data[pos : pos + v]
            pos += v
            open_ = v == 255
            if not open_:
                if not skip:
                    s.packets.append(bytes(part))
                    s.granules.append(None)
                part, skip = bytearray(), False
        s._part = part if open_ and not skip else None
        if len(s.packets) > first and granule != NO_GRANULE:
            s.granules[-1] = granule
        at = end
    return streams, bad


def audio(data: bytes) -> dict:
    """Samples, times and checks of a file of write(): rate, samples (bytes), pages, holes, bad, end_s, packet times, agree."""
    streams, bad = read(data)
    sound = next((s for s in streams.values() if s.packets and s.packets[0][:8] == b"PCM     "), None)
    check = next((s for s in streams.values() if s.packets and s.packets[0][:8] == b"CRC32\0\0\0"), None)
    if sound is None:
        return {"rate": 0, "samples": b"", "pages": 0, "packets": 0, "holes": 0, "bad": bad, "end_s": 0.0, "times": [], "agree": False, "streams": len(streams)}
    rate = struct.unpack_from(">I", sound.packets[0], 16)[0]
    body = sound.packets[1:]
    # Granules stand at page ends; the packets between count back from the next known one, a sample a byte.
    times, known = [0.0] * len(body), None
    for k in range(len(body) - 1, -1, -1):
        known = sound.granules[k + 1] if sound.granules[k + 1] is not None else known
        times[k] = known / rate if known is not None and rate else 0.0
        known = None if known is None else known - len(body[k])
    agree = check is not None and [struct.unpack("<I", p)[0] for p in check.packets[1:]] == [zlib.crc32(p) for p in body]
    return {"rate": rate, "samples": b"".join(body), "pages": sum(s.pages for s in streams.values()), "packets": len(body), "holes": sum(s.holes for s in streams.values()), "bad": bad, "end_s": times[-1] if times else 0.0, "times": times, "agree": agree, "streams": len(streams)}


def feature(x: dict) -> str:
    """Figures of the samples, all from whole numbers: seconds, mean, rms, share of zero crossings, least, most, packets, pages."""
    v = np.frombuffer(x["samples"], dtype=np.uint8)
    if not len(v):
        return f"0.000000|0|0|0|0|0|{x['packets']}|{x['pages']}|{x['bad']}|{x['holes']}"
    h = np.bincount(v, minlength=256)
    k = np.arange(256, dtype=np.int64) - 128
    mean, power = int((h * k).sum()) / len(v), int((h * k * k).sum()) / len(v)
    up = v >= 128
    cross = int(np.count_nonzero(up[1:] != up[:-1])) / max(1, len(v) - 1)
    return f"{x['end_s']:.6f}|{mean:.6f}|{power**0.5:.6f}|{cross:.6f}|{int(v.min())}|{int(v.max())}|{x['packets']}|{x['pages']}|{x['bad']}|{x['holes']}"


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 length, and the bytes with blanks up to a positive multiple of PAD."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def store(df: DataFrame, text: str = "text", media: str = "media", size: str = "n_bytes") -> DataFrame:
    """Adds the Ogg bytes of each text's padded UTF-8, and its unpadded length. Columns of these names are replaced."""
    keep = [c for c in df.columns if c not in (media, size)]
    narrow = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)
    schema = narrow.drop(text).withColumn(size, F.lit(0).cast("long")).withColumn(media, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [padded(t) for t in b.column(at).to_pylist()]
            rest = [b.column(i) for i in range(len(keep)) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([n for n, _ in both], pa.int64()), pa.array([write(p) for _, p in both], pa.binary())], [c for c in keep if c != text] + [size, media])

    return mapped(narrow, run, schema)


def probe(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces the media column by what reading it gives: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    added = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added or c == media])
    at, keep = df.columns.index(media), [c for c in df.columns if c != media]
    schema = df.drop(media).selectExpr(*[f"`{c}`" for c in keep], "0L payload_bytes", "'' payload_sha256", "0L tail_crc32", "0L media_bytes", "'' media_sha256", "'' feature").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(at).to_pylist():
                x = audio(m or b"")
                s = x["samples"]
                rows.append((len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-16:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), feature(x)))
            new = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [pa.array(v, k) for v, k in zip(new, kinds, strict=True)], schema.names)

    return mapped(df, run, schema)


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return probe(store(table(spark, sf_dir, "documents").select("doc_id", "text")))
