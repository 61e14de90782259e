"""Ogg columns: payloads written as Ogg files and read back with checksums, lacing, demultiplexing and timestamps.

A file has two logical streams. Stream 1 holds 8-bit unsigned mono samples (a header packet, then packets of up to 4,096
samples whose granule position is the number of samples so far); stream 2 holds one text packet naming the sample count.

Cases: a null text is an empty text, whose payload is 64 zero bytes; a text of any length is stored whole, one row at a
time; equal texts give equal bytes, as serial numbers depend on the stream only; null media are read as null, without an error; a
damaged page, a gap in the page numbers or a cut-off packet raises an error in `parse`, and in `features` gives a row of nulls that
says so in the column error; an empty table gives an empty result; columns of the same names as results are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, PACKET, BLOCK = 8000, 4096, 64
SAMPLES, TEXT = 1, 2
HEAD = "<4sBBqIIIB"
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))

INFO = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def page_checksum(page: bytes) -> int:
    """The CRC-32 of polynomial 04C11DB7, bits high first, from zero: that of zlib with every byte and the result mirrored."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def _pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream; the first packet has a page to itself."""
    out: list[bytes] = []
    lacing, body, granule, carried = bytearray(), bytearray(), -1, False

    def flush(open_packet: bool, last: bool) -> None:
        nonlocal lacing, body, granule, carried
        flags = carried | 2 * (not out) | 4 * last
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, carried = bytearray(), bytearray(), -1, open_packet

    for k, (data, end) in enumerate(packets):
        at = 0
        for n in [*[255] * (len(data) // 255), len(data) % 255]:
            if len(lacing) == 255:
                flush(at > 0, False)
            lacing.append(n)
            body += data[at : at + n]
            at += n
        granule = end
        if k == 0 and len(packets) > 1:
            flush(False, False)
    flush(False, True)
    return out


def encode(data: bytes, rate: int = RATE) -> bytes:
    """data as the samples of an Ogg file."""
    head = b"PCM     " + struct.pack(">HHIIBB", 0, 0, 1, rate, 0, 1)
    sound = [(head, 0), *((data[k : k + PACKET], min(k + PACKET, len(data))) for k in range(0, len(data), PACKET))]
    note = [(b"Text    ", 0), (f"samples={len(data)}".encode(), len(data))]
    a, b = _pages(sound, SAMPLES), _pages(note, TEXT)
    return b"".join([a[0], b[0], b[1], *a[1:]])  # the first pages of all streams come before any other


def _ends(packets: list[bytes], granule: int, before: int, last: bool, frame: int) -> list[int]:
    """Where each packet that ends in a page ends. The page's granule position is that of the last one; those before it end by
    their samples earlier (or, in a stream's last page, which may be cut short, by theirs later than the page before)."""
    ends, at = [], before if last else granule - sum(len(p) // frame for p in packets) if frame else granule
    for p in packets:
        at = min(at + (len(p) // frame if frame else 0), granule)
        ends.append(at)
    return [*ends[:-1], granule] if ends else []


def parse(media: bytes) -> dict[int, list[tuple[bytes, int, float]]]:
    """The packets of every logical stream by serial number: bytes, granule position and seconds at the packet's end."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) < at + 27:
            raise ValueError(f"cut off at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no Ogg page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if len(page) != end - at or page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError(f"damaged Ogg page at byte {at}")
        s = streams.setdefault(serial, {"next": 0, "part": None, "packets": [], "frame": 0, "rate": RATE, "end": 0})
        if number != s["next"] or bool(flags & 2) != (number == 0) or bool(flags & 1) != (s["part"] is not None):
            raise ValueError(f"Ogg page {number} of stream {serial} is out of order")
        s["next"] += 1
        pos, done = at + 27 + n, []
        for x in lacing:
            s["part"] = (s["part"] or b"") + media[pos : pos + x]
            pos += x
            if x < 255:
                done.append(s["part"])
                s["part"] = None
        if done:
            s["packets"] += zip(done, _ends(done, granule, s["end"], bool(flags & 4), s["frame"]))
            s["end"] = granule
        if number == 0 and done and done[0].startswith(b"PCM") and len(done[0]) >= 22:
            s["rate"], s["frame"] = struct.unpack_from(">I", done[0], 16)[0] or RATE, done[0][21] or 1
        at = end
    if any(s["part"] is not None for s in streams.values()):
        raise ValueError("a packet is cut off")
    return {serial: [(p, g, g / s["rate"]) for p, g in s["packets"]] for serial, s in streams.items()}


def describe(media: bytes) -> dict:
    """What the samples read back from media have: their bytes' digests and a line of features."""
    import hashlib

    streams = parse(media)
    if not {SAMPLES, TEXT} <= set(streams) or len(streams[SAMPLES]) < 2 or len(streams[TEXT]) < 2:
        raise ValueError("a stream is missing")
    sound = streams[SAMPLES][1:]
    data = b"".join(p for p, _, _ in sound)
    if dict(x.split(b"=") for x, _, _ in streams[TEXT][1:] if x.count(b"=") == 1).get(b"samples") != str(len(data)).encode() or sound[-1][1] != len(data):
        raise ValueError("samples are missing")
    x = np.frombuffer(data, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    turns = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    feature = f"streams={len(streams)};packets={len(sound)};first={sound[0][2]:.6f};seconds={sound[-1][2]:.6f};mean={total / len(x):.6f};rms={(square / len(x)) ** 0.5:.6f};crossings={turns};peak={int(x.max())}"
    return {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-BLOCK:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}


def _to_ogg(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([encode(payload(t)) for t in s], dtype=object)


def _info(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in INFO.split(", ")]

    def one(m: bytes | None) -> dict:
        try:
            return dict.fromkeys(names) | (describe(m) if m is not None else {})
        except ValueError as e:
            return dict.fromkeys(names) | {"error": str(e)}

    for s in batches:
        yield pd.DataFrame([one(m) for m in s], columns=names).astype({n: "Int64" for n in ("payload_bytes", "tail_crc32", "media_bytes")})


def media(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with the Ogg file of every text."""
    return docs.withColumn(out, F.pandas_udf(_to_ogg, "binary")(F.col(text_col)))


def features(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows without their media, but with what is read back from them."""
    rest = [c for c in rows.columns if c != media_col and c not in {x.split()[0] for x in INFO.split(", ")}]
    return rows.select(*rest, F.pandas_udf(_info, INFO)(F.col(media_col)).alias("__info")).select(*rest, "__info.*")
