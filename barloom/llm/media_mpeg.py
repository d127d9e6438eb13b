"""Media columns: MPEG audio.

``stored`` wraps bytes losslessly in an MPEG-1 Layer III stream: an ID3v2 tag, a first frame with the table of a
variable-bitrate stream (frames, bytes, 100 seek points), and one checksummed frame per 576 bytes of payload, which
lie in the frame's ancillary data (the frames decode as silence).  ``parsed`` reads any MPEG audio stream: it reads
tags, resynchronises on frame headers after foreign bytes, reads the variable-bitrate table (either kind), verifies frame
checksums, and gives exact durations (in samples) and the byte offset of every frame for seeking.  Checksums of layer II
aren't verified: what they cover depends on its allocation tables.

Null text counts as empty; an empty text is one unit of padding.  Equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 576

# Fixed values of the format: kbit/s by bitrate index for (MPEG-1, layer) and for the lower versions, and Hz by version bits.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# The stored form: mono, 48 kHz; payload frames of 224 kbit/s with a checksum, a first frame of 64 kbit/s without.
RATE, SIDE = 48000, 17
FRAME, FIRST = 144 * 224_000 // RATE, 144 * 64_000 // RATE
PAYLOAD_AT = 4 + 2 + SIDE


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT)), len(data)


def syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def syncsafe_number(four: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(four, (21, 14, 7, 0)))


def id3(n_bytes: int) -> bytes:
    body = b"\x00payload_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body
    return b"ID3\x03\x00\x00" + syncsafe(len(frame)) + frame


def stored(payload: bytes, n_bytes: int) -> bytes:
    """``payload`` (a positive multiple of 576 bytes) as an MPEG stream; the tag keeps ``n_bytes``, its length before padding."""
    n = len(payload) // UNIT
    total = FIRST + n * FRAME
    points = bytes(min(255, 256 * (FIRST + n * k // 100 * FRAME) // total) for k in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + points
    first = (b"\xff\xfb\x54\xc0" + bytes(SIDE) + table).ljust(FIRST, b"\x00")
    head, side = b"\xff\xfa\xc4\xc0", bytes(SIDE)
    frames = np.zeros((n, FRAME), dtype=np.uint8)
    frames[:, :PAYLOAD_AT] = np.frombuffer(head + crc16(head[2:] + side).to_bytes(2, "big") + side, dtype=np.uint8)
    frames[:, PAYLOAD_AT : PAYLOAD_AT + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    return id3(n_bytes) + first + frames.tobytes()


@lru_cache(4096)
def header(four: bytes) -> tuple | None:
    """(version, layer, protected, Hz, mono, frame bytes, samples) of a frame header; None if it can't be one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    bits, layer, rate, speed = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if bits == 1 or layer == 4 or rate in (0, 15) or speed == 3 or four[3] & 3 == 2:
        return None
    version, hertz = 1 if bits == 3 else 2, HERTZ[bits][speed]
    bit_rate, pad = KBITS[version, layer][rate] * 1000, four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version == 2 else 1152
    length = (12 * bit_rate // hertz + pad) * 4 if layer == 1 else samples // 8 * bit_rate // hertz + pad
    return version, layer, not four[1] & 1, hertz, four[3] >> 6 == 3, length, samples


def side_bytes(version: int, mono: bool) -> int:
    return (17 if mono else 32) if version == 1 else (9 if mono else 17)


def covered_bytes(layer: int, version: int, mode: int) -> int:
    """How many bytes after the checksum it covers besides the header: side information, or layer I's bit allocation."""
    if layer == 3:
        return side_bytes(version, mode >> 2 == 3)
    bound = 4 + 4 * (mode & 3) if mode >> 2 == 1 else 32
    return (32 if mode >> 2 == 3 else 32 + bound) // 2


def variable_table(media: bytes, frame: int, body: int) -> dict | None:
    """The variable-bitrate table of a first frame: frames, bytes and seek points, of the kind behind the side information or the one at a fixed place."""
    if media[body : body + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(media[body + 4 : body + 8], "big")
        words = [int.from_bytes(media[body + 8 + 4 * i : body + 12 + 4 * i], "big") for i in range(bin(flags & 3).count("1"))]
        table: dict = dict(zip([k for b, k in ((1, "frames"), (2, "bytes")) if flags & b], words))
        if flags & 4:
            table["points"] = list(media[body + 8 + 4 * len(words) : body + 108 + 4 * len(words)])
        return table
    at = frame + 36
    if media[at : at + 4] != b"VBRI":
        return None
    number = lambda a, n: int.from_bytes(media[at + a : at + a + n], "big")
    entries, scale, size = number(18, 2), number(20, 2), number(22, 2)
    return {"frames": number(14, 4), "bytes": number(10, 4), "points": [number(26 + size * i, size) * scale for i in range(entries)]}


def parsed(media: bytes) -> dict:
    """Tags, variable-bitrate table, frame offsets, exact duration and checksum results of a stream."""
    out = {"tags": {}, "table": None, "offsets": [], "samples": 0, "hertz": 0, "checked": 0, "bad": 0, "skipped": 0}
    at, end = 0, len(media)
    while media[at : at + 3] == b"ID3" and at + 10 <= end:
        size, syncsafe_frames = syncsafe_number(media[at + 6 : at + 10]), media[at + 3] >= 4
        p, stop = at + 10, min(end, at + 10 + size)
        while p + 10 <= stop and media[p] != 0:
            n = syncsafe_number(media[p + 4 : p + 8]) if syncsafe_frames else int.from_bytes(media[p + 4 : p + 8], "big")
            out["tags"].setdefault(media[p : p + 4].decode("latin-1"), media[p + 10 : min(stop, p + 10 + n)])
            p += 10 + n
        at = stop
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        out["tags"]["TAG"], end = media[end - 128 : end], end - 128
    sure = False
    while at + 4 <= end:
        h = header(media[at : at + 4])
        if h and at + h[5] <= end and (sure or at + h[5] + 4 > end or header(media[at + h[5] : at + h[5] + 4])):
            version, layer, protected, hertz, mono, length, samples = h
            body = at + 4 + 2 * protected + side_bytes(version, mono)
            first, sure = not sure and not out["offsets"] and out["table"] is None, True
            table = variable_table(media, at, body) if first and layer == 3 else None
            if table is not None:
                out["table"] = table
            else:
                out["offsets"].append(at)
                out["samples"] += samples
                out["hertz"] = out["hertz"] or hertz
                if protected and layer != 2:
                    out["checked"] += 1
                    seen = media[at + 2 : at + 4] + media[at + 6 : at + 6 + covered_bytes(layer, version, media[at + 3] >> 4)]
                    out["bad"] += crc16(seen) != int.from_bytes(media[at + 4 : at + 6], "big")
            at += length
        else:
            sure = False
            after = media.find(b"\xff", at + 1, end)
            out["skipped"] += (after if after >= 0 else end) - at
            at = after if after >= 0 else end
    return out


def payload_of(media: bytes, found: dict) -> bytes:
    return b"".join(media[o + PAYLOAD_AT : o + PAYLOAD_AT + UNIT] for o in found["offsets"])


def feature(found: dict) -> str:
    table = found["table"] or {}
    ms = found["samples"] * 1000 // found["hertz"] if found["hertz"] else 0
    steps = np.diff(found["offsets"]) if len(found["offsets"]) > 1 else np.zeros(1, dtype=int)
    return f"frames={len(found['offsets'])};table={table.get('frames', '-')};samples={found['samples']};hertz={found['hertz']};ms={ms};checked={found['checked']};bad={found['bad']};skipped={found['skipped']};step={int(steps.max())}"


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` for every row of ``doc_id, text``: the stored form in a binary column."""

    def run(texts: pd.Series) -> pd.DataFrame:
        made = [(n, stored(p, n)) for p, n in map(padded, texts)]
        return pd.DataFrame(made, columns=["n_bytes", "media"])

    return docs.select("doc_id", F.pandas_udf(run, "n_bytes long, media binary")("text").alias("_m")).select("doc_id", "_m.*")


def _indexed(media: str) -> Column:
    """A struct of exact duration, checksum results and frame seek offsets of the stream in a column."""

    def run(streams: pd.Series) -> pd.DataFrame:
        got = [parsed(m if m is not None else b"") for m in streams]
        return pd.DataFrame({"samples": [g["samples"] for g in got], "hertz": [g["hertz"] for g in got], "bad_frames": [g["bad"] for g in got], "skipped_bytes": [g["skipped"] for g in got], "frame_offsets": [g["offsets"] for g in got]})

    kinds = "samples long, hertz long, bad_frames long, skipped_bytes long, frame_offsets array<long>"
    return F.pandas_udf(run, kinds)(media)


def index(media: DataFrame) -> DataFrame:
    """``doc_id``, exact duration (``samples`` of ``hertz``), checksum results and frame seek offsets for every row of ``doc_id, media``, of any MPEG audio."""
    return media.select("doc_id", _indexed("media").alias("_m")).select("doc_id", "_m.*")


def catalogued(media: DataFrame) -> DataFrame:
    """The rows of ``media`` (a binary column of that name) with the columns of ``index``, to be stored beside the streams: a reader seeks frames without parsing."""
    return media.select("*", _indexed("media").alias("_m")).select(*[F.col(c) for c in media.columns], "_m.*")


def digest(media: DataFrame) -> DataFrame:
    """What the bytes of ``encode`` hold, read back: lengths, digests, features, the duration in samples, and a digest of the frames' seek offsets (little-endian 64-bit numbers)."""

    def run(streams: pd.Series) -> pd.DataFrame:
        rows = []
        for m in streams:
            found = parsed(m)
            payload = payload_of(m, found)
            seek = zlib.crc32(np.array(found["offsets"], dtype="<i8").tobytes())
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(found), found["samples"], found["hertz"], len(found["offsets"]), seek))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "hertz", "n_frames", "seek_crc32"])

    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, hertz long, n_frames long, seek_crc32 long"
    return media.select("doc_id", "n_bytes", F.pandas_udf(run, kinds)("media").alias("_d")).select("doc_id", "n_bytes", "_d.*")
