"""Media columns: MPEG-1 audio, layer III.

``encode`` stores bytes losslessly in a stream that players accept as silence: every frame has
a header, a checksum and zeroed side information, and the bytes stand where decoders skip
ancillary data. Frames have variable bitrate: full ones at the highest, the last at the lowest
that holds the rest. An ID3v2 tag goes ahead, whose TXXX frame names the length of the
payload, then a Xing frame with the number of frames, the bytes and a table of 100 seek
points, then the frames, then an ID3v1 tag.

``decode`` reads such streams, and others: it skips or parses tags, finds frames by their
headers, resynchronises after damage (a header counts only if the next one follows it, or the
stream ends there), reads the Xing table, verifies checksums, and gives exact durations
(samples over the rate) and the byte offset of every frame.

Defined results: null and empty texts store a payload of 192 spaces; a null stream counts as an
empty one; streams without any frame have 0 frames, duration 0 and an empty payload; a length
of the payload that is not a number in ASCII digits is left aside; repeated rows are repeated,
empty tables stay empty, and other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: bitrates of MPEG-1 layer III in kbit/s, sampling rates in Hz.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
#: What encode writes: 48 kHz, mono, with checksum. Header, checksum and side information of a frame.
RATE, OVERHEAD = 48000, 4 + 2 + 17
#: Payloads are padded with spaces to a multiple of this.
UNIT = 192
_HEADS = [0xFFFA << 16 | i << 12 | 1 << 10 | 3 << 6 for i in range(15)]
_SIZES = [144000 * b // RATE for b in BITRATES]


def _crc16_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc16_table()


def crc16(raw: bytes) -> int:
    """CRC-16 of the format: polynomial 8005, start FFFF."""
    crc = 0xFFFF
    for b in raw:
        crc = ((crc << 8) & 0xFFFF) ^ int(_CRC[(crc >> 8) ^ b])
    return crc


#: Start of a frame by index of its bitrate: header, checksum, zeroed side information.
_STARTS = [(h := struct.pack(">I", head)) + struct.pack(">H", crc16(h[2:] + bytes(17))) + bytes(17) for head in _HEADS]


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes, title: str = "") -> bytes:
    """The stream that stores payload."""
    full = _SIZES[14] - OVERHEAD
    n_full, rest = divmod(len(payload), full)
    body = np.empty((n_full, _SIZES[14]), np.uint8)
    body[:, :OVERHEAD] = np.frombuffer(_STARTS[14], np.uint8)
    body[:, OVERHEAD:] = np.frombuffer(payload, np.uint8, n_full * full).reshape(n_full, full)
    frames = [body.tobytes()]
    sizes = [_SIZES[14]] * n_full
    if rest:
        i = next(i for i in range(1, 15) if _SIZES[i] - OVERHEAD >= rest)
        frames.append((_STARTS[i] + payload[n_full * full :]).ljust(_SIZES[i], b"\0"))
        sizes.append(_SIZES[i])
    size = 192 + sum(sizes)  # with the Xing frame itself, of 64 kbit/s
    ends = np.concatenate([[192], 192 + np.cumsum(sizes)]) if sizes else np.array([192])
    at = ends[np.minimum(np.arange(100) * len(sizes) // 100, max(len(sizes) - 1, 0))]
    seek = np.minimum(255, at * 256 // size).astype(np.uint8).tobytes()
    xing = (_STARTS[5] + b"Xing" + struct.pack(">III", 7, len(sizes), size) + seek).ljust(192, b"\0")
    tags = [(b"TIT2", b"\x03" + title.encode()), (b"TXXX", b"\x03payload_bytes\0" + str(len(payload)).encode())]
    tag = b"".join(k + _syncsafe(len(v)) + b"\0\0" + v for k, v in tags if k != b"TIT2" or title)
    return b"".join([b"ID3\x04\0\0", _syncsafe(len(tag)), tag, xing, *frames, b"TAG".ljust(127, b"\0") + b"\xff"])


@dataclass
class Stream:
    """What decode finds."""

    payload: bytes = b""
    frames: int = 0
    seconds: float = 0.0
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    bitrates: dict[int, int] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    table_frames: int = -1
    table_bytes: int = -1
    seek: bytes = b""
    bad_checksums: int = 0
    resyncs: int = 0
    rate: int = 0


def _frame(raw: bytes, at: int) -> tuple[int, int, int, int, bool] | None:
    """(size, bitrate, rate, side information, checksum?) of the header at a place."""
    if at + 4 > len(raw):
        return None
    (h,) = struct.unpack_from(">I", raw, at)
    i, r = h >> 12 & 15, h >> 10 & 3
    if h >> 17 != 0x7FFD or i in (0, 15) or r == 3:
        return None
    size = 144000 * BITRATES[i] // RATES[r] + (h >> 9 & 1)
    return size, BITRATES[i], RATES[r], 17 if h >> 6 & 3 == 3 else 32, not h >> 16 & 1


def _id3v2(raw: bytes, tags: dict[str, str]) -> int:
    """Parse the tag at the start of raw; its end."""
    if raw[:3] != b"ID3" or len(raw) < 10:
        return 0
    size = 0
    for b in raw[6:10]:
        size = size << 7 | b & 127
    end, at = min(len(raw), 10 + size), 10
    while at + 10 <= end and raw[at : at + 4].strip(b"\0"):
        n = 0
        for b in raw[at + 4 : at + 8]:
            n = n << 7 | b & 127 if raw[3] == 4 else n << 8 | b
        key, value = raw[at : at + 4].decode("latin1"), raw[at + 11 : min(end, at + 10 + n)].decode("utf-8", "replace")
        if key == "TXXX":
            key, _, value = value.partition("\0")
        tags[key] = value
        at += 10 + n
    return end


def decode(raw: bytes | None) -> Stream:
    """Parse a stream."""
    raw, out = raw or b"", Stream()
    at = _id3v2(raw, out.tags)
    end = len(raw) - 128 if raw[-128:-125] == b"TAG" and len(raw) >= at + 128 else len(raw)
    offsets: list[int] = []
    parts: list[bytes] = []
    samples = 0.0
    lost = first = True
    while at + 4 <= end:
        f = _frame(raw, at)
        if f is None or at + f[0] > end or (lost and at + f[0] < end and _frame(raw, at + f[0]) is None):
            out.resyncs += not lost
            lost = True
            at = raw.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        size, bitrate, out.rate, side, checked = f
        lost = False
        body = at + 4 + 2 * checked + side
        if first and raw[body : body + 4] in (b"Xing", b"Info"):
            (flags,) = struct.unpack_from(">I", raw, body + 4)
            p = body + 8
            if flags & 1:
                (out.table_frames,) = struct.unpack_from(">I", raw, p)
                p += 4
            if flags & 2:
                (out.table_bytes,) = struct.unpack_from(">I", raw, p)
                p += 4
            if flags & 4:
                out.seek = raw[p : p + 100]
            first = False
            at += size
            continue
        first = False
        # a run of frames with the same start, as encode writes them, is checked and cut as a matrix
        start, n = raw[at:body], 1
        if raw[at + size : at + size + len(start)] == start:
            whole = np.frombuffer(raw, np.uint8, (end - at) // size * size, at).reshape(-1, size)
            same = (whole[:, : len(start)] == whole[0, : len(start)]).all(axis=1)
            n = int(same.argmin()) if not same.all() else len(same)
        if checked and crc16(start[2:4] + start[6:]) != int.from_bytes(start[4:6], "big"):
            out.bad_checksums += n
        block = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
        parts.append(block[:, body - at :].tobytes())
        offsets.extend(range(at, at + n * size, size))
        out.bitrates[bitrate] = out.bitrates.get(bitrate, 0) + n
        samples += n * SAMPLES / out.rate
        at += n * size
    out.offsets, out.frames, out.seconds = np.array(offsets, dtype=np.int64), len(offsets), samples
    named = out.tags.get("payload_bytes", "")
    payload = b"".join(parts)
    out.payload = payload[: int(named)] if re.fullmatch("[0-9]{1,18}", named) else payload
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a stream."""

    @F.pandas_udf("n_bytes long, media binary")
    def stored(texts: pd.Series) -> pd.DataFrame:
        found = [padded(t) for t in texts]
        return pd.DataFrame({"n_bytes": [n for n, _ in found], "media": [encode(p) for _, p in found]}, columns=["n_bytes", "media"])

    return docs.select("doc_id", stored(F.col("text").cast("string")).alias("found")).select("doc_id", "found.n_bytes", "found.media")


def inspect(media: DataFrame, *keep: str) -> DataFrame:
    """What decode finds in each stream, with digests of the payload and of the stream.

    Columns: those named in keep, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, frames, duration_us, bad_checksums, resyncs, frame_offsets, feature.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "duration_us", "bad_checksums", "resyncs", "frame_offsets", "feature"]

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, duration_us long, bad_checksums long, resyncs long, frame_offsets array<long>, feature string")
    def found(streams: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in streams:
            raw = raw or b""
            s = decode(raw)
            mean = round(sum(b * n for b, n in s.bitrates.items()) / s.frames) if s.frames else 0
            micros = round(s.seconds * 1_000_000)
            feature = f"mp3;frames={s.frames};us={micros};kbps={mean};rate={s.rate};table={s.table_frames}/{s.table_bytes};bad={s.bad_checksums};resync={s.resyncs};seek={zlib.crc32(s.seek):08x}"
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), s.frames, micros, s.bad_checksums, s.resyncs, s.offsets, feature))
        return pd.DataFrame(rows, columns=names)

    return media.select(*keep, found("media").alias("found")).select(*keep, "found.*")
