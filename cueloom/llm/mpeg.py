"""MPEG audio columns: writing bytes losslessly into frames, and reading any stream's frames, tags and tables.

A payload travels in the ancillary part of MPEG-1 layer III frames whose side information says that no bits
belong to sound, so players hear silence and the bytes come back unchanged.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from cueloom.checkpoints import freeze
from cueloom.llm.textscan import slices

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by index for (version 1 or 2, layer), Hz by version, samples by layer.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

#: A seek offset is kept for every so many frames.
SEEK_EVERY = 50
SIDE_BYTES = 17  # of a mono layer III frame, version 1
TAG_KEY = b"payload_bytes"


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        table.append(crc & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 8005, start FFFF."""
    crc = 0xFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ b]
    return crc


_headers: dict[int, tuple | None] = {}


def header(word: int) -> tuple[int, int, int, int, bool, int] | None:
    """(frame length, samples, Hz, kbit/s, has checksum, side information bytes) of a 32-bit header; None if it is none."""
    if word not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        _headers[word] = _header(word)
    return _headers[word]


def _header(word: int) -> tuple | None:
    version, layer, rate, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    v, mono = (1 if version == 3 else 2), word >> 6 & 3 == 3
    kbit, hertz, samples, padded = BITRATES[v, layer][rate], RATES[version][hz], SAMPLES[v, layer], word >> 9 & 1
    length = (12000 * kbit // hertz + padded) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hertz + padded
    side = 0 if layer != 3 else ((17 if mono else 32) if v == 1 else (9 if mono else 17))
    return length, samples, hertz, kbit, not word >> 16 & 1, side


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where the audio begins and ends, and the text frames of the ID3v2 and ID3v1 tags.

    ``TAG`` 128 bytes before the end is no ID3v1 tag if the last frame spans it and ends exactly where the stream does.
    """
    begin, end, tags = 0, len(data), {}
    if data[:3] == b"ID3" and len(data) >= 10:
        size = _synchsafe(data[6:10])
        begin = min(len(data), 10 + size + (10 if data[5] & 16 else 0))
        at, stop = 10, min(len(data), 10 + size)
        while at + 10 <= stop and data[at] != 0:
            name, raw = data[at : at + 4], data[at + 4 : at + 8]
            length = _synchsafe(raw) if data[3] == 4 else int.from_bytes(raw, "big")
            body = data[at + 10 : min(stop, at + 10 + length)]
            if name[:1] == b"T" and body:
                parts = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0").split("\0")
                tags[parts[0] if name == b"TXXX" and len(parts) > 1 else name.decode("latin-1")] = parts[-1]
            at += 10 + length
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG" and not _spanned(data, begin, end - 128):
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return begin, end, tags


def _spanned(data: bytes, begin: int, at: int) -> bool:
    """Whether the last frame of the whole stream ends with it and begins before at."""
    first, last = _frames(data, begin, len(data), {})["last"]
    return first < at and last == len(data)


def parse(data: bytes) -> dict:
    """Read a stream whole: frames, exact duration, checksums, variable-bitrate table and seek offsets.

    After bytes that are no frame the next header counts only if another header, or the end, stands where its
    frame ends. A frame cut off by the end of the stream is not counted.
    """
    return _frames(data, *read_tags(data))


def _frames(data: bytes, begin: int, end: int, tags: dict[str, str]) -> dict:
    """What parse() returns, of the frames between begin and end."""
    out = {"n_frames": 0, "samples": 0, "hertz": 0, "bad_crc": 0, "checked": 0, "skipped": 0, "kbits": set(), "seek": [], "bodies": [], "tags": tags, "vbr_frames": None, "vbr_bytes": None, "toc": b"", "first": None, "last": (end, begin)}
    at, synced, crcs = begin, False, {}
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        nxt = at + h[0] if h else 0
        if h is None or nxt > end or not synced and nxt != end and (nxt + 4 > end or header(int.from_bytes(data[nxt : nxt + 4], "big")) is None):
            found = data.find(b"\xff", at + 1, end)
            step = (found if found >= 0 else end) - at
            out["skipped"] += step
            at, synced = at + step, False
            continue
        synced, out["last"] = True, (at, nxt)
        length, samples, hertz, kbit, checked, side = h
        head = 4 + 2 * checked
        if checked and side:
            span = data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]
            if span not in crcs:
                crcs[span] = crc16(span)
            out["checked"] += 1
            out["bad_crc"] += crcs[span] != int.from_bytes(data[at + 4 : at + 6], "big")
        body = at + head + side
        if out["first"] is None:
            out["first"] = at
            if data[body : body + 4] in (b"Xing", b"Info"):
                flags, p = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
                for bit, key in ((1, "vbr_frames"), (2, "vbr_bytes")):
                    if flags & bit:
                        out[key] = int.from_bytes(data[p : p + 4], "big")
                        p += 4
                out["toc"] = data[p : p + 100] if flags & 4 else b""
                at = nxt
                continue
            if data[at + 36 : at + 40] == b"VBRI":
                out["vbr_bytes"], out["vbr_frames"] = struct.unpack(">II", data[at + 46 : at + 54])
                at = nxt
                continue
        if out["n_frames"] % SEEK_EVERY == 0:
            out["seek"].append(at)
        out["n_frames"] += 1
        out["samples"] += samples
        out["hertz"] = out["hertz"] or hertz
        out["kbits"].add(kbit)
        out["bodies"].append((body, nxt))
        at = nxt
    out["skipped"] += max(0, end - at)
    return out


def _frame_word(index: int) -> bytes:
    return struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 2 << 10 | 3 << 6)  # version 1, layer III, checksum, 32 kHz, mono


_FRAMES = []
for _i in range(1, 15):
    _word, _size = _frame_word(_i), SAMPLES[1, 3] // 8 * 1000 * BITRATES[1, 3][_i] // 32000
    _FRAMES.append((_size - 6 - SIDE_BYTES, _word + struct.pack(">H", crc16(_word[2:] + bytes(SIDE_BYTES))) + bytes(SIDE_BYTES)))


def build(payload: bytes) -> bytes:
    """Store payload: an ID3v2 tag with its length, a table frame, then frames of the highest rate and a last one just large enough."""
    text = b"\0" + TAG_KEY + b"\0" + str(len(payload)).encode()
    frame = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(frame)
    tag = b"ID3\3\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + frame
    room, head = _FRAMES[-1]
    parts, starts, at = [], [], 0
    for i in range(0, len(payload), room):
        piece = payload[i : i + room]
        if len(piece) < room:
            space, front = next(f for f in _FRAMES if f[0] >= len(piece))
            piece += bytes(space - len(piece))
        else:
            front = head
        parts.append(front + piece)
        starts.append(at)
        at += len(front) + len(piece)
    space, front = next(f for f in _FRAMES if f[0] >= 116)
    total = at + len(front) + space
    toc = bytes(min(255, (len(front) + space + starts[min(len(starts) - 1, len(starts) * k // 100)]) * 256 // total) if starts else 0 for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(parts), total) + toc
    return tag + front + table + bytes(space - len(table)) + b"".join(parts)


def payload_of(data: bytes, parsed: dict) -> bytes:
    """The bytes that build() stored."""
    body = b"".join([data[a:b] for a, b in parsed["bodies"]])
    return body[: int(parsed["tags"].get(TAG_KEY.decode(), len(body)))]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column(1)):
            raws = [s.row_bytes(r) for r in range(len(s))]
            media = [build(raw + bytes(-len(raw) % 64 or (0 if raw else 64))) for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, duration_us long, sample_rate long, mean_kbit double, bad_crc long, skipped_bytes long, table_agrees boolean, seek_offsets array<long>"
)


def _row(media: bytes) -> tuple:
    p = parse(media)
    payload = payload_of(media, p)
    micros = p["samples"] * 1_000_000 // p["hertz"] if p["hertz"] else 0
    sound = sum(b - a for a, b in p["bodies"])
    mean = sound * 8 * p["hertz"] / p["samples"] / 1000 if p["samples"] else 0.0
    agrees = p["vbr_frames"] == p["n_frames"]
    seek = zlib.crc32(b"".join(x.to_bytes(8, "little") for x in p["seek"]))
    feature = f"frames={p['n_frames']};us={micros};hz={p['hertz']};rates={'/'.join(map(str, sorted(p['kbits'])))};crc_bad={p['bad_crc']}/{p['checked']};skipped={p['skipped']};seek={len(p['seek'])}:{seek:08x}"
    return (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), feature, p["n_frames"], micros, p["hertz"], mean, p["bad_crc"], p["skipped"], agrees, p["seek"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    for batch in batches:
        rows = [_row(m.as_py() or b"") for m in batch.column(2)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty), padded with zero bytes to a multiple of 64, as an MPEG audio stream."""
    return docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Parse each stream of (doc_id, n_bytes, media): durations, checksums, tables, seek offsets and the payload's digests.

    A null stream counts as an empty one: no frames, an empty payload. Rows are parsed where they are read, one
    stream at a time; repeated rows give repeated results, and other columns are ignored.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)


def audio_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a stream in a table, read the table back and parse it."""
    return media_features(freeze(store_media(docs), "media"))
