"""MPEG audio in binary columns: a writer that carries bytes and a reader of frames, tags and seek tables.

The reader takes any MPEG-1, 2 or 2.5 stream of layers I to III: it parses
ID3v2 and ID3v1 tags and the variable-bitrate tables (Xing, Info, VBRI),
follows frame headers and finds the next frame again after damage, verifies
the frames' checksums, and gives exact durations (samples over rate) and the
byte offset of each frame.

The writer stores a payload without loss in the frames' ancillary bytes: each
frame has a checksum and empty side information, so a decoder plays silence,
and the rest of the frame is payload. An ID3v2 tag holds the payload's length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, columns, map_batches, text_or_empty

# Fixed values of the format: kbit/s by (MPEG-1?, layer) and index, and samples a second by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Bits of a subband's allocation in layer II, as (bits, subbands) from the lowest subband on.
ALLOCATIONS = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005


def crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (CRC_POLYNOMIAL if crc & 0x8000 else 0)
        table.append(crc & 0xFFFF)
    return table


CRC_TABLE = crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    layer: int
    mpeg1: bool
    kbps: int
    rate: int
    size: int
    samples: int
    protected: bool
    mono: bool
    #: The first subband whose allocation both channels share (layers I and II).
    bound: int = 32

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def parse_header(raw: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (free-format bitrates are not taken)."""
    if raw in _headers:
        return _headers[raw]
    found = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0:
        version, layer = (raw[1] >> 3) & 3, 4 - ((raw[1] >> 1) & 3)
        bits, rate = raw[2] >> 4, (raw[2] >> 2) & 3
        if version != 1 and layer != 4 and 0 < bits < 15 and rate != 3 and raw[3] & 3 != 2:
            mpeg1 = version == 3
            kbps, hz, pad = BITRATES[mpeg1, layer][bits], RATES[version][rate], (raw[2] >> 1) & 1
            samples = 384 if layer == 1 else 576 if layer == 3 and not mpeg1 else 1152
            size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
            bound = 4 * ((raw[3] >> 4 & 3) + 1) if raw[3] >> 6 == 1 else 32
            found = Header(layer, mpeg1, kbps, hz, size, samples, not raw[1] & 1, raw[3] >> 6 == 3, bound)
    if len(_headers) < 10_000:
        _headers[raw] = found
    return found


@dataclass
class Audio:
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    #: Samples by rate, as a stream may change it.
    at_rate: dict[int, int] = field(default_factory=dict)
    kbps_sum: int = 0
    checked: int = 0
    wrong: int = 0
    skipped: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)

    @property
    def duration_us(self) -> int:
        """Whole microseconds of the exact sum of samples over rates."""
        return int(sum((Fraction(n * 1_000_000, rate) for rate, n in self.at_rate.items()), Fraction(0)))

    @property
    def table_agrees(self) -> bool:
        """Whether the seek table has the stream's frames and, if it holds places, each is that of its frame."""
        n, size = len(self.offsets), self.table.get("bytes")
        if self.table.get("frames") != n:
            return False
        toc = self.table.get("toc")
        return not toc or not size or not n or all(abs((self.offsets[n * k // 100] - self.table["at"]) * 256 // size - place) <= 1 or place == 255 for k, place in enumerate(toc))


def syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def parse_id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """The length of the tag in front (0: none) and its text frames."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    end = 10 + syncsafe(data[6:10])
    at, tags = 10, {}
    while at + 10 <= min(end, len(data)) and data[at] and data[3] in (3, 4):
        size = syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + size, end)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += 10 + size
    return end + 10 * bool(data[5] & 0x10), tags


def parse_table(frame: bytes, head: Header) -> dict:
    """The Xing, Info or VBRI table of a first frame: name, and of frames, bytes, toc (Xing: 100 places) or entries (VBRI: bytes of each ``per`` frames) what the frame really holds."""
    at = 4 + 2 * head.protected + head.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, out, p = int.from_bytes(frame[at + 4 : at + 8]), {"name": frame[at : at + 4].decode()}, at + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit and len(frame) >= p + size:
                out[name] = frame[p : p + size] if name == "toc" else int.from_bytes(frame[p : p + size])
            p += size * bool(flags & bit)
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        size, frames = struct.unpack(">II", frame[46:54])
        out = {"name": "VBRI", "frames": frames, "bytes": size}
        if len(frame) >= 62:
            n, scale, width, per = struct.unpack(">HHHH", frame[54:62])
            if 1 <= width <= 4 and len(frame) >= 62 + n * width:
                out |= {"per": per, "entries": [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width]) for k in range(n)]}
        return out
    return {}


def read_audio(data: bytes) -> Audio:
    """Walk all frames of a stream; a frame counts if its header is valid and another frame, a tag or the end follows it."""
    out = Audio()
    at, out.tags = parse_id3v2(data)
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))

    def frame_at(p: int) -> Header | None:
        head = parse_header(data[p : p + 4])
        if head is None or p + head.size > end:
            return None
        nxt = p + head.size
        return head if nxt == end or parse_header(data[nxt : nxt + 4]) else None

    lost = False
    while at + 4 <= end:
        head = frame_at(at)
        if head is None:
            whole = parse_header(data[at : at + 4])
            if whole is None or lost or at + whole.size > end:
                nxt = data.find(b"\xff", at + 1, end)
                out.resyncs += not lost
                lost = True
                out.skipped += (nxt if nxt >= 0 else end) - at
                if nxt < 0:
                    return out
                at = nxt
                continue
            head = whole  # a sound frame that damage follows
        lost = False
        if not out.offsets and not out.table and (table := parse_table(data[at : at + head.size], head)):
            out.table = table | {"at": at}
        else:
            out.offsets.append(at)
            out.sizes.append(head.size)
            out.starts.append(out.samples)
            out.samples += head.samples
            out.rate = out.rate or head.rate
            out.at_rate[head.rate] = out.at_rate.get(head.rate, 0) + head.samples
            out.kbps_sum += head.kbps
            if head.protected:
                out.checked += 1
                out.wrong += not (crc_holds(data[at : at + 6 + head.side]) if head.layer == 3 else allocation_crc_holds(data[at : at + head.size], head))
        at += head.size
    out.skipped += end - at
    return out


_crcs: dict[bytes, int] = {}


def crc_holds(front: bytes) -> bool:
    """Whether the checksum in bytes 4 and 5 fits the header's last two bytes and the side information."""
    covered = front[2:4] + front[6:]
    crc = _crcs.get(covered)
    if crc is None:
        crc = crc16(covered)
        if len(_crcs) < 10_000:
            _crcs[covered] = crc
    return crc == front[4] << 8 | front[5]


def crc_of_bits(data: bytes, n: int, crc: int) -> int:
    """The checksum goes on over the first ``n`` bits."""
    for k in range(n):
        bit = data[k >> 3] >> (7 - (k & 7)) & 1
        crc = ((crc << 1) & 0xFFFF) ^ (CRC_POLYNOMIAL if (crc >> 15) ^ bit else 0)
    return crc


def allocation_crc_holds(frame: bytes, head: Header) -> bool:
    """Whether the checksum of a frame of layer I or II fits the header's last two bytes and the bits of its allocation (in layer II also of its scale factor selection)."""
    body, channels = frame[6:], 1 if head.mono else 2
    if head.layer == 1:
        n = 4 * (channels * head.bound + 32 - head.bound)
    else:
        each = head.kbps // channels
        if not head.mpeg1:
            table = "low"
        elif each <= 48:
            table = "d" if head.rate == 32000 else "c"
        else:
            table = "a" if head.rate == 48000 or each <= 80 else "b"
        bits = int.from_bytes(body[:128], "big") << 1024 - 8 * min(len(body), 128)
        at, used = 0, 0
        for k, width in enumerate([w for w, times in ALLOCATIONS[table] for _ in range(times)]):
            for _ in range(channels if k < head.bound else 1):
                value = bits >> (1024 - at - width) & ((1 << width) - 1)
                used += bool(value) * (1 if k < head.bound else channels)
                at += width
        n = at + 2 * used
    return n <= 8 * len(body) and crc_of_bits(body, n, crc16(frame[2:4])) == frame[4] << 8 | frame[5]


# The writer's frames: MPEG-1 layer III, 32 kHz, one channel.
_SIDE, _RATE_INDEX = 17, 2


def _front(index: int) -> bytes:
    """Header, checksum and empty side information of a frame with the bitrate ``index``."""
    head = bytes([0xFF, 0xFA, index << 4 | _RATE_INDEX << 2, 0xC0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(_SIDE))) + bytes(_SIDE)


FRONTS = {parse_header(_front(k)[:4]).size: _front(k) for k in range(1, 15)}
LARGEST, ROOM = max(FRONTS), len(_front(1))


def write_audio(payload: bytes) -> bytes:
    """A stream that holds ``payload``: ID3v2 tag, Xing frame, full frames and a last one of the smallest bitrate that takes the rest."""
    step = LARGEST - ROOM
    frames = [FRONTS[LARGEST] + payload[k : k + step] for k in range(0, len(payload) - step + 1, step)]
    rest = payload[len(frames) * step :]
    if rest or not frames:
        size = min(s for s in FRONTS if s >= ROOM + len(rest))
        frames.append(FRONTS[size] + rest + bytes(size - ROOM - len(rest)))
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    text_frame = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    n = len(text_frame)
    tag = b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + text_frame
    first = min(FRONTS)
    total = first + sum(map(len, frames))
    ends = first + np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    toc = bytes(min(255, int(ends[len(frames) * k // 100] * 256 // total)) for k in range(100))
    xing = bytes([0xFF, 0xFB, 1 << 4 | _RATE_INDEX << 2, 0xC0]) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return tag + xing + bytes(first - len(xing)) + b"".join(frames)


def read_payload(data: bytes, audio: Audio) -> bytes | None:
    """The payload that ``write_audio`` stored; None for streams of other writers."""
    if not audio.tags.get("payload_bytes", "").isdecimal():
        return None
    return b"".join([data[at + ROOM : at + size] for at, size in zip(audio.offsets, audio.sizes, strict=True)])[: int(audio.tags["payload_bytes"])]


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def feature_of(audio: Audio) -> str:
    """One line: frames, samples, rate, duration in microseconds, mean bitrate, checksums, damage, table and a checksum of the seek offsets."""
    seek = zlib.crc32(struct.pack(f"<{len(audio.offsets)}Q", *audio.offsets))
    agrees = int(audio.table_agrees)
    micro = audio.duration_us
    mean = audio.kbps_sum * 1000 // max(1, len(audio.offsets))
    return f"frames={len(audio.offsets)};samples={audio.samples};rate={audio.rate};duration_us={micro};mean_bps={mean};crc={audio.checked - audio.wrong}/{audio.checked};resyncs={audio.resyncs};skipped={audio.skipped};table={audio.table.get('name', '')}:{agrees};seek_crc32={seek:08x}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as an MPEG audio stream in a binary column. A null text counts as empty; other columns are not read."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            return batch_of(batch.column(0), [len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.array([write_audio(padded(t)) for t in texts], pa.binary()))

        return step

    return map_batches(docs.select(F.col(id_col), text_or_empty(text_col)), make, f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def read_media(media: DataFrame, col: str = "media", out: str = "audio") -> DataFrame:
    """``media`` with one struct column ``out`` for each stream: tags, durations, checksums, damage and seek table.

    A null or foreign value gives no frames. Offsets and first samples are
    those of every frame, so a seek is exact; ``rate`` is the first frame's,
    the duration follows every frame's own. A column named ``out`` is replaced.
    """
    kinds = {"samples": (T.LongType(), pa.int64()), "rate": (T.IntegerType(), pa.int32()), "duration_us": (T.LongType(), pa.int64()), "checked": (T.IntegerType(), pa.int32()), "wrong": (T.IntegerType(), pa.int32()), "resyncs": (T.IntegerType(), pa.int32()), "skipped": (T.LongType(), pa.int64()), "table": (T.StringType(), pa.string()), "table_agrees": (T.BooleanType(), pa.bool_()), "tags": (T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())), "offsets": (T.ArrayType(T.LongType()), pa.list_(pa.int64())), "starts": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [read_audio(x or b"") for x in batch.column(1).to_pylist()]
            rows = [(a.samples, a.rate, a.duration_us, a.checked, a.wrong, a.resyncs, a.skipped, a.table.get("name"), a.table_agrees, [*a.tags.items()], a.offsets, a.starts) for a in found]
            audio = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds.values())], [*kinds])
            return batch_of(batch.column(0), audio)

        return step

    carried = [c for c in media.columns if c != out]
    rows = media.select(F.struct(*columns(carried)).alias("row"), *[c.cast("binary").alias("media") for c in columns([col])])
    schema = T.StructType([rows.schema["row"], T.StructField(out, T.StructType([T.StructField(n, t) for n, (t, _) in kinds.items()]))])
    return map_batches(rows, make, schema).select(*[F.col("row")[c].alias(c) for c in carried], *columns([out]))


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of stored texts, all from the bytes of the ``media`` column read back.

    A null value has null digests; a stream that another writer made has null
    payload columns, and its own size, digest and feature.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], []]
            for data in batch.column(2).to_pylist():
                row: tuple = (None,) * 6
                if data is not None:
                    audio = read_audio(data)
                    payload = read_payload(data, audio)
                    of_payload = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
                    row = (*of_payload, len(data), hashlib.sha256(data).hexdigest(), feature_of(audio))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            return batch_of(batch.column(0), batch.column(1), *cols)

        return step

    names = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    schema = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), *[T.StructField(c, t) for c, t in names.items()]])
    return map_batches(media.select(id_col, "n_bytes", "media"), make, schema)
