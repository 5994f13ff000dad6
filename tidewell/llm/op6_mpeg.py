"""MPEG audio columns: write and read frame streams, resynchronise, check checksums, time and seek exactly.

A payload is stored in the ancillary bytes of silent Layer III frames with checksums, behind a tag and a
variable-bitrate table, so any reader of MPEG audio can walk the stream; a unit of the payload is one frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.vec import steps
from tidewell.tables import table

# Fixed values of the format: kbit/s by index, for MPEG 1 layers I, II, III and for MPEG 2 layers I and II/III.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Samples a second by version.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
# Samples in a frame by version (1; 2 and 2.5) and layer.
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
# Layer II: (bits of an allocation, subbands that have so many), by table.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}
# Text encodings of tags by their number, and the fields of an ID3v1 tag with their sizes.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
ID3V1 = (("title", 30), ("artist", 30), ("album", 30), ("year", 4), ("comment", 30))


@dataclass
class Header:
    version: float
    layer: int
    bitrate: int
    rate: int
    samples: int
    length: int
    mode: int
    bound: int
    crc: bool

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def side(self) -> int:
        """Bytes of side information in a Layer III frame."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple[float, int, int]:
        return self.version, self.layer, self.rate


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames, whose length is not told, count as none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(four[1] >> 1 & 3)
    index, which = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer is None or index in (0, 15) or which == 3:
        return None
    family = 1 if version == 1 else 2
    bitrate, rate, pad = BITRATES[family, layer][index] * 1000, RATES[version][which], four[2] >> 1 & 1
    samples = SAMPLES[family, layer]
    length = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    mode = four[3] >> 6
    # From this subband on, joint stereo has one allocation for both channels.
    bound = ((four[3] >> 4 & 3) + 1) * 4 if mode == 1 else 32
    return Header(version, layer, bitrate, rate, samples, length, mode, bound, not four[1] & 1)


def _crc_table() -> np.ndarray:
    table_ = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table_ = np.where(table_ & 0x8000, (table_ << 1) ^ 0x8005, table_ << 1) & 0xFFFF
    return table_.astype(np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frame checksum (polynomial 8005, start FFFF) of each row of a byte matrix."""
    out = np.full(len(rows), 0xFFFF, np.uint16)
    for i in range(rows.shape[1]):
        out = (out << 8) ^ _CRC[(out >> 8).astype(np.uint8) ^ rows[:, i]]
    return out


def _crc_of_bits(data: bytes, first: int, bits: int, crc: int = 0xFFFF) -> int:
    """The frame checksum over ``bits`` bits from bit ``first`` on."""
    for i in range(first, first + bits):
        one = data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ one) & 1 else 0)) & 0xFFFF
    return crc


def _allocation(h: Header) -> list[int]:
    """Layer II: the bits of each subband's allocation."""
    each = h.bitrate // 1000 // (1 if h.mono else 2)
    if h.version != 1:
        name = "low"
    elif each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, many in ALLOCATION[name] for _ in range(many)]


def protected(frame: bytes, h: Header) -> int:
    """How many bits behind the checksum of a Layer I or II frame it covers: allocations and, in Layer II, scale factor selections."""
    channels = 1 if h.mono else 2
    if h.layer == 1:
        shared = min(32, h.bound)
        return 4 * (channels * shared + 32 - shared)
    at, selections = 48, 0
    for band, bits in enumerate(_allocation(h)):
        separate = channels if band < h.bound else 1
        for _ in range(separate):
            if at + bits > 8 * len(frame):
                return 0
            value = int.from_bytes(frame[at >> 3 : (at >> 3) + 2].ljust(2, b"\0"), "big") >> (16 - (at & 7) - bits) & ((1 << bits) - 1)
            selections += 2 * (value > 0) * (channels // separate)
            at += bits
    return at - 48 + selections


def checksums_wrong(raw: np.ndarray, here: np.ndarray, h: Header) -> int:
    """How many of the frames of one header that begin at ``here`` have a wrong checksum."""
    told = raw[here + 4].astype(np.uint16) << 8 | raw[here + 5]
    if h.layer == 3:
        rows = raw[here[:, None] + np.r_[2:4, 6 : 6 + h.side][None, :]]
        return int((crc16(rows) != told).sum())
    wrong = 0
    for at, want in zip(here.tolist(), told.tolist()):
        frame = raw[at : at + h.length].tobytes()
        wrong += _crc_of_bits(frame, 48, min(protected(frame, h), 8 * len(frame) - 48), _crc_of_bits(frame, 16, 16)) != want
    return wrong


@dataclass
class Stream:
    """What a stream holds. ``at``: where each audio frame starts; ``samples``: the samples before it, each at its frame's rate."""

    at: np.ndarray
    length: np.ndarray
    samples: np.ndarray
    total: int = 0
    rate: int = 0
    duration: Fraction = Fraction(0)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, int] = field(default_factory=dict)
    toc: list[int] = field(default_factory=list)
    checked: int = 0
    wrong: int = 0
    skipped: int = 0

    def seek(self, sample: int) -> int:
        """The byte offset of the frame that holds a sample."""
        return int(self.at[max(0, int(np.searchsorted(self.samples, sample, "right")) - 1)]) if len(self.at) else 0


def _safe(four: bytes) -> int:
    """A number of 7 bits a byte."""
    out = 0
    for b in four:
        out = out << 7 | b & 127
    return out


def id3v2_size(data: bytes, at: int) -> int:
    """The bytes of an ID3v2 tag that begins at ``at``; 0 if there is none."""
    head = data[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or head[3] == 255 or max(head[6:10]) > 127:
        return 0
    return 10 + _safe(head[6:10]) + (10 if head[3] == 4 and head[5] & 16 else 0)


def id3v2(tag: bytes) -> dict[str, str]:
    """The frames of an ID3v2 tag: text as text, other contents in hexadecimal. What is cut short is left out."""
    major, flags = tag[3], tag[5]
    body = tag[10 : 10 + _safe(tag[6:10])]
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 64 and major >= 3 and len(body) >= 4:
        at = _safe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if major == 2 else (4, 10)
    out: dict[str, str] = {}
    while at + head <= len(body) and body[at : at + name].isalnum():
        told = body[at + name : at + 2 * name]
        size = _safe(told) if major == 4 else int.from_bytes(told, "big")
        content = body[at + head : at + head + size]
        if len(content) < size:
            break
        if major == 4 and body[at + 9] & 2:
            content = content.replace(b"\xff\x00", b"\xff")
        key = body[at : at + name].decode("ascii")
        if key[0] == "T" and content and content[0] < len(ENCODINGS):
            out[key] = content[1:].decode(ENCODINGS[content[0]], "replace").rstrip("\0")
        else:
            out[key] = content.hex()
        at += head + size
    return out


def id3v1(tag: bytes) -> dict[str, str]:
    """The fields of the 128 bytes of an ID3v1 tag; a comment with a zero before its last byte ends in a track number."""
    out, at = {}, 3
    for name, size in ID3V1:
        out[name] = tag[at : at + size].split(b"\0")[0].decode("latin-1").rstrip()
        at += size
    if tag[125] == 0 and tag[126]:
        out["track"] = str(tag[126])
    return out | {"genre": str(tag[127])}


def _vbr(frame: bytes, h: Header) -> tuple[dict[str, int], list[int]]:
    """The fields and seek table of a Xing, Info or VBRI frame; both empty if the frame is none."""
    at = 4 + 2 * h.crc + h.side
    kind = frame[at : at + 4]
    out: dict[str, int] = {}
    toc: list[int] = []
    if h.layer == 3 and kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8
        out[kind.decode()] = 1
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and len(frame) >= at + size:
                if name == "toc":
                    toc = list(frame[at : at + 100])
                else:
                    out[name] = struct.unpack(">I", frame[at : at + 4])[0]
                at += size
        if frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= at + 24:
            both = int.from_bytes(frame[at + 21 : at + 24], "big")
            out["delay"], out["padding"] = both >> 12, both & 4095
    elif h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        out["VBRI"] = 1
        out["delay"], out["quality"], out["bytes"], out["frames"], entries, scale, width, out["frames_an_entry"] = struct.unpack(">HHIIHHHH", frame[42:62])
        if 1 <= width <= 4 and len(frame) >= 62 + entries * width:
            toc = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(entries)]
    return out, toc


def parse(data: bytes) -> Stream:
    """Walk a stream. Junk is skipped to the next header that another one of its kind, a tag, or the end follows.

    Tags are looked for only where no frame that is in step covers them. Runs of frames with one header are
    stepped over together. An empty stream has no frames.
    """
    raw, n, at = np.frombuffer(data, np.uint8), len(data), 0
    out = Stream(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    starts: list[np.ndarray] = []
    kinds: list[tuple[Header, int]] = []
    last_tag = n - 128 if n >= 128 and data[n - 128 : n - 125] == b"TAG" else n
    synced, told = False, False
    while at < n:
        size = id3v2_size(data, at)
        if size:
            whole = data[at : at + size]
            out.tags |= {"id3v2": str(len(whole))} | id3v2(whole)
            at = min(n, at + size)
            continue
        if at == last_tag:
            out.tags |= {"id3v1": "128"} | id3v1(data[at:])
            at = n
            continue
        h = header(data[at : at + 4])
        after = at + h.length if h else 0
        if h and not synced and after < n and after != last_tag and not id3v2_size(data, after):
            other = header(data[after : after + 4])
            h = h if other and other.kind == h.kind else None
        if h is None or after > n:
            found = [p for p in (data.find(b"\xff", at + 1), data.find(b"ID3", at + 1), last_tag if last_tag > at else -1) if p >= 0]
            to = min([*found, n])
            out.skipped += to - at
            at, synced = to, False
            continue
        if not told:
            told = True
            out.vbr, out.toc = _vbr(data[at:after], h)
            if out.vbr:
                at, synced = after, True
                continue
        count, step, most = 1, 8, (n - at) // h.length
        while count < most:
            step = min(2 * step, 1 << 14, most - count)
            block = raw[at + count * h.length : at + (count + step) * h.length].reshape(step, h.length)[:, :4]
            differs = np.flatnonzero((block != raw[at : at + 4]).any(1))
            if len(differs):
                count += int(differs[0])
                break
            count += step
        here = at + np.arange(count, dtype=np.int64) * h.length
        if h.crc:
            out.checked += count
            out.wrong += checksums_wrong(raw, here, h)
        starts.append(here)
        kinds.append((h, count))
        at, synced = at + count * h.length, True
    if starts:
        out.at = np.concatenate(starts)
        out.length = np.concatenate([np.full(c, h.length, np.int64) for h, c in kinds])
        each = np.concatenate([np.full(c, h.samples, np.int64) for h, c in kinds])
        out.total, out.rate = int(each.sum()), kinds[0][0].rate
        out.samples = np.cumsum(each) - each
        out.duration = sum((Fraction(h.samples * c, h.rate) for h, c in kinds), Fraction(0))
        # What the encoder says it has put before and behind the sound is none of it.
        silent = out.vbr.get("delay", 0) + out.vbr.get("padding", 0)
        if "padding" in out.vbr and silent < out.total:
            out.duration -= Fraction(silent, out.rate)
    return out


#: The frames that hold a payload: MPEG 1 Layer III with checksum, 80 kbit/s, 48 kHz, one channel: 240 bytes.
HEAD = bytes((0xFF, 0xFA, 0x64, 0xC0))
FRAME = 240
UNIT = 192
BODY = 4 + 2 + 17


def write(payload: bytes) -> bytes:
    """A stream whose frames carry ``payload``, whose length is a positive multiple of 192, one unit a frame."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(units) + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEAD, np.uint8)
    crc = crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6:BODY]], axis=1))[0]
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    frames[1:, BODY : BODY + UNIT] = units
    size = frames.size
    toc = bytes((256 * (1 + i * len(units) // 100) // (len(units) + 1)) for i in range(100))
    frames[0, BODY : BODY + 116] = np.frombuffer(b"Xing" + struct.pack(">III", 7, len(units), size) + toc, np.uint8)
    title = b"TIT2" + struct.pack(">IH", 9, 0) + b"\x03payload\x00"
    tag = b"ID3\x04\x00\x00" + bytes((0, 0, len(title) >> 7, len(title) & 127)) + title
    return tag + frames.tobytes()


def read(media: bytes) -> tuple[bytes | None, Stream]:
    """The payload that ``write`` stored, through the stream's own frame table; None if a checksum is wrong or frames are not of its kind."""
    stream = parse(media)
    raw = np.frombuffer(media, np.uint8)
    if stream.wrong or stream.checked != len(stream.at) or (stream.length != FRAME).any():
        return None, stream
    return raw[stream.at[:, None] + np.arange(BODY, BODY + UNIT)[None, :]].tobytes(), stream


def store(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with the stream ``media`` that holds its padded bytes, and ``n_bytes``, how many were not padding.

    Null is empty, empty is one unit of spaces; rows that repeat are stored alike; columns of those two names are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, "n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                media, sizes = [], []
                for t in part.column(part.schema.get_field_index(text)).to_pylist():
                    raw = (t or "").encode()
                    sizes.append(len(raw))
                    media.append(write(raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))))
                own = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*(f.name for f in kept), "n_bytes", "media"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return df.mapInArrow(run, f"{fields}n_bytes long, media binary")


#: What ``index`` adds. Durations are exact fractions of a second; frame_offsets[i] is where the i-th audio frame starts.
_INDEX = {
    "sample_rate": pa.int64(),
    "n_samples": pa.int64(),
    "duration_numerator": pa.int64(),
    "duration_denominator": pa.int64(),
    "frame_offsets": pa.list_(pa.int64()),
    "frame_samples": pa.list_(pa.int64()),
    "tags": pa.map_(pa.string(), pa.string()),
    "vbr": pa.map_(pa.string(), pa.int64()),
    "toc": pa.list_(pa.int64()),
    "crc_checked": pa.int64(),
    "crc_wrong": pa.int64(),
    "skipped_bytes": pa.int64(),
    "payload": pa.binary(),
}
_INDEX_SCHEMA = (
    "sample_rate long, n_samples long, duration_numerator long, duration_denominator long, frame_offsets array<long>, frame_samples array<long>, "
    "tags map<string,string>, vbr map<string,long>, toc array<long>, crc_checked long, crc_wrong long, skipped_bytes long, payload binary"
)


def index(df: DataFrame, media: str = "media") -> DataFrame:
    """Read each stream of the binary column ``media``: adds rate, samples, duration, frame and seek tables, tags, checksums and payload.

    ``payload`` is null where a checksum is wrong or the stream is not one of ``write``; a null stream is an empty one.
    ``frame_samples`` has the samples before each frame. Columns of the added names are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in _INDEX]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, media):
                rows = []
                for m in part.column(part.schema.get_field_index(media)):
                    payload, s = read(m.as_py() or b"")
                    rows.append((s.rate, s.total, s.duration.numerator, s.duration.denominator, s.at, s.samples, list(s.tags.items()), list(s.vbr.items()), s.toc, s.checked, s.wrong, s.skipped, payload))
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_INDEX.values())]
                own = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*(f.name for f in kept), *_INDEX])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return df.mapInArrow(run, f"{fields}{_INDEX_SCHEMA}")


def op6_mpeg_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, stored as an MPEG audio stream and read back. Equal texts give equal values."""
    done = index(store(table(spark, sf_dir, "documents").select("doc_id", "text"), "text"))
    told = {
        "rate": "sample_rate",
        "frames": F.size("frame_offsets"),
        "samples": "n_samples",
        "seconds": F.concat_ws("/", "duration_numerator", "duration_denominator"),
        "checked": "crc_checked",
        "wrong": "crc_wrong",
        "vbr_frames": F.col("vbr")["frames"],
        "vbr_bytes": F.col("vbr")["bytes"],
        "toc": F.xxhash64("toc"),
        "skipped": "skipped_bytes",
        "seek": F.xxhash64("frame_offsets", "frame_samples"),
        "title": F.col("tags")["TIT2"],
    }
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{name}="), (F.col(c) if isinstance(c, str) else c).cast("string")) for name, c in told.items()))
    return done.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
