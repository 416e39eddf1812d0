"""Media columns: MPEG-1 layer III streams that carry bytes, their reader and its seek table.

The writer puts a payload into the ancillary data of silent layer III frames: after the header, CRC-16 and an all-zero
side information (which says that no audio data follows) the rest of a frame belongs to the application. An ID3v2 tag
holds the payload's length and CRC-32, and a Xing frame the frame count, the stream's bytes and a table of 100 seek
points; the bit rate varies, so the last frame is as short as it can be.

The reader skips an ID3v2 tag, finds the first frame header that another one follows, walks from header to header, looks
for the next one when a header is broken, verifies each protected frame's CRC-16 (of all three layers), and gives exact
durations in samples and the offset of every frame. APEv2 and ID3v1 tags are looked for only where frames have ended, so
bytes within a frame are never taken for a tag. The seek points of Xing and VBRI tables are read and held against the
offsets of the frames.

Defined results: null and empty payloads make a stream without audio frames; bytes that hold no MPEG frame have 0
frames and no payload; free-format frames are not read. Any bytes may be stored, sync words among them.
"""

from __future__ import annotations

import hashlib
import itertools
import struct as st
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, struct, text_udf, with_fields

# Fixed values of the MPEG-1 and MPEG-2 audio standards, by (version 1?, layer): kbit/s by index 1 to 14.
RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Samples a second by version bits (3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5).
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# What the writer makes: MPEG-1 layer III, mono, 32 kHz, where a frame of r kbit/s has just 4.5 r bytes.
WRITE_HZ, FRAME_SAMPLES, SIDE = 32000, 1152, 17
HEAD = 4 + 2 + SIDE
#: Bytes of texts or streams that one call of a kernel takes.
HELD = 1 << 20


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum over the data, or its first bits: polynomial 0x8005, start 0xFFFF, no reflection."""
    c, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for b in data[:whole]:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    for i in range(0 if bits is None else bits % 8):
        top = (c >> 15) ^ (data[whole] >> (7 - i) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    hz: int
    mono: bool
    samples: int
    length: int
    side: int
    bound: int


def header(raw: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none or of free format."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first = version == 3
    kbps, hz, pad, mono = RATES[first, layer][rate - 1], HZ[version][hz], raw[2] >> 1 & 1, raw[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples * 125 * kbps // hz + pad
    side = 0 if layer != 3 else ((17 if mono else 32) if first else (9 if mono else 17))
    bound = 4 * (raw[3] >> 4 & 3) + 4 if raw[3] >> 6 == 1 else 32
    return Header(version, layer, not raw[1] & 1, kbps, hz, mono, samples, length, side, bound)


# Fixed values of the standards: bits of a layer II allocation as (subbands, bits), by the table that rate and frequency choose.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(head: Header) -> list[int]:
    """Bits of a subband's allocation, for each subband of a layer I or II frame."""
    if head.layer == 1:
        return [4] * 32
    each = head.kbps if head.mono else head.kbps // 2
    if head.version != 3:
        table = "low"
    elif each <= 48:
        table = "d" if head.hz == 32000 else "c"
    else:
        table = "a" if each <= 80 or head.hz == 48000 else "b"
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def protected_bits(head: Header, body: bytes) -> int:
    """How many bits of a frame behind its checksum the checksum covers."""
    if head.layer == 3:
        return 8 * head.side
    bits, channels = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 1 if head.mono else 2
    at = chosen = 0
    for band, width in enumerate(_allocation(head)):
        shared = channels == 2 and band >= head.bound
        for _ in range(1 if shared else channels):
            if bits >> (512 - at - width) & (1 << width) - 1:
                chosen += 2 if shared else 1
            at += width
    return at + (2 * chosen if head.layer == 2 else 0)


def _frames(capacity_needed: int) -> list[int]:
    """Bit-rate indexes of frames that hold so many bytes: largest frames, then the smallest that holds the rest."""
    sizes = [9 * r // 2 - HEAD for r in RATES[True, 3]]
    full, rest = divmod(capacity_needed, sizes[-1])
    return [14] * full + ([next(i + 1 for i, s in enumerate(sizes) if s >= rest)] if rest else [])


def _head(index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA | (not protected), index << 4 | 2 << 2, 0xC0))


_START = {i: (h := _head(i, True)) + st.pack(">H", crc16(h[2:] + bytes(SIDE))) + bytes(SIDE) for i in range(1, 15)}
_SIZE = {i: 9 * r // 2 for i, r in enumerate(RATES[True, 3], 1)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """An MPEG audio stream that carries the payload."""
    text = b"\x00payload\x00%d:%08x" % (len(payload), zlib.crc32(payload))
    tag = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag
    rates = _frames(len(payload))
    parts, at = [], 0
    for index in rates:
        room = _SIZE[index] - HEAD
        chunk = payload[at : at + room]
        parts += (_START[index], chunk) if len(chunk) == room else (_START[index], chunk, bytes(room - len(chunk)))
        at += room
    body = b"".join(parts)
    info = _SIZE[1]
    total, n = info + len(body), len(rates)
    points = bytes(min(255, 256 * (info + min(len(body), (i * n // 100) * _SIZE[14])) // total) for i in range(100))
    xing = _head(1, False) + bytes(SIDE) + b"Xing" + st.pack(">III", 15, n, total) + points + st.pack(">I", 0)
    return tag + xing + bytes(info - len(xing)) + body


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    hz: int = 0
    offsets: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    points: list[int] = field(default_factory=list)
    table_good: bool | None = None
    points_step: int = 0
    kbps: set[int] = field(default_factory=set)
    payload: bytes | None = None

    @property
    def seconds(self) -> float:
        return self.samples / self.hz if self.hz else 0.0


def _id3(data: bytes, tags: dict[str, str]) -> int:
    """Read an ID3v2 tag's text frames; the place behind the tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, end = data[3], min(len(data), 10 + safe(data[6:10]))
    at = 10
    while major >= 3 and at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode()
        size = safe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        value = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and value:
            text = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(value[0], 3)], "replace").rstrip("\0")
            key, _, rest = text.partition("\0")
            tags[key if name == "TXXX" else name] = rest if name == "TXXX" else text
        at += 10 + size
    return end + (10 if data[5] & 16 else 0)


def _vbr(frame: bytes, head: Header, out: Stream) -> bool:
    """Read a Xing, Info or VBRI table, its seek points as bytes from the table's frame on; whether the frame is one."""
    for at in {4 + head.side, 4 + head.side + 2, 36}:
        if (name := frame[at : at + 4]) in (b"Xing", b"Info"):
            flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            if flags & 1:
                out.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 2:
                out.table_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4 and len(frame) >= at + 100:
                out.points = [p * max(out.table_bytes, 0) // 256 for p in frame[at : at + 100]]
            out.table = name.decode()
            return True
        if name == b"VBRI" and len(frame) >= at + 26:
            out.table_bytes, out.table_frames, n, scale, width, out.points_step = st.unpack(">IIHHHH", frame[at + 10 : at + 26])
            steps = [frame[at + 26 + i * width : at + 26 + (i + 1) * width] for i in range(n)]
            out.points = list(itertools.accumulate(int.from_bytes(s, "big") * scale for s in steps if len(s) == width))
            out.table = "VBRI"
            return True
    return False


def _points_good(out: Stream, start: int, end: int) -> bool | None:
    """Whether each seek point lies about where its frame is: within the grain of the table and two frames."""
    if not out.points or not out.offsets:
        return None
    longest = max((b - a for a, b in zip(out.offsets, [*out.offsets[1:], end], strict=True)), default=0)
    if out.table == "VBRI":
        # Point i lies behind i + 1 times as many frames as an entry spans, the table's own frame not counted.
        places, grain = [(i + 1) * out.points_step for i in range(len(out.points))], 0
    else:
        places, grain = [i * out.frames // 100 for i in range(100)], out.table_bytes // 256 + 1
    true = [out.offsets[n] if n < out.frames else end for n in places]
    return all(abs(start + p - t) <= grain + 2 * longest for p, t in zip(out.points, true, strict=True))


def _tail(data: bytes, at: int, tags: dict[str, str]) -> bool:
    """Whether all that follows are an APEv2 tag, an ID3v1 tag or both, which are read."""
    end, found = len(data), {}
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        found["ID3v1"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, _, flags = st.unpack("<III", data[end - 20 : end - 8])
        found["APEv2"] = str(size)
        end -= size + (32 if flags >> 31 else 0)
    if end != at or not found:
        return False
    tags.update(found)
    return True


def read_stream(data: bytes) -> Stream:
    """Walk a stream's frames; with the payload if the writer made it and all of it is sound."""
    out = Stream()
    at, end = _id3(data, out.tags), len(data)
    heads: dict[bytes, Header | None] = {}
    sums: dict[bytes, int] = {}
    parts, first, synced, start = [], True, False, 0
    while at + 4 <= end:
        raw = data[at : at + 4]
        if raw not in heads:
            heads[raw] = header(raw)
        head = heads[raw]
        stop = at + head.length if head else 0
        if not head or stop > end or not (synced or stop == end or header(data[stop : stop + 4]) or _tail(data, stop, {})):
            if _tail(data, at, out.tags):
                end = at
                break
            if synced:
                out.resyncs += 1
                synced = False
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        synced = True
        if first and _vbr(data[at:stop], head, out):
            first, start, at = False, at, stop
            continue
        first = False
        begin = at + 4
        if head.protected:
            begin += 2
            bits = 16 + protected_bits(head, data[begin:stop])
            covered = data[at + 2 : at + 4] + data[begin : begin + (bits + 7) // 8 - 2]
            if covered not in sums:
                sums[covered] = crc16(covered, min(bits, 8 * len(covered)))
            if sums[covered] == data[at + 4] << 8 | data[at + 5]:
                out.crc_good += 1
            else:
                out.crc_bad += 1
        out.offsets.append(at)
        out.frames += 1
        out.samples += head.samples
        out.hz = out.hz or head.hz
        out.kbps.add(head.kbps)
        parts.append(data[begin + head.side : stop])
        at = stop
    out.table_good = _points_good(out, start, end)
    if "payload" in out.tags:
        size, _, check = out.tags["payload"].partition(":")
        joined = b"".join(parts)[: int(size)]
        if len(joined) == int(size) and f"{zlib.crc32(joined):08x}" == check:
            out.payload = joined
    return out


def store(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and media: the UTF-8 text, zero bytes up to a positive multiple of 64 added, as an MPEG stream."""

    def make():
        return lambda texts: [[write_stream(pad(t)) for t in texts]]

    return with_fields(docs, list(keep), text_udf(make, struct(media=T.BinaryType()), HELD)(F.col(text_col)))


def pad(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(-len(text) % unit or (0 if text else unit))


MEDIA = struct(
    frames=T.LongType(), samples=T.LongType(), hz=T.IntegerType(), seconds=T.DoubleType(), offsets=T.ArrayType(T.LongType()), crc_good=T.LongType(),
    crc_bad=T.LongType(), resyncs=T.LongType(), table=T.StringType(), table_frames=T.LongType(), table_bytes=T.LongType(), points=T.ArrayType(T.LongType()),
    table_good=T.BooleanType(), payload=T.BinaryType(),
)


def probe(media: DataFrame, *, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and what the reader finds in each stream (MEDIA)."""

    def make():
        def kernel(streams: list[bytes]) -> list:
            found = [read_stream(s) for s in streams]
            return [[getattr(s, name) for s in found] for name in MEDIA.names]

        return kernel

    return with_fields(media, list(keep), text_udf(make, MEDIA, HELD)(F.col(media_col)))


def feature(stream: Stream) -> str:
    """Duration, frames, rates, checksums and seek points of a stream as one line."""
    seek = hashlib.sha256(st.pack(f"<{len(stream.offsets)}Q", *stream.offsets)).hexdigest()[:16]
    return (
        f"samples={stream.samples};hz={stream.hz};frames={stream.frames};kbps={'/'.join(map(str, sorted(stream.kbps)))};"
        f"crc={stream.crc_good}+{stream.crc_bad};resyncs={stream.resyncs};{stream.table or 'none'}={stream.table_frames},{stream.table_bytes};seek={seek}"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = store(documents(spark, sf_dir), keep=("doc_id", "text"))
    digest = struct(
        payload_bytes=T.LongType(), payload_sha256=T.StringType(), tail_crc32=T.LongType(), media_bytes=T.LongType(), media_sha256=T.StringType(), feature=T.StringType()
    )

    def make():
        def kernel(stored: list[bytes]) -> list:
            rows = []
            for media in stored:
                stream = read_stream(media)
                back = stream.payload
                if back is None:
                    raise ValueError("a stored stream does not give its payload back")
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in digest]

        return kernel

    sized = streams.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    return with_fields(sized, ["doc_id", "n_bytes"], text_udf(make, digest, HELD)(F.col("media")))
