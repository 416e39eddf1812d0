import hashlib
import os
import random
import struct
import zlib

from keyloom.llm import mpeg_audio as m


def test_round_trip():
    rng = random.Random(1)
    for n in [0, 1, 64, 121, 122, 1416, 1417, 1418, 5000, 100_000]:
        data = rng.randbytes(n)
        s = m.read_stream(m.write_stream(data))
        assert s.payload == data and s.crc_bad == 0 and s.crc_good == s.frames == s.table_frames and s.resyncs == 0
        assert s.samples == 1152 * s.frames and s.table == "Xing"


def test_headers():
    assert m.header(bytes.fromhex("fffb9064")).length == 417
    assert m.header(bytes.fromhex("fffb9264")).length == 418
    h = m.header(bytes.fromhex("fff38464"))
    assert (h.layer, h.hz, h.kbps, h.samples, h.length) == (3, 24000, 64, 576, 192)
    assert m.header(bytes.fromhex("ffe00000")) is None and m.header(b"\xff") is None


def test_crc16_check_value():
    assert m.crc16(b"123456789") == 0xAEE7


def test_broken_frames_are_skipped():
    data = os.urandom(6000)
    media = bytearray(m.write_stream(data))
    whole = m.read_stream(bytes(media))
    media[whole.offsets[1]] = 0
    hurt = m.read_stream(bytes(media))
    assert hurt.resyncs == 1 and hurt.frames < whole.frames and hurt.payload is None
    media = bytearray(m.write_stream(data))
    media[whole.offsets[2] + 10] = 9
    assert m.read_stream(bytes(media)).crc_bad == 1
    assert m.read_stream(b"junk" + m.write_stream(b"x" * 3000)[40:] + b"TAG" + b"t" * 125).frames > 0


def test_payload_that_looks_like_a_tag():
    for n in range(40, 1700, 7):
        for mark, back in ((b"TAG", 128), (b"APETAGEX", 32)):
            data = bytearray(b"x" * n)
            at = max(0, n - back)
            data[at : at + len(mark)] = mark
            for shift in range(0, 24, 6):
                moved = bytes(data) + b"y" * shift
                assert m.read_stream(m.write_stream(moved)).payload == moved


def test_tags_behind_the_last_frame():
    media = m.write_stream(b"z" * 5000)
    ape = b"APETAGEX" + struct.pack("<III", 2000, 32, 0) + struct.pack("<I", 0) + bytes(8)
    v1 = b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    for tail, names in ((v1, {"ID3v1"}), (ape, {"APEv2"}), (ape + v1, {"APEv2", "ID3v1"})):
        s = m.read_stream(media + tail)
        assert s.payload == b"z" * 5000 and names <= set(s.tags) and s.resyncs == 0


def test_seek_tables_are_held_against_the_frames():
    media = bytearray(m.write_stream(os.urandom(300_000)))
    s = m.read_stream(bytes(media))
    assert len(s.points) == 100 and s.table_good and s.points == sorted(s.points)
    at = media.index(b"Xing") + 16
    media[at + 50] = 3
    assert m.read_stream(bytes(media)).table_good is False
    plain = m.write_stream(b"q" * 100_000)
    frames = plain[m.read_stream(plain).offsets[0] :]
    size = m._SIZE[14]
    head = m._head(14, False) + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, len(frames) + size, 70, 7, 1, 2, 10)
    entries = [10 * size + (size if i == 0 else 0) for i in range(7)]
    table = (head + b"".join(struct.pack(">H", e) for e in entries)).ljust(size, b"\0")
    s = m.read_stream(table + frames)
    assert s.table == "VBRI" and len(s.points) == 7 and s.table_good


def test_checksums_of_layers_one_and_two():
    """Frames with the checksum of a plain bitwise division over the bits that the standard names."""

    def plain(bits):
        c = 0xFFFF
        for b in bits:
            c = (c << 1) ^ (0x8005 if (c >> 15) ^ b else 0)
            c &= 0xFFFF
        return c

    def bits_of(data):
        return [b >> i & 1 for b in data for i in range(7, -1, -1)]

    # Layer I mono: 32 allocations of 4 bits. Layer II stereo, 192 kbit/s at 44.1 kHz: 94 - 6 allocation bits a channel, then 2 for each used subband.
    for raw, widths in (("fffe84c0", [4] * 32), ("fffca000", [w for n, w in ((11, 4), (12, 3), (7, 2)) for _ in range(2 * n)])):
        head = m.header(bytes.fromhex(raw))
        body = random.Random(3).randbytes(head.length - 6)
        got, at, used = bits_of(body), 0, 0
        for w in widths:
            used += any(got[at : at + w])
            at += w
        n = at + (2 * used if head.layer == 2 else 0)
        check = plain(bits_of(bytes.fromhex(raw)[2:]) + got[:n])
        frame = bytes.fromhex(raw) + check.to_bytes(2, "big") + body
        s = m.read_stream(frame * 3)
        assert (s.frames, s.crc_good, s.crc_bad) == (3, 3, 0)
        bad = bytearray(frame)
        bad[7] ^= 16
        assert m.read_stream(bytes(bad) * 3).crc_bad == 3


def test_no_stream():
    for raw in (b"", b"\xff" * 50, b"text", b"ID3\x04\x00\x00\x00\x00\x00\x7f"):
        assert m.read_stream(raw).frames == 0


def test_rows_of_every_kind(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "", 1), (None, "héllo", 2), (2, "y" * 200_000, 3)], "doc_id long, text string, media int")
    got = m.probe(m.store(df)).collect()
    assert [bytes(r.payload) for r in got] == [bytes(64), bytes(64), "héllo".encode() + bytes(58), b"y" * 200_000]
    assert all(len(r.offsets) == r.frames for r in got)
    assert m.store(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digests(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in m.query(spark, path).collect():
        raw = texts[r.doc_id].encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
