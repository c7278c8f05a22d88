import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from nearvote.llm.tiff import ADOBE_DEFLATE, DEFLATE, LZW, NONE, PACKBITS, Layout, TiffError, difference, lzw_decode, lzw_encode, media_digest, pack_bits, read_pages, store_text, tiff_pages, undo_difference, unpack_bits, write_pages


def samples():
    rng = random.Random(1)
    yield b""
    yield b"a"
    yield b"aaaa" * 500
    yield bytes(range(256)) * 40
    yield bytes(rng.randrange(256) for _ in range(30_000))  # fills the code table several times
    yield b" ".join(rng.choice([b"the", b"of", b"and", b"a"]) for _ in range(20_000))
    for n in (2, 3, 127, 128, 129, 130, 257, 300):
        yield b"x" * n
        yield b"ab" + b"x" * n + b"cd"


def test_codecs_round_trip():
    for raw in samples():
        assert unpack_bits(pack_bits(raw)) == raw
        assert lzw_decode(lzw_encode(raw)) == raw


def test_published_vectors():
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert unpack_bits(packed) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    # 7 7 7 8 8 7 7 6 6 is coded as clear, 7, 258, 8, 8, 258, 6, 6, end (9 bits each).
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


def test_predictor():
    block = np.random.default_rng(0).integers(0, 256, (5, 9, 3)).astype(np.uint8)
    assert (undo_difference(difference(block)) == block).all()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("scheme", [NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS])
def test_pages(order, scheme):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 4, (h, w)).astype(np.uint8) for h, w in ((1, 1), (70, 50), (33, 64))]
    layouts = [Layout(scheme, 1, 0, 16), Layout(scheme, 2, 16, 32), Layout(scheme, 2, 0, 64)]
    pages = list(read_pages(write_pages(list(zip(images, layouts)), order)))
    assert [(p.height, p.width, p.tiled, p.predictor) for p in pages] == [(1, 1, False, 1), (70, 50, True, 2), (33, 64, False, 2)]
    assert [p.pixels for p in pages] == [i.tobytes() for i in images]


def test_sixteen_bits_and_colours():
    values = (np.arange(2 * 3 * 2).reshape(2, 3, 2) * 1000).astype(">u2")
    body = difference(values).astype(">u2").tobytes()
    entries = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 2), (278, 3, 2), (279, 4, len(body)), (317, 3, 2)]
    fields = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in entries)
    data = b"MM" + struct.pack(">HI", 42, 8 + len(body)) + body + struct.pack(">H", len(entries)) + fields + struct.pack(">I", 0)
    (page,) = read_pages(data)
    assert (page.bits, page.samples) == (16, 2) and page.pixels == values.tobytes()


def tiff(strips, *fields):
    """A little-endian TIFF of one page with these strips and (tag, value or values) fields."""
    out, offsets = bytearray(b"II" + struct.pack("<HI", 42, 0)), []
    for strip in strips:
        offsets.append(len(out))
        out += strip
    entries = sorted([*fields, (273, offsets), (279, [len(s) for s in strips])])
    table = bytearray()
    for tag, value in entries:
        values = value if isinstance(value, list) else [value]
        body = struct.pack(f"<{len(values)}I", *values)
        if len(values) > 1:
            place = struct.pack("<I", len(out))
            out += body
            body = place
        table += struct.pack("<HHI", tag, 4, len(values)) + body
    struct.pack_into("<I", out, 4, len(out))
    return bytes(out + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0))


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("fill", [1, 2])
def test_small_samples(bits, fill):
    values = np.random.default_rng(bits).integers(0, 1 << bits, (5, 13)).astype(np.uint8)
    rows = np.unpackbits(values[:, :, None], axis=2)[:, :, 8 - bits :].reshape(5, -1)
    packed = np.packbits(rows, axis=1).tobytes()
    if fill == 2:
        packed = bytes(int(f"{b:08b}"[::-1], 2) for b in packed)
    (page,) = read_pages(tiff([packed], (256, 13), (257, 5), (258, bits), (266, fill)))
    assert page.bits == bits and page.pixels == values.tobytes()


def test_planes_apart():
    values = np.random.default_rng(3).integers(0, 256, (6, 7, 3)).astype(np.uint8)
    strips = [zlib.compress(values[y : y + 4, :, s].tobytes()) for s in range(3) for y in (0, 4)]
    (page,) = read_pages(tiff(strips, (256, 7), (257, 6), (258, [8, 8, 8]), (259, ADOBE_DEFLATE), (277, 3), (278, 4), (284, 2)))
    assert page.pixels == values.tobytes()


@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_four_byte_samples(predictor):
    values = np.random.default_rng(4).normal(size=(4, 5, 2)).astype("<f4").view("<u4")
    body = values
    if predictor == 2:
        body = difference(values)
    if predictor == 3:  # byte planes, highest first, each byte less the one of the pixel before
        planes = values.astype(">u4").view(np.uint8).reshape(4, 10, 4).transpose(0, 2, 1).reshape(4, 20, 2)
        body = difference(np.ascontiguousarray(planes))
    (page,) = read_pages(tiff([body.tobytes()], (256, 5), (257, 4), (258, [32, 32]), (277, 2), (317, predictor)))
    assert page.bits == 32 and page.pixels == values.tobytes()


def test_any_damage_is_a_tiff_error():
    rng = random.Random(9)
    image = np.arange(40 * 64, dtype=np.uint8).reshape(40, 64)
    for layout in (Layout(LZW, 2, 0, 16), Layout(PACKBITS, 1, 16, 16), Layout(ADOBE_DEFLATE, 1, 0, 64)):
        good = write_pages([(image, layout), (image, layout)])
        for _ in range(1500):
            bad = bytearray(good)
            for _ in range(rng.randrange(1, 4)):
                bad[rng.randrange(len(bad))] = rng.choice([0, 1, 255, rng.randrange(256)])
            try:
                list(read_pages(bytes(bad)))
            except TiffError:
                pass


def test_claims_are_checked_before_memory_is_taken():
    for fields in (((256, 2**32 - 1), (257, 2**31)), ((256, 10**5), (257, 1000)), ((256, 0), (257, 5)), ((256, 5), (257, 5), (277, 0)), ((256, 5), (257, 5), (258, [8, 16])), ((256, 5), (257, 5), (278, 1))):
        given = [f for f in ((258, 8), (277, 1)) if f[0] not in dict(fields)]
        with pytest.raises(TiffError):
            list(read_pages(tiff([b"x" * 25], *fields, *given)))
    bomb = zlib.compress(bytes(10**8))
    (page,) = read_pages(tiff([bomb], (256, 5), (257, 5), (258, 8), (259, ADOBE_DEFLATE)))
    assert page.pixels == bytes(25)


def test_feature_is_the_plain_computation(docs):
    texts = ["", "abc" * 500, "z\u00e9" * 150_000]
    got = {r["doc_id"]: r for r in media_digest(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        parts = got[i]["feature"].split(";")
        assert len(parts) == -(-len(payload) // (64 * 4096))
        for n, part in enumerate(parts):
            own = payload[n * 64 * 4096 : (n + 1) * 64 * 4096]
            shape, _, total, bars = part.split(":")
            assert shape == f"64x{len(own) // 64}" and int(total) == sum(own)
            assert [int(b) for b in bars.split(",")] == [sum(v >> 4 == x for v in own) for x in range(16)]


def test_faults_are_errors():
    good = store_text(b"hello")
    loop = bytearray(good)
    (first,) = struct.unpack_from("<I", loop, 4)
    (n,) = struct.unpack_from("<H", loop, first)
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    for bad in (b"", b"II*", b"PNG", good[:20], good[:-10], bytes(loop)):
        with pytest.raises(TiffError):
            list(read_pages(bad))


def test_one_row_per_page(spark):
    image = np.zeros((3, 4), np.uint8)
    two = write_pages([(image, Layout()), (image + 7, Layout(LZW))])
    df = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"junk"))], "media_id long, data binary")
    rows = tiff_pages(df, "media_id", "data").orderBy("id", "page").collect()
    assert [(r["id"], r["page"], r["error"] is None) for r in rows] == [(1, 0, True), (1, 1, True), (2, None, False), (3, None, False)]
    assert rows[1]["pixels"] == bytes([7]) * 12
    assert tiff_pages(df.limit(0), "media_id", "data").count() == 0


def test_texts_come_back_whole(docs, odd_texts):
    rows = odd_texts + [(100 + i, "y" * i) for i in (63, 64, 65, 127, 128)]
    got = {r["doc_id"]: r for r in media_digest(docs(rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = store_text(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert got[10]["feature"] == got[11]["feature"] != got[12]["feature"]
    assert media_digest(docs([])).count() == 0


def test_pages_that_share_a_strip_are_bounded(spark):
    """Many directories over one strip: pages come one by one until they exceed what a file can hold."""
    body = zlib.compress(bytes(4096 * 4096), 9)
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    strip = 8 + 40 * (2 + 9 * 12 + 4)
    for i in range(40):
        entries = [(256, 4, 4096), (257, 4, 4096), (258, 3, 8), (259, 3, DEFLATE), (262, 3, 1), (273, 4, strip), (277, 3, 1), (278, 4, 4096), (279, 4, len(body))]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries)
        out += struct.pack("<I", len(out) + 4 if i < 39 else 0)
    bomb = bytes(out) + body
    media = spark.createDataFrame([(1, bytearray(bomb)), (2, bytearray(store_text(b"after")))], "key long, data binary")
    pages = tiff_pages(media, "key", "data").select("id", "page", "error").collect()
    own = [r for r in pages if r["id"] == 1]
    assert 1 <= sum(r["error"] is None for r in own) <= 2048 * len(bomb) // 4096**2
    assert [r["error"] for r in own if r["error"]] == ["pages share their data: more pixels than the file can hold"]
    assert [r["error"] for r in pages if r["id"] == 2] == [None]


def test_feature_names_shape_scheme_and_pixels(spark, docs):
    texts = [(1, "abc" * 1000), (2, ""), (3, None), (4, "é" * 150_000)]
    got = {r["doc_id"]: r["feature"] for r in media_digest(docs(texts)).collect()}
    for key, text in texts:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        parts = got[key].split(";")
        assert len(parts) == -(-len(payload) // (64 * 4096))
        for i, part in enumerate(parts):
            pixels = payload[i * 64 * 4096 : (i + 1) * 64 * 4096]
            shape, scheme, total, bars = part.split(":")
            assert shape == f"64x{len(pixels) // 64}" and int(total) == sum(pixels)
            assert scheme.split("/")[0] in {str(x) for x in (ADOBE_DEFLATE, PACKBITS, LZW)} and scheme[-1] in "ts"
            assert bars == ",".join(str(sum(x >> 4 == n for x in pixels)) for n in range(16))
