"""The decoder against standard JPEGs written here by the book: colour, subsampling, real quantisation, runs, any restart interval."""

import struct

import numpy as np
import pytest

from moraine.llm import media

LUMA_Q = np.clip(np.add.outer(np.arange(8), np.arange(8)) * 4 + 6, 1, 255)
CHROMA_Q = np.clip(np.add.outer(np.arange(8), np.arange(8)) * 7 + 9, 1, 255)


def codes_of(table):
    lengths, symbols = table
    out, code, k = {}, 0, 0
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[k]] = (code, size)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def seg(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, size):
        if size:
            self.bits += format(value, f"0{size}b")

    def number(self, v):
        size = int(abs(v)).bit_length()
        return size, (v if v > 0 else v + (1 << size) - 1) if size else 0

    def block(self, zz, last, dc, ac):
        size, bits = self.number(int(zz[0]) - last)
        self.put(*dc[size])
        self.put(bits, size)
        run = 0
        top = max([k for k in range(64) if zz[k]], default=0)
        for k in range(1, top + 1):
            if not zz[k]:
                run += 1
                continue
            while run > 15:
                self.put(*ac[0xF0])
                run -= 16
            size, bits = self.number(int(zz[k]))
            self.put(*ac[run << 4 | size])
            self.put(bits, size)
            run = 0
        if top < 63:
            self.put(*ac[0x00])
        return int(zz[0])

    def flush(self):
        text = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def transform(samples, q):
    """Quantised coefficients (rows x cols x 64 in zigzag order) of samples padded to whole blocks."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    r, c = samples.shape[0] // 8, samples.shape[1] // 8
    b = samples.reshape(r, 8, c, 8).transpose(0, 2, 1, 3) - 128.0
    return np.rint((a @ b @ a.T) / q).astype(int).reshape(r, c, 64)[:, :, media.ZIGZAG]


def untransform(zz, q):
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    b = np.zeros(zz.shape)
    b[:, :, media.ZIGZAG] = zz
    p = np.clip(np.rint(a.T @ (b.reshape(*zz.shape[:2], 8, 8) * q) @ a) + 128, 0, 255)
    return p.transpose(0, 2, 1, 3).reshape(zz.shape[0] * 8, zz.shape[1] * 8)


def jpeg(planes, high, wide, sampling, restart=0, with_tables=True, interleaved=True):
    """planes: samples of each component, padded to whole MCUs; returns (file, expected coefficients by component)."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    quants = [LUMA_Q] + [CHROMA_Q] * (len(planes) - 1)
    zz = [transform(p, q) for p, q in zip(planes, quants)]
    tables = {0x00: media.standard_table(0, 0), 0x10: media.standard_table(1, 0), 0x01: media.standard_table(0, 1), 0x11: media.standard_table(1, 1)}
    codes = {k: codes_of(t) for k, t in tables.items()}
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, b"\0" + bytes(LUMA_Q.reshape(-1)[media.ZIGZAG].tolist())) + seg(0xDB, b"\1" + bytes(CHROMA_Q.reshape(-1)[media.ZIGZAG].tolist()))
    out += seg(0xC0, struct.pack(">BHHB", 8, high, wide, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, min(k, 1)]) for k, (h, v) in enumerate(sampling)))
    if with_tables:
        out += b"".join(seg(0xC4, bytes([k]) + t[0] + t[1]) for k, t in tables.items())
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    every = list(range(len(planes)))
    for scan in [every] if interleaved else [[k] for k in every]:
        out += seg(0xDA, bytes([len(scan)]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in scan) + bytes([0, 63, 0]))
        if len(scan) == 1:
            k = scan[0]
            rows, cols = -(-(-(-high * sampling[k][1] // vm)) // 8), -(-(-(-wide * sampling[k][0] // hm)) // 8)
            units = [[(k, r, c)] for r in range(rows) for c in range(cols)]
        else:
            units = [[(k, my * v + y, mx * h + x) for k, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)] for my in range(-(-high // (8 * vm))) for mx in range(-(-wide // (8 * hm)))]
        per, w = restart or len(units), Writer()
        for at in range(0, len(units), per):
            if at:
                out += bytes([0xFF, 0xD0 + (at // per - 1) % 8])
            last = dict.fromkeys(scan, 0)
            for k, r, c in (u for unit in units[at : at + per] for u in unit):
                last[k] = w.block(zz[k][r, c], last[k], codes[min(k, 1)], codes[0x10 | min(k, 1)])
            out += w.flush()
    return out + b"\xff\xd9", zz


def smooth(rng, high, wide):
    y, x = np.mgrid[0:high, 0:wide]
    return np.clip(128 + 60 * np.sin(x / 5 + rng.random()) + 50 * np.cos(y / 7) + rng.normal(0, 6, (high, wide)), 0, 255)


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 4])
@pytest.mark.parametrize("restart, with_tables, interleaved", [(0, True, True), (3, True, True), (1, False, True), (2, False, False)])
def test_standard_jpeg(sampling, restart, with_tables, interleaved):
    rng = np.random.default_rng(5)
    high, wide = 21, 35
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    rows, cols = -(-high // (8 * vm)), -(-wide // (8 * hm))
    planes = [smooth(rng, rows * v * 8, cols * h * 8) for h, v in sampling]
    data, zz = jpeg(planes, high, wide, sampling, restart, with_tables, interleaved)
    f = media.parse(data)
    for k, (c, want) in enumerate(zip(f.components, zz)):
        r, w = (want.shape[:2] if interleaved and len(sampling) > 1 else f.blocks_of(c)[:2])
        assert np.array_equal(c.coefficients[:r, :w], want[:r, :w])
    got = media.decode_picture(data)
    full = [np.kron(untransform(z, LUMA_Q if not k else CHROMA_Q), np.ones((vm // v, hm // h)))[:high, :wide] for k, (z, (h, v)) in enumerate(zip(zz, sampling))]
    if len(full) == 3:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        full = [np.clip(np.rint(v), 0, 255) for v in (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)]
    want = np.stack(full, axis=2) if len(full) > 1 else full[0]
    assert got.shape == want.shape and np.array_equal(got, want)


def avi_of(jpegs, fps=25):
    """An AVI file of frames by another writer: no INFO, odd sizes padded, offsets in idx1 from the movi list."""
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(jpegs), 0, 1, 0, 35, 21, 0, 0, 0, 0)
    movi, index = b"movi", b""
    for j in jpegs:
        index += struct.pack("<4sIII", b"00dc", 0x10, len(movi), len(j))
        movi += chunk(b"00dc", j)
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih)) + chunk(b"JUNK", b"123") + chunk(b"LIST", movi) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_clips_of_a_foreign_file(spark):
    rng = np.random.default_rng(1)
    scenes = [np.full((24, 40), 30.0), np.full((24, 40), 220.0), smooth(rng, 24, 40)]
    shot = lambda p: jpeg([np.clip(p + rng.normal(0, 1, p.shape), 0, 255)], 21, 35, [(1, 1)])[0]
    jpegs = [shot(scenes[0]) for _ in range(5)] + [shot(scenes[1]) for _ in range(6)] + [b""] + [shot(scenes[2]) for _ in range(4)]
    avi = avi_of(jpegs)
    assert media.cut(avi) == [(0, 5, 40_000), (5, 12, 40_000), (12, 16, 40_000)]
    rows = media.clips(spark.createDataFrame([(1, bytearray(avi)), (2, None)], "id long, media binary")).collect()
    assert [(r.id, r.clip, r.start_ms, r.end_ms, r.n_frames) for r in rows] == [(1, 0, 0, 200, 5), (1, 1, 200, 480, 7), (1, 2, 480, 640, 4)]


def test_histograms_are_of_pictures():
    """The fast way for encode's own layout gives what the whole decoder gives."""
    data = np.random.default_rng(3).integers(0, 256, 64 * 64 * 3 + 640, np.uint8).tobytes()
    _, _, jpegs = media.frames(media.encode(data))
    hist, coefficients = media.histograms(jpegs)
    for h, c, j in zip(hist, coefficients, jpegs):
        f = media.parse(j)
        assert f.fast and np.allclose(h, media.histogram(f)) and np.allclose(h, np.bincount(media.decode_picture(j).reshape(-1) >> 4, minlength=16) / (64 * len(c)))
        slow = media.parse(j)
        slow.components[0].coefficients[:] = 0
        media._scan(slow, slow.components, j[j.index(b"\xff\xda") + 10 : -2])
        assert np.array_equal(slow.components[0].coefficients.reshape(-1, 64), c)


def test_what_is_not_read():
    data, _ = jpeg([np.full((24, 40), 90.0)], 21, 35, [(1, 1)])
    with pytest.raises(ValueError, match="baseline"):
        media.parse(data.replace(b"\xff\xc0", b"\xff\xc2"))
    with pytest.raises(ValueError):
        media.parse(data[: data.index(b"\xff\xda") + 12])
    with pytest.raises(ValueError, match="JPEG"):
        media.parse(b"GIF89a")


def test_clips_of_stored_texts(spark):
    d = spark.createDataFrame([(1, "a" * 20_000 + "Z9" * 10_000), (2, None), (3, ""), (1, "again")], "doc_id long, text string")
    rows = media.clips(media.store(d)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {1, 2, 3} and all(r.end_ms - r.start_ms == 40 * r.n_frames for r in rows)
    assert media.clips(media.store(d.limit(0))).count() == 0
