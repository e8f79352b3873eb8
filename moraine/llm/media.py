"""Media columns: motion-JPEG in AVI.

``frames`` parses the RIFF chunks and the idx1 index; ``decode_picture`` decodes
an intra frame: any baseline JPEG (Huffman tables of the stream or, where it has
none as in many AVI files, the standard's; one to four components of any
sampling; any restart interval or none; one scan or several).  ``shots`` finds
cuts where the histogram difference of neighbouring decoded pictures leaves its
running mean, and ``clips`` gives timed clip rows.

``encode`` stores bytes losslessly as quantised coefficients of baseline JPEG
frames: one component, all-one quantisation table, restart after each block.
Every byte b is a coefficient of size class 8 (-255 to -128 for 0 to 127, 128 to
255 for 128 to 255), so each has the one-bit code of the only symbol in its table
and 8 value bits: a block has 72 bytes before stuffing, and its 64 codes can be
packed and read by arrays.  Frames of that layout are decoded by arrays, others
symbol by symbol, to the same coefficients.

Defined results: a null text is empty and stored as 64 zero bytes; equal bytes
give equal media; texts of any length work, a frame at a time; a null media
value gives no clips, and what isn't an AVI file or a baseline JPEG is an error; a
frame of no bytes repeats the last picture; an empty table gives an empty result;
columns other than the id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BLOCK = 64
#: Blocks of a full frame: 8 rows of 64 columns wide.
FRAME_BLOCKS = 64
FPS = 25
#: Zigzag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))), np.int64)
#: A cut: the difference is over the mean of the last SPAN by K deviations, and over LEAST.
SPAN, K, LEAST = 8, 3.0, 0.25
BINS = 16
#: Frames that are transformed at once.
TOGETHER = 64


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables(n_blocks: int) -> bytes:
    """All of a frame's JPEG before its entropy-coded data; n_blocks blocks in a row."""
    dqt = _segment(0xDB, b"\0" + b"\1" * 64)
    sof = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * n_blocks, 1, 1, 0x11, 0))
    one_code = bytes([1] + [0] * 15)  # a single symbol, of one bit
    dht = _segment(0xC4, b"\x00" + one_code + b"\x08") + _segment(0xC4, b"\x10" + one_code + b"\x08")
    dri = _segment(0xDD, struct.pack(">H", 1))
    sos = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + dqt + sof + dht + dri + sos


def encode_frame(data: np.ndarray) -> bytes:
    """A JPEG of len(data) / 64 blocks; data: bytes, a multiple of 64."""
    n = len(data) // BLOCK
    # class 8 value bits: a coefficient v > 0 has v itself (128..255), v < 0 has v + 255 (0..127): the byte
    bits = np.zeros((n, BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data.reshape(n, BLOCK, 1), axis=2)
    scan = np.packbits(bits.reshape(n, BLOCK * 9), axis=1)  # 72 bytes a block
    stuffed = scan == 0xFF
    # each byte, then 0 after 0xFF, then a restart marker after each block but the last
    width = 1 + stuffed
    at = np.cumsum(width.reshape(-1)) - width.reshape(-1) + np.repeat(np.arange(n) * 2, scan.shape[1])
    out = np.zeros(int(width.sum()) + 2 * (n - 1), np.uint8)
    out[at] = scan.reshape(-1)
    ends = (at + width.reshape(-1)).reshape(n, -1)[:-1, -1]
    out[ends] = 0xFF
    out[ends + 1] = 0xD0 + np.arange(n - 1) % 8
    return _tables(n) + out.tobytes() + b"\xff\xd9"


class Component:
    """One component of a frame: sampling, tables, and its coefficients (block rows x block columns x 64, in zigzag order)."""

    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.dc = self.ac = 0
        self.coefficients = np.empty((0, 0, 64), np.int32)


class Frame:
    """What the markers of a JPEG say; ``parse`` reads them all and decodes each scan as it comes."""

    def __init__(self):
        self.high = self.wide = self.restart = 0
        self.components: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple] = {}
        self.adobe: int | None = None

    @property
    def fast(self) -> bool:
        """Whether this is the layout that encode_frame writes."""
        one = (bytes([1] + [0] * 15), b"\x08")
        return self.restart == 1 and len(self.components) == 1 and self.high == 8 and self.components[0].h == self.components[0].v == 1 and self.wide % 8 == 0 and self.huffman.get(0x00) == self.huffman.get(0x10) == one

    def blocks_of(self, c: Component) -> tuple[int, int, int, int]:
        """Of a component: block rows and columns that cover the picture, and those of whole MCUs."""
        hm, vm = max(x.h for x in self.components), max(x.v for x in self.components)
        rows, cols = -(-(-(-self.high * c.v // vm)) // 8), -(-(-(-self.wide * c.h // hm)) // 8)
        return rows, cols, -(-self.high // (8 * vm)) * c.v, -(-self.wide // (8 * hm)) * c.h


def parse(jpeg: bytes) -> Frame:
    """Reads a baseline JPEG with all its scans."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    f, at = Frame(), 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("lost the markers")
        marker = jpeg[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0xD9:
            break
        length = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker in (0xC0, 0xC1):
            bits, f.high, f.wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not f.high or not f.wide:
                raise ValueError("8-bit pictures of known size are read")
            f.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            for c in f.components:
                *_, rows, cols = f.blocks_of(c)
                c.coefficients = np.zeros((rows, cols, 64), np.int32)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("baseline JPEG is read")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = body[k + 1 : k + 17]
                f.huffman[body[k]] = (lengths, body[k + 17 : k + 17 + sum(lengths)])
                k += 17 + sum(lengths)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                f.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 65 + 64 * wide
        elif marker == 0xDD:
            f.restart = struct.unpack(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            f.adobe = body[11]
        elif marker == 0xDA:
            parts = []
            for k in range(body[0]):
                c = next(x for x in f.components if x.ident == body[1 + 2 * k])
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                parts.append(c)
            end = _scan_end(jpeg, at)
            if f.fast:
                parts[0].coefficients[0] = _fast_scan(jpeg[at:end], f.wide // 8)
            else:
                _scan(f, parts, jpeg[at:end])
            at = end
    return f


def _scan_end(jpeg: bytes, at: int) -> int:
    """Where the next marker that isn't a restart begins."""
    while (at := jpeg.find(b"\xff", at)) >= 0:
        if at + 1 < len(jpeg) and jpeg[at + 1] != 0 and not 0xD0 <= jpeg[at + 1] <= 0xD7:
            return at
        at += 2
    return len(jpeg)


def _fast_scan(scan: bytes, n: int) -> np.ndarray:
    """Coefficients (n x 64) of blocks whose codes all are a zero bit and 8 value bits, with a restart after each."""
    raw = np.frombuffer(scan, np.uint8)
    after = np.empty(len(raw), bool)  # bytes that follow 0xFF: stuffing, or a marker's second
    after[:1] = False
    after[1:] = raw[:-1] == 0xFF
    marks = np.empty(len(raw), bool)  # 0xFF of a restart marker
    marks[-1:] = False
    marks[:-1] = (raw[:-1] == 0xFF) & (raw[1:] >= 0xD0)
    bits = np.unpackbits(raw[~after & ~marks].reshape(n, BLOCK * 9 // 8), axis=1).reshape(n, BLOCK, 9)
    if bits[:, :, 0].any():
        raise ValueError("a code that isn't in the table")
    value = np.packbits(bits[:, :, 1:], axis=2).reshape(n, BLOCK).astype(np.int16)
    return np.where(value < 128, value - 255, value)


# The standard's Huffman tables of luma and chroma, for streams without tables of their own: codes of each
# length; of the symbols of AC tables those that come first, which the others follow in rising order.
DC_LENGTHS = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]))
AC_LENGTHS = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]))
AC_FIRST = (
    bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    bytes.fromhex("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
)


def standard_table(kind: int, number: int) -> tuple:
    """(codes of each length, symbols) of DC (kind 0) or AC, for luma (number 0) or chroma."""
    k = min(number, 1)
    if not kind:
        return DC_LENGTHS[k], bytes(range(12))
    every = {run << 4 | size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0}
    return AC_LENGTHS[k], AC_FIRST[k] + bytes(sorted(every - set(AC_FIRST[k])))


def _lookup(table: tuple) -> list:
    """For each 16 bits that come next: (length of the code, symbol); None where no code fits."""
    lengths, symbols = table
    out, code, k = [None] * 65536, 0, 0
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            first = code << (16 - size)
            out[first : first + (1 << (16 - size))] = [(size, symbols[k])] * (1 << (16 - size))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """The bits of a stretch of entropy-coded data between restarts; beyond its end there are ones."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def peek(self) -> int:
        while self.n < 16:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        return (self.held >> (self.n - 16)) & 0xFFFF

    def skip(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1

    def symbol(self, codes: list) -> int:
        hit = codes[self.peek()]
        if hit is None or self.at - self.n // 8 > len(self.data):
            raise ValueError("a code that isn't in the table, or the data end")
        self.skip(hit[0])
        return hit[1]

    def value(self, size: int) -> int:
        """A coefficient of a size class: its bits, with the lower half for negative ones."""
        if not size:
            return 0
        v = self.peek() >> (16 - size)
        self.skip(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _scan(f: Frame, parts: list[Component], scan: bytes) -> None:
    """Decodes a scan into the components' coefficients."""
    stretches = _restarts(scan)
    for c in parts:
        for kind, number in ((0x00, c.dc), (0x10, c.ac)):
            f.huffman.setdefault(kind | number, standard_table(kind, number))
    codes = {k: _lookup(t) for k, t in f.huffman.items()}
    if len(parts) == 1:  # not interleaved: the blocks that cover the picture
        rows, cols, *_ = f.blocks_of(parts[0])
        units = [[(parts[0], r, k)] for r in range(rows) for k in range(cols)]
    else:
        hm, vm = max(x.h for x in f.components), max(x.v for x in f.components)
        units = [
            [(c, my * c.v + y, mx * c.h + x) for c in parts for y in range(c.v) for x in range(c.h)]
            for my in range(-(-f.high // (8 * vm))) for mx in range(-(-f.wide // (8 * hm)))
        ]
    per = f.restart or len(units)
    for k in range(0, len(units), per):
        bits, last = _Bits(next(stretches, b"")), dict.fromkeys((c.ident for c in parts), 0)
        for c, r, col in (x for unit in units[k : k + per] for x in unit):
            block = c.coefficients[r, col]
            last[c.ident] += bits.value(bits.symbol(codes[c.dc]))
            block[0], at = last[c.ident], 1
            while at < 64:
                s = bits.symbol(codes[0x10 | c.ac])
                if not s & 15 and s != 0xF0:
                    break
                at += s >> 4
                if at > 63:
                    raise ValueError("a run beyond the block")
                block[at], at = bits.value(s & 15), at + 1


def _restarts(scan: bytes):
    """The stretches of a scan between its restart markers."""
    begin = at = 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            yield scan[begin:at]
            begin = at + 2
        at += 2
    yield scan[begin:]


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The coefficients of the first component (blocks x 64, in zigzag order)."""
    f = parse(jpeg)
    return f.components[0].coefficients.reshape(-1, 64)


def coefficients_to_bytes(coefficients: np.ndarray) -> np.ndarray:
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).reshape(-1)


def _basis() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


#: The inverse transform of a whole block: 64 coefficients in zigzag order to 64 samples.
INVERSE = np.einsum("ux,vy->uvxy", _basis(), _basis()).reshape(64, 64)[ZIGZAG]


def plane(coefficients: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """Samples (8 x block rows by 8 x block columns) of coefficients (block rows x block columns x 64, in zigzag order)."""
    rows, cols, _ = coefficients.shape
    c = coefficients.reshape(-1, 64) * (1 if quant is None else quant)
    p = np.clip(np.rint(c @ INVERSE) + 128, 0, 255).astype(np.uint8)
    return p.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)


def pixels(coefficients: np.ndarray) -> np.ndarray:
    """The 8-row picture of blocks in a row with an all-one quantisation table."""
    return plane(coefficients[None])


def decode_picture(jpeg: bytes) -> np.ndarray:
    """A frame as samples: high x wide for one component, high x wide x 3 (RGB) for three, x 4 as stored for four."""
    f = parse(jpeg)
    planes, hm, vm = [], max(c.h for c in f.components), max(c.v for c in f.components)
    for c in f.components:
        p = plane(c.coefficients, f.quant[c.table])
        planes.append(np.repeat(np.repeat(p, vm // c.v, axis=0), hm // c.h, axis=1)[: f.high, : f.wide])
    if len(planes) == 1:
        return planes[0]
    x = np.stack(planes, axis=2)
    if len(planes) != 3 or f.adobe == 0:
        return x
    y, cb, cr = (x[:, :, k].astype(np.float64) - (128 if k else 0) for k in range(3))
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)), 0, 255).astype(np.uint8)


def histogram(f: Frame) -> np.ndarray:
    """Shares of BINS levels of brightness in a frame's decoded picture (its first component)."""
    c = f.components[0]
    hm, vm = max(x.h for x in f.components), max(x.v for x in f.components)
    p = plane(c.coefficients, f.quant[c.table])[: -(-f.high * c.v // vm), : -(-f.wide * c.h // hm)]
    return np.bincount(p.reshape(-1) >> 4, minlength=BINS) / p.size


def histograms(jpegs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(frames x BINS, first components' coefficients) of decoded frames; those of one size and encode_frame's layout are transformed together."""
    out, coefficients, held = np.zeros((len(jpegs), BINS)), [], {}

    def flush():
        for (n, _), (at, blocks, quant) in held.items():
            p = np.clip(np.rint(np.concatenate(blocks) * quant @ INVERSE) + 128, 0, 255).astype(np.int64).reshape(len(at), -1)
            out[at] = np.bincount((p >> 4).reshape(-1) + np.repeat(np.arange(len(at)) * BINS, p.shape[1]), minlength=BINS * len(at)).reshape(-1, BINS) / (n * 64)
        held.clear()

    for i, j in enumerate(jpegs):
        if not j:  # a dropped frame: the last picture stays
            flush()
            coefficients.append(np.empty((0, 64), np.int32))
            out[i] = out[i - 1] if i else 0
            continue
        f = parse(j)
        c = f.components[0]
        coefficients.append(c.coefficients.reshape(-1, 64))
        if f.fast:
            at, blocks, _ = held.setdefault((len(coefficients[-1]), f.quant[c.table].tobytes()), ([], [], f.quant[c.table]))
            at.append(i)
            blocks.append(coefficients[-1])
            if len(at) == TOGETHER:
                flush()
        else:
            out[i] = histogram(f)
    flush()
    return out, coefficients


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file that holds ``payload`` (a positive multiple of 64 bytes); its length stands in an ICMT chunk."""
    data = np.frombuffer(payload, np.uint8)
    per_frame = BLOCK * min(FRAME_BLOCKS, len(data) // BLOCK)
    rest = -len(data) % per_frame
    if rest:
        data = np.concatenate([data, np.zeros(rest, np.uint8)])
    jpegs = [encode_frame(x) for x in data.reshape(-1, per_frame)]
    wide = per_frame // 8
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(jpegs), 0, 1, max(map(len, jpegs)), wide, 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(jpegs), max(map(len, jpegs)), 0xFFFFFFFF, 0, 0, 0, wide, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, 8, 1, 8, b"MJPG", wide * 8, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    movi, index, at = [], [], 4
    for j in jpegs:
        movi.append(c := _chunk(b"00dc", j))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        at += len(c)
    body = b"AVI " + head + info + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(avi: bytes, at: int, end: int):
    while at + 8 <= end:
        tag, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        yield tag, at + 8, size
        at += 8 + size + size % 2


def frames(avi: bytes) -> tuple[int, int, list[bytes]]:
    """(payload length or -1, microseconds a frame, JPEG frames in the order of idx1) of an AVI file."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    payload, us, movi, index = -1, 0, 0, []
    todo = [(12, 8 + struct.unpack_from("<I", avi, 4)[0])]
    while todo:
        for tag, at, size in _chunks(avi, *todo.pop()):
            if tag == b"LIST":
                if avi[at : at + 4] == b"movi":
                    movi = at
                else:
                    todo.append((at + 4, at + size))
            elif tag == b"avih":
                us = struct.unpack_from("<I", avi, at)[0]
            elif tag == b"ICMT":
                payload = int(avi[at : at + size].rstrip(b"\0").removeprefix(b"payload=") or -1)
            elif tag == b"idx1":
                index = [struct.unpack_from("<4sIII", avi, k) for k in range(at, at + size, 16)]
    out = []
    for tag, _, at, size in index:
        if tag[2:] == b"dc":
            if avi[movi + at : movi + at + 4] != tag:
                raise ValueError("the index doesn't fit the frames")
            out.append(avi[movi + at + 8 : movi + at + 8 + size])
    return payload, us, out


def shots(histograms: np.ndarray) -> list[int]:
    """First frames of the shots; histograms: frames x bins, each of sum 1.

    The threshold adapts: mean and deviation of the last SPAN differences within the shot.
    """
    starts, past = [0], []
    for i in range(1, len(histograms)):
        d = float(np.abs(histograms[i] - histograms[i - 1]).sum() / 2)
        recent = past[-SPAN:]
        mean = sum(recent) / len(recent) if recent else 0.0
        deviation = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d >= LEAST and d > mean + K * deviation:
            starts.append(i)
            past = []
        else:
            past.append(d)
    return starts


def _clips(hist: np.ndarray, us: int) -> list[tuple[int, int, int]]:
    starts = shots(hist) if len(hist) else []
    return [(a, b, us) for a, b in zip(starts, [*starts[1:], len(hist)])]


def cut(avi: bytes) -> list[tuple[int, int, int]]:
    """Clips (first frame, end frame, microseconds a frame) of a motion-JPEG AVI file, from its decoded pictures."""
    _, us, jpegs = frames(avi)
    return _clips(histograms(jpegs)[0], us)


def decode(avi: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    """(payload, clips) of what ``encode`` stored: the bytes from the coefficients, the clips from the pictures."""
    length, us, jpegs = frames(avi)
    hist, stored = histograms(jpegs)
    return b"".join(coefficients_to_bytes(x).tobytes() for x in stored)[:length], _clips(hist, us)


def feature(clips) -> str:
    """Frames, and each clip as start-end in milliseconds."""
    ms = lambda f, us: f * us // 1000
    return f"frames={clips[-1][1]};clips=" + ",".join(f"{ms(a, us)}-{ms(b, us)}" for a, b, us in clips)


def _id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as an AVI file."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([encode(pad(x)) for x in texts_of(batch)], pa.binary())], ["id", "media"])

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {_id_type(docs, id_col)}, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(id, clip, start_ms, end_ms, n_frames): a row for each shot of each (id, media)."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column("id").to_pylist(), []
            for i, avi in zip(ids, batch.column("media").to_pylist()):
                if avi is not None:
                    out += [{"id": i, "clip": k, "start_ms": a * us // 1000, "end_ms": b * us // 1000, "n_frames": b - a} for k, (a, b, us) in enumerate(cut(avi))]
            schema = pa.schema([("id", batch.schema.field("id").type), ("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_frames", pa.int32())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return media.select("id", "media").mapInArrow(run, f"id {_id_type(media, 'id')}, clip int, start_ms long, end_ms long, n_frames int")


def media_report(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the stored bytes back and digests both: see the columns.

    The media pass from encoder to decoder within a task and are not shuffled.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                avi = encode(pad(text))
                payload, cut = decode(avi)
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature(cut), len(cut)))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips"])

    kind = _id_type(docs, "doc_id")
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips int")
