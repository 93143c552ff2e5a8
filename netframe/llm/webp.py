"""Media columns as lossless WebP.

The decoder reads the whole lossless format: prefix codes in groups, back-references, the colour cache, and the predictor,
cross-colour, subtract-green and palette transforms, into an array of pixels. A stream without back-references, cache and
groups is decoded with arrays: the symbol and length at every bit are looked up at once, and only the walk from code to code is
sequential.

A payload (the text's bytes, padded with zeros to a positive multiple of 64) is stored as grey images WIDTH samples wide: a
sample is a byte, in the green channel, with subtract-green making red and blue follow. An image has at most MAX_ROWS rows;
a longer payload is several files, one after the other. How an image is coded goes by its content: a palette where it has few
different samples, a predictor where the differences to the left or upper neighbour take fewer bits, back-references where it
repeats itself. No grey image gains by cross-colour or the cache; those are decoded, not written here.

Defined cases: null and empty texts are one row of zeros. Equal texts have equal media. An empty table has an empty result. Files that break off or break the
format raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netframe.llm.common import raw_texts, sliced, text_frame

WIDTH = 64
MAX_ROWS = 16_384
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_LENGTH = 15

# fixed values of the format: order of the code length code, and the neighbourhood of short distances as (dx, dy)
_CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# -- prefix codes ---------------------------------------------------------------------------------------------------


@lru_cache(1 << 12)
def _reversed(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Each symbol's (code with the first bit lowest, length); a lone symbol has no bits."""
    if len(lengths) == 1:
        return {s: (0, 0) for s in lengths}
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[s] = (_reversed(code, n), n)
        code += 1
    if code != 1 << last:
        raise ValueError("incomplete prefix code")
    return out


def code_lengths(counts: dict[int, int], most: int = MAX_LENGTH) -> dict[int, int]:
    """Huffman lengths of at most this many bits; while any is longer, the counts are made more even."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 0)
    floor = 1
    while True:
        symbols = list(counts)
        n = len(symbols)
        heap = [(max(c, floor), i) for i, c in enumerate(counts.values())]
        heapq.heapify(heap)
        parent, nxt = [0] * (2 * n - 1), n
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = nxt
            heapq.heapreplace(heap, (a + b, nxt))
            nxt += 1
        depth = [0] * nxt
        for i in range(nxt - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= most:
            return dict(zip(symbols, depth[:n], strict=True))
        floor = floor * 2 + 1


class BitWriter:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.n, self.at = data, len(data) * 8, 0

    def get(self, n: int) -> int:
        at = self.at
        self.at += n
        if self.at > self.n:
            raise ValueError("the stream breaks off")
        return int.from_bytes(self.data[at >> 3 : (self.at + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)


def _write_code(out: BitWriter, lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Writes a code's lengths and returns the code. lengths: of the symbols that occur."""
    symbols = sorted(lengths)
    if not symbols:
        symbols, lengths = [0], {0: 0}
    if len(symbols) <= 2 and symbols[-1] < 256:
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        out.put(wide, 1)
        out.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
            return {symbols[0]: (0, 1), symbols[1]: (1, 1)}
        return {symbols[0]: (0, 0)}
    runs: list[tuple[int, int, int]] = []  # code length symbol, extra value, extra bits
    at = 0
    for s in symbols:
        gap = s - at
        while gap >= 11:
            n = min(gap, 138)
            runs.append((18, n - 11, 7))
            gap -= n
        if gap >= 3:
            runs.append((17, gap - 3, 3))
            gap = 0
        runs += [(0, 0, 0)] * gap
        runs.append((max(1, lengths[s]), 0, 0))
        at = s + 1
    counts: dict[int, int] = {}
    for s, _, _ in runs:
        counts[s] = counts.get(s, 0) + 1
    own = code_lengths(counts, 7)
    if len(own) == 1:
        own = dict.fromkeys(own, 1)
    n_codes = max(4, max(_CODE_LENGTH_ORDER.index(s) for s in own) + 1)
    out.put(0, 1)
    out.put(n_codes - 4, 4)
    for s in _CODE_LENGTH_ORDER[:n_codes]:
        out.put(own.get(s, 0), 3)
    out.put(1, 1)  # only so many code lengths follow
    rest = len(runs) - 2  # a lone symbol below 256 has been written above, so there are two at least
    n = max(1, (rest.bit_length() + 1) // 2)
    out.put(n - 1, 3)
    out.put(rest, 2 * n)
    code = canonical(own)
    for s, extra, bits in runs:
        out.put(*code[s])
        out.put(extra, bits)
    return canonical(lengths) if len(lengths) > 1 else {symbols[0]: (0, 0)}


class Code:
    """A prefix code for reading: a table over as many bits as its longest code has."""

    def __init__(self, lengths: dict[int, int]):
        self.only = next(iter(lengths)) if len(lengths) == 1 else None
        self.bits = 0 if self.only is not None else max(lengths.values())
        self.symbols, self.lengths = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        for s, (code, n) in canonical(lengths).items():
            self.symbols[code :: 1 << n], self.lengths[code :: 1 << n] = s, n
        self.table = None

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))
        s, n = self.table[bits.peek(self.bits)]
        bits.at += n
        if bits.at > bits.n:
            raise ValueError("the stream breaks off")
        return s


def _read_code(bits: BitReader, size: int) -> Code:
    if bits.get(1):
        n = bits.get(1)
        first = bits.get(8 if bits.get(1) else 1)
        return Code({first: 1, bits.get(8): 1} if n else {first: 0})
    own = {s: n for s in _CODE_LENGTH_ORDER[: 4 + bits.get(4)] if (n := bits.get(3))}
    if not own:
        raise ValueError("a code without symbols")
    code = Code(own)
    left = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else size
    lengths, at, last = {}, 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            if s:
                lengths[at] = last = s
            at += 1
        elif s == 16:
            n = 3 + bits.get(2)
            lengths |= dict.fromkeys(range(at, at + n), last)
            at += n
        else:
            at += 3 + bits.get(3) if s == 17 else 11 + bits.get(7)
    if at > size or not lengths:
        raise ValueError("code lengths don't fit the alphabet")
    return Code(lengths)


# -- entropy-coded images -------------------------------------------------------------------------------------------


def _extended(prefix: int, bits: BitReader) -> int:
    """Length or distance of a prefix symbol."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.get(n) + 1


def _prefix_of(value: int) -> tuple[int, int, int]:
    """The reverse: prefix symbol, extra value, extra bits."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    high = (value - 1) >> n
    return 2 * n + 2 + (high & 1), (value - 1) - (high << n), n


def _cached(argb: int, cache_bits: int) -> int:
    return (0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - cache_bits)


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB of an entropy-coded image, flat."""
    cache_bits = bits.get(4) if bits.get(1) else 0
    groups, group_bits, group_of = 1, 0, None
    if main and bits.get(1):
        group_bits = bits.get(3) + 2
        group_of = _read_image(bits, (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits, False) >> 8 & 0xFFFF
        groups = int(group_of.max()) + 1
    codes = [[_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    if groups == 1 and not cache_bits and (fast := _read_literals(bits, codes[0], width * height)) is not None:
        return fast
    out, cache, at, total = [0] * (width * height), [0] * (1 << cache_bits), 0, width * height
    pending = 0  # pixels before this are in the cache
    per_row = (width + (1 << group_bits) - 1) >> group_bits
    while at < total:
        green, red, blue, alpha, distance = codes[int(group_of[(at // width >> group_bits) * per_row + (at % width >> group_bits)]) if group_of is not None else 0]
        s = green.read(bits)
        if s < 256:
            out[at] = s << 8 | red.read(bits) << 16 | blue.read(bits) | alpha.read(bits) << 24
            at += 1
        elif s < 280:
            n = _extended(s - 256, bits)
            d = _extended(distance.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = _NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            if d >= n:
                out[at : at + n] = out[at - d : at - d + n]
            else:
                out[at : at + n] = (out[at - d : at] * (n // d + 1))[:n]
            at += n
        else:
            while pending < at:
                cache[_cached(out[pending], cache_bits)] = out[pending]
                pending += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _read_literals(bits: BitReader, codes: list[Code], total: int) -> np.ndarray | None:
    """The pixels if only green has bits and all of its symbols are literals; else None, with nothing read."""
    green, red, blue, alpha, _ = codes
    if red.only is None or blue.only is None or alpha.only is None:
        return None
    rest = np.uint32(red.only << 16 | blue.only | alpha.only << 24)
    if green.only is not None:
        return np.full(total, rest | np.uint32(green.only << 8), np.uint32) if green.only < 256 else None
    if green.symbols.max() >= 256:
        return None
    start = bits.at >> 3
    data = np.frombuffer(bits.data, np.uint8, offset=start).astype(np.uint32)
    data = np.concatenate([data, np.zeros(3, np.uint32)])
    words = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).astype(np.uint16).ravel()
    after = np.minimum(np.arange(len(window), dtype=np.int32) + green.lengths.astype(np.int8)[window], np.int32(len(window) - 1))
    stride = after  # JUMP codes further
    for _ in range(JUMP.bit_length() - 1):
        stride = stride[stride]
    at, walked, end, step = bits.at & 7, [], (len(data) - 3) * 8, memoryview(stride)
    for _ in range(-(-total // JUMP)):
        walked.append(at)
        at = step[at]
    path = np.empty((JUMP, len(walked)), np.int32)
    path[0] = walked
    for k in range(1, JUMP):
        path[k] = after[path[k - 1]]
    path = path.T.ravel()[:total]
    at = int(path[-1]) + int(green.lengths[window[path[-1]]])
    if at > end:
        raise ValueError("the stream breaks off")
    bits.at = start * 8 + at
    return green.symbols[window[path]].astype(np.uint32) << 8 | rest


#: Codes that one step of the sequential walk skips, a power of two.
JUMP = 16


# -- transforms -----------------------------------------------------------------------------------------------------


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of alpha, red, green, blue."""
    return np.stack([argb >> 24, argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _half(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predicted(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return _half(_half(left, top_right), top)
        case 6:
            return _half(left, top_left)
        case 7:
            return _half(left, top)
        case 8:
            return _half(top_left, top)
        case 9:
            return _half(top, top_right)
        case 10:
            return _half(_half(left, top_left), _half(top, top_right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
            to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
            return left if to_left < to_top else top
        case 12:
            return [_clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
        case 13:
            mean = _half(left, top)
            return [_clamp(m + int((m - c) / 2)) for m, c in zip(mean, top_left, strict=True)]
    return [255, 0, 0, 0]


def _over_pixels(pixels: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Predictor residuals to pixels, or (forward) pixels to residuals. pixels: (height, width, 4)."""
    height, width, _ = pixels.shape
    if (mode := int(modes.flat[0])) in (1, 2) and (modes == mode).all():
        return _by_neighbour(pixels, mode, forward)
    given = pixels.tolist()
    made = [[None] * width for _ in range(height)]
    real = given if forward else made
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = [255, 0, 0, 0] if x == 0 else real[0][x - 1]
            elif x == 0:
                p = real[y - 1][0]
            else:
                right = real[y - 1][x + 1] if x + 1 < width else real[y][0]
                p = predicted(int(modes[y >> bits, x >> bits]), real[y][x - 1], real[y - 1][x], real[y - 1][x - 1], right)
            made[y][x] = [(g - q if forward else g + q) & 255 for g, q in zip(given[y][x], p, strict=True)]
    return np.array(made, np.int32)


def _by_neighbour(pixels: np.ndarray, mode: int, forward: bool) -> np.ndarray:
    """Predictor 1 (left) or 2 (top) all over the image; the first row goes by the left, the first column by the top."""
    start = np.zeros((1, 1, 4), np.int32)
    start[..., 0] = 255
    if forward:
        by_left, by_top = np.diff(pixels, axis=1, prepend=0), np.diff(pixels, axis=0, prepend=0)
        out = by_left.copy() if mode == 1 else by_top.copy()
        out[0, 1:], out[1:, 0], out[:1, :1] = by_left[0, 1:], by_top[1:, 0], pixels[:1, :1] - start
        return out & 255
    out = pixels.copy()
    out[:1, :1] += start
    if mode == 1:
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        return np.cumsum(out, axis=1) & 255
    out[0] = np.cumsum(out[0], axis=0)
    return np.cumsum(out, axis=0) & 255


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def _cross(pixels: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """The cross-colour transform. elements: ARGB of each block, with green to red in blue, green to blue in green, red to blue in red."""
    height, width, _ = pixels.shape
    e = _channels(elements)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    out, sign = pixels.copy(), -1 if forward else 1
    out[..., 1] = (pixels[..., 1] + sign * _delta(e[..., 3], pixels[..., 2])) & 255
    red = pixels[..., 1] if forward else out[..., 1]
    out[..., 3] = (pixels[..., 3] + sign * (_delta(e[..., 2], pixels[..., 2]) + _delta(e[..., 1], red))) & 255
    return out


# -- files ----------------------------------------------------------------------------------------------------------


def decode(data: bytes) -> np.ndarray:
    """The pixels of one file, (height, width, 4) of alpha, red, green, blue."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    n = struct.unpack("<I", data[16:20])[0]
    bits = BitReader(data[21 : 20 + n])
    width, height = bits.get(14) + 1, bits.get(14) + 1
    bits.get(1)
    if bits.get(3):
        raise ValueError("unknown version")
    transforms, own = [], width
    while bits.get(1):
        kind = bits.get(2)
        if kind in {t[0] for t in transforms}:
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            size = bits.get(3) + 2
            w, h = (own + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size
            transforms.append((kind, size, _read_image(bits, w, h, False).reshape(h, w), own))
        elif kind == PALETTE:
            n = bits.get(8) + 1
            colours = _packed(np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0) & 255)
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, size, colours, own))
            own = (own + (1 << size) - 1) >> size
        else:
            transforms.append((kind, 0, None, own))
    argb = _read_image(bits, own, height, True).reshape(height, own)
    for kind, size, held, own in reversed(transforms):
        if kind == PREDICTOR:
            argb = _packed(_over_pixels(_channels(argb), held >> 8 & 15, size, False))
        elif kind == CROSS_COLOR:
            argb = _packed(_cross(_channels(argb), held, size, False))
        elif kind == SUBTRACT_GREEN:
            green = argb >> 8 & 255
            argb = argb & 0xFF00FF00 | ((argb >> 16 & 255) + green & 255) << 16 | (argb & 255) + green & 255
        else:
            index = argb >> 8 & 255
            if size:
                index = (index[:, :, None] >> (np.arange(1 << size, dtype=np.uint32) * (8 >> size)) & ((1 << (8 >> size)) - 1)).reshape(height, -1)[:, :own]
            argb = np.concatenate([held, np.zeros(256 - len(held), np.uint32)])[index]
    return _channels(argb)


def _file(bits: BitWriter) -> bytes:
    body = b"\x2f" + bits.value.to_bytes((bits.n + 7) // 8, "little")
    body_padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body_padded) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body_padded


def _header(width: int, height: int, alpha: bool) -> BitWriter:
    out = BitWriter()
    for value, n in ((width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        out.put(value, n)
    return out


#: Bits that a predictor must save of each sample's to be worth its while.
GAIN = 0.25
#: Images that deflate makes this much smaller are written with back-references.
REPEATS = 0.3
#: Different samples that a palette may have; as few share a pixel.
MAX_PALETTE = 16
MIN_MATCH, MAX_MATCH, MAX_DISTANCE = 4, 4096, (1 << 20) - 120


def _bits_a_sample(counts: np.ndarray) -> float:
    """Entropy of a histogram."""
    held = counts[counts > 0]
    return float(np.log2(held.sum()) - (held * np.log2(held)).sum() / held.sum())


def encode_grey(samples: np.ndarray) -> bytes:
    """A grey image, (height, width) bytes, as one file, coded as its content asks for."""
    height, width = samples.shape
    out, alpha = _header(width, height, False), 255
    counts = np.bincount(samples.ravel(), minlength=256)
    values = np.flatnonzero(counts)
    if len(values) <= MAX_PALETTE:
        out.put(1 | PALETTE << 1, 3)
        out.put(len(values) - 1, 8)
        colours = 0xFF000000 | values.astype(np.uint32) * 0x010101
        _write_image(out, _packed(np.diff(_channels(colours), axis=0, prepend=0))[None, :], False)
        size = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        index = np.pad(np.searchsorted(values, samples), ((0, 0), (0, -width % (1 << size)))).reshape(height, -1, 1 << size)
        green = (index << (np.arange(1 << size) * (8 >> size))).sum(axis=2).astype(np.uint8)
    else:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        plain = _bits_a_sample(counts)
        by = {1: np.diff(samples, axis=1), 2: np.diff(samples, axis=0)} if height > 1 else {1: np.diff(samples, axis=1)}
        mode = min(by, key=lambda m: (_bits_a_sample(np.bincount(by[m].ravel(), minlength=256)), m))
        green = samples
        if _bits_a_sample(np.bincount(by[mode].ravel(), minlength=256)) < plain - GAIN:
            out.put(1 | PREDICTOR << 1, 3)
            out.put(7, 3)  # blocks of 512
            _write_image(out, np.full((-(-height >> 9) or 1, -(-width >> 9) or 1), 0xFF000000 | mode << 8, np.uint32), False)
            pixels = np.zeros((height, width, 4), np.int32)
            pixels[..., 0], pixels[..., 2] = 255, samples
            green, alpha = _by_neighbour(pixels, mode, True)[..., 2].astype(np.uint8), 0
    out.put(0, 3)  # no more transforms, no cache, one group
    flat = np.ascontiguousarray(green).ravel()
    repeats = len(flat) > 256 and len(zlib.compress(flat.tobytes(), 1)) < REPEATS * len(flat)
    symbols, extras, bits, distances, far, far_bits = _matches(flat.tobytes(), green.shape[1]) if repeats else (flat, *[None] * 5)
    green_codes = _code_for(out, symbols)
    for only in (0, 0, alpha):
        _write_code(out, {only: 0})
    if repeats:
        distance_codes = _code_for(out, distances[distances >= 0])
        codes, sizes = (x[symbols] for x in green_codes)
        one = np.maximum(distances, 0)
        has = distances >= 0
        parts = [(codes, sizes), (extras, bits), (np.where(has, distance_codes[0][one], 0), np.where(has, distance_codes[1][one], 0)), (far, far_bits)]
        codes, sizes = (np.stack([p[k] for p in parts], axis=1).ravel().astype(np.int64) for k in (0, 1))
    else:
        _write_code(out, {0: 0})
        codes, sizes = green_codes[0].astype(np.uint16)[symbols], green_codes[1].astype(np.uint8)[symbols]
    ends = np.cumsum(sizes, dtype=np.int32)
    if total := int(ends[-1]):
        within = (np.arange(total, dtype=np.int32) - np.repeat(ends - sizes, sizes)).astype(codes.dtype)
        stream = np.packbits((np.repeat(codes, sizes) >> within & 1).astype(np.uint8), bitorder="little")
        out.put(int.from_bytes(stream.tobytes(), "little"), total)
    return _file(out)


def _code_for(out: BitWriter, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for these symbols; returns each symbol's code and length."""
    counts = np.bincount(symbols, minlength=1)
    lengths = code_lengths({s: int(counts[s]) for s in np.flatnonzero(counts).tolist()}) if counts.any() else {}
    code = _write_code(out, lengths)
    codes, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for s, (c, n) in code.items() if len(code) > 1 else ():
        codes[s], sizes[s] = c, n
    return codes, sizes


@lru_cache(4)
def _near_of(width: int) -> dict[int, int]:
    """The number of a short distance in the neighbourhood."""
    return {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(_NEAR)))}


def _matches(data: bytes, width: int) -> tuple[np.ndarray, ...]:
    """Greedy back-references: for each literal or reference its green symbol, extra length value and bits, distance symbol (-1 for a literal), extra distance value and bits."""
    near, seen, rows, at, end = _near_of(width), {}, [], 0, len(data)
    while at < end:
        key = data[at : at + MIN_MATCH]
        before = seen.get(key)
        seen[key] = at
        n = 0
        if before is not None and len(key) == MIN_MATCH and at - before <= MAX_DISTANCE:
            n, most = MIN_MATCH, min(MAX_MATCH, end - at)
            step = 64
            while step:
                while n + step <= most and data[before + n : before + n + step] == data[at + n : at + n + step]:
                    n += step
                step //= 8
        if not n:
            rows.append((data[at], 0, 0, -1, 0, 0))
            at += 1
            continue
        d = at - before
        length, distance = _prefix_of(n), _prefix_of(near.get(d, d + 120))
        rows.append((256 + length[0], *length[1:], *distance))
        for k in range(at + 1, at + n - MIN_MATCH, 8):
            seen[data[k : k + MIN_MATCH]] = k
        at += n
    return tuple(np.array(rows, np.int64).T)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), block_bits: int = 2, cache_bits: int = 0, references: bool = False, modes: np.ndarray | None = None, elements: np.ndarray | None = None) -> bytes:
    """Any image, (height, width, 4) of alpha, red, green, blue, with the transforms in this order."""
    height, width, _ = pixels.shape
    out, channels, own = _header(width, height, bool((pixels[..., 0] != 255).any())), pixels.astype(np.int32), width
    for kind in transforms:
        out.put(1 | kind << 1, 3)
        shape = (height + (1 << block_bits) - 1) >> block_bits, (own + (1 << block_bits) - 1) >> block_bits
        if kind == PREDICTOR:
            held = np.full(shape, 11) if modes is None else modes
            out.put(block_bits - 2, 3)
            _write_image(out, 0xFF000000 | held.astype(np.uint32) << 8, False)
            channels = _over_pixels(channels, held, block_bits, True)
        elif kind == CROSS_COLOR:
            held = np.full(shape, 0xFF102030, np.uint32) if elements is None else elements
            out.put(block_bits - 2, 3)
            _write_image(out, held, False)
            channels = _cross(channels, held, block_bits, True)
        elif kind == SUBTRACT_GREEN:
            channels = channels.copy()
            channels[..., 1] = channels[..., 1] - channels[..., 2] & 255
            channels[..., 3] = channels[..., 3] - channels[..., 2] & 255
        else:
            colours, index = np.unique(_packed(channels), return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette has at most 256 colours")
            out.put(len(colours) - 1, 8)
            _write_image(out, _packed(np.diff(_channels(colours), axis=0, prepend=0))[None, :], False)
            size = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = index.reshape(height, own)
            index = np.pad(index, ((0, 0), (0, -own % (1 << size)))).reshape(height, -1, 1 << size)
            own = index.shape[1]
            channels = _channels(0xFF000000 | (index << (np.arange(1 << size) * (8 >> size))).sum(axis=2).astype(np.uint32) << 8)
    out.put(0, 1)
    _write_image(out, _packed(channels), True, cache_bits, references)
    return _file(out)


def _write_image(out: BitWriter, argb: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    flat, width = [int(x) for x in argb.ravel()], argb.shape[1]
    tokens: list[tuple] = []
    cache, seen, at = [None] * (1 << cache_bits), {}, 0
    while at < len(flat):
        n = d = 0
        if references and (before := seen.get(tuple(flat[at : at + 3]))) is not None:
            d = at - before
            while at + n < len(flat) and n < 4096 and flat[at + n] == flat[before + n]:
                n += 1
        if n >= 3:
            near = next((k + 1 for k, (dx, dy) in enumerate(_NEAR) if max(1, dx + dy * width) == d), None)
            tokens.append((_prefix_of(n), _prefix_of(near or d + 120)))
        elif cache_bits and cache[k := _cached(flat[at], cache_bits)] == flat[at]:
            n = 1
            tokens.append((280 + k,))
        else:
            n = 1
            tokens.append((flat[at] >> 8 & 255, flat[at] >> 16 & 255, flat[at] & 255, flat[at] >> 24))
        for i in range(at, at + n):
            seen[tuple(flat[i : i + 3])] = i
            if cache_bits:
                cache[_cached(flat[i], cache_bits)] = flat[i]
        at += n
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    counts: list[dict[int, int]] = [{} for _ in range(5)]
    for t in tokens:
        for k, s in enumerate((256 + t[0][0], None, None, None, t[1][0]) if len(t) == 2 else t):
            if s is not None:
                counts[k][s] = counts[k].get(s, 0) + 1
    codes = [_write_code(out, code_lengths(c) if c else {}) for c in counts]
    for t in tokens:
        if len(t) == 2:
            for k, (s, extra, n) in ((0, (256 + t[0][0], *t[0][1:])), (4, t[1])):
                out.put(*codes[k][s])
                out.put(extra, n)
        else:
            for k, s in enumerate(t):
                out.put(*codes[k][s])


# -- the column -----------------------------------------------------------------------------------------------------


def payload_of(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def store(payload: bytes) -> bytes:
    """The payload as one file after another."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_grey(samples[i : i + MAX_ROWS]) for i in range(0, len(samples), MAX_ROWS))


def restore(media: bytes) -> np.ndarray:
    """The samples of all files, (rows, WIDTH)."""
    parts, at = [], 0
    while at < len(media):
        n = struct.unpack("<I", media[at + 4 : at + 8])[0] + 8
        parts.append(decode(media[at : at + n])[..., 2].astype(np.uint8))
        at += n
    return np.concatenate(parts)


def features(samples: np.ndarray) -> str:
    """rows:mean:variance:mean step between neighbours:distinct samples, of what was read back; in whole thousandths."""
    flat = samples.ravel().astype(np.int64)
    n, total = len(flat), int(flat.sum())
    step = int(np.abs(np.diff(flat)).sum())
    return f"{len(samples)}:{total * 1000 // n}:{(int((flat * flat).sum()) * n - total * total) * 1000 // (n * n)}:{step * 1000 // max(1, n - 1)}:{np.count_nonzero(np.bincount(flat, minlength=256))}"


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with_media: media and pixels) for each row; the payload's columns come from the media."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, media_out, pixels_out = [], [], []
            for raw in raw_texts(batch):
                media = store(payload_of(raw))
                samples = restore(media)
                payload = samples.tobytes()
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
                if with_media:
                    media_out.append(media)
                    pixels_out.append(payload)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            out = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if with_media:
                out += [pa.array(media_out, pa.binary()), pa.array(pixels_out, pa.binary())]
                names += ["media", "pixels"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return text_frame(docs).mapInArrow(make, schema + ", media binary, pixels binary" * with_media)
