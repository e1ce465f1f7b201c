"""Lossless WebP (VP8L): a decoder of the whole format, a batch decoder for plain streams, and an encoder.

Pixels are 32-bit ARGB numbers. Errors in a stream raise ValueError.
"""

from __future__ import annotations

import struct
from functools import cached_property, lru_cache

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD
# Offsets (x to the left, y up) of the distance codes 1 to 120.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


# --- bits and prefix codes ------------------------------------------------------------------------


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data + bytes(8), at, len(data) * 8

    def read(self, n: int) -> int:
        k = self.at >> 3
        value = (int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream is cut off")
        return value

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 3], "little") >> (self.at & 7)


@lru_cache(None)
def mirrored(bits: int) -> np.ndarray:
    """The numbers of so many bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


@lru_cache(None)
def _mirror(bits: int) -> list[int]:
    return mirrored(bits).tolist()


def canonical(lengths) -> list[tuple[int, int, int]]:
    """(symbol, code as it stands in the stream, length) of each symbol with a length."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    out, code, last = [], 0, 0
    for n, s in used:
        code <<= n - last
        last = n
        if code >> n:
            raise ValueError("the prefix code isn't complete")
        out.append((s, _mirror(n)[code], n))
        code += 1
    if len(used) > 1 and code != 1 << last:
        raise ValueError("the prefix code isn't complete")
    return out


class Code:
    """A prefix code as one table: the next `bits` bits -> symbol << 4 | length."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.single = int(used[0]) if len(used) == 1 else None
        self.bits = 0 if self.single is not None else int(lengths.max())
        self.mask = (1 << self.bits) - 1
        if self.single is not None:
            self.array = np.array([self.single << 4], np.int32)
            return
        used = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[used]
        share = 1 << (self.bits - size)
        if share.sum() != 1 << self.bits:
            raise ValueError("the prefix code isn't complete")
        self.array = np.repeat(used << 4 | size, share).astype(np.int32)[mirrored(self.bits)]

    @cached_property
    def table(self) -> list[int]:
        return self.array.tolist()

    def read(self, bits: Bits) -> int:
        entry = self.table[bits.peek() & self.mask]
        bits.at += entry & 15
        if bits.at > bits.end:
            raise ValueError("the stream is cut off")
        return entry >> 4


@lru_cache(4096)
def small_code(lengths: tuple[int, ...]) -> Code:
    """Codes of one or two symbols and codes of code lengths, which come again and again."""
    return Code(lengths)


@lru_cache(4096)
def one_symbol(k: int, symbols: int) -> Code:
    if k >= symbols:
        raise ValueError("a symbol outside its alphabet")
    lengths = [0] * symbols
    lengths[k] = 1
    return Code(lengths)


def read_code(bits: Bits, symbols: int) -> Code:
    lengths = [0] * symbols
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        if not two:
            return one_symbol(bits.read(8 if wide else 1), symbols)
        for k in (bits.read(8 if wide else 1), bits.read(8)):
            if k >= symbols:
                raise ValueError("a symbol outside its alphabet")
            lengths[k] = 1
        return small_code(tuple(lengths))
    of_lengths = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code = small_code(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    at, last = 0, 8
    table, mask, data, place = code.table, code.mask, bits.data, bits.at
    while at < symbols and left > 0:
        left -= 1
        k = place >> 3
        word = int.from_bytes(data[k : k + 4], "little") >> (place & 7)
        entry = table[word & mask]
        s, n = entry >> 4, entry & 15
        place += n
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        extra = (2, 3, 7)[s - 16]
        value, n = last if s == 16 else 0, (11 if s == 18 else 3) + (word >> n & (1 << extra) - 1)
        place += extra
        if at + n > symbols:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    bits.at = place
    if place > bits.end:
        raise ValueError("the stream is cut off")
    return Code(lengths)


def read_value(bits: Bits, prefix: int) -> int:
    """A length or a distance code from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- the decoder ----------------------------------------------------------------------------------


def _groups(bits: Bits, width: int, height: int, main: bool):
    """Colour cache bits, meta prefix image (or None) with its tile bits, and the prefix code groups."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("a colour cache of more than 11 bits")
    meta, tile, n = None, 0, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        w = (width + (1 << tile) - 1) >> tile
        h = (height + (1 << tile) - 1) >> tile
        meta = [(x >> 8) & 0xFFFF for x in pixels_of(bits, w, h, False)]
        n = max(meta) + 1
    sizes = [280 + (1 << cache if cache else 0), 256, 256, 256, 40]
    return cache, meta, tile, [[read_code(bits, k) for k in sizes] for _ in range(n)]


def pixels_of(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    cache_bits, meta, tile, groups = _groups(bits, width, height, main)
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    out: list[int] = []
    total, filled = width * height, 0  # filled: pixels that are in the cache
    tiles = (width + (1 << tile) - 1) >> tile
    green, red, blue, alpha, far = groups[0]
    while len(out) < total:
        if meta is not None:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, far = groups[meta[(y >> tile) * tiles + (x >> tile)]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = read_value(bits, s - 256)
            d = distance(read_value(bits, far.read(bits)), width)
            if d > len(out) or len(out) + n > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            while filled < len(out):
                x = out[filled]
                cache[(CACHE_MULTIPLIER * x & 0xFFFFFFFF) >> shift] = x
                filled += 1
            out.append(cache[s - 280])
    return out


_known: dict[tuple[int, int], dict[int, dict[int, tuple[int, ...]]]] = {}  #: by size, bits read and their value
KNOWN, KNOWN_BITS = 512, 2048  #: most images kept of a size and number of bits, and most bits


def small_pixels(bits: Bits, width: int, height: int) -> tuple[int, ...]:
    """pixels_of() of a palette or tile image, which comes again and again: what was read from the same bits is kept."""
    known = _known.setdefault((width, height), {}) if len(_known) < KNOWN else _known.get((width, height), {})
    k = bits.at >> 3
    ahead = int.from_bytes(bits.data[k : k + KNOWN_BITS // 8 + 1], "little") >> (bits.at & 7)
    for n, found in known.items():
        if bits.at + n <= bits.end and (out := found.get(ahead & ((1 << n) - 1))) is not None:
            bits.at += n
            return out
    start = bits.at
    out = tuple(pixels_of(bits, width, height, False))
    n = bits.at - start
    if n <= KNOWN_BITS and len(known) < 16:
        found = known.setdefault(n, {})
        if len(found) < KNOWN:
            found[ahead & ((1 << n) - 1)] = out
    return out


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, right, corner):
    """Prediction of a pixel's four channels from those around it (arrays of 4)."""
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return left if abs(top - corner).sum() < abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        half = mean - corner
        return np.clip(mean + (np.abs(half) // 2) * np.sign(half), 0, 255)
    return {1: left, 2: top, 3: right, 4: corner}.get(mode, np.array([255, 0, 0, 0]))


def channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB numbers as an int array (..., 4)."""
    return np.stack([(pixels >> k) & 255 for k in (24, 16, 8, 0)], -1).astype(np.int64)


def packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _around(c: np.ndarray, y: int, x: int, mode: int) -> np.ndarray:
    """The prediction at (y, x) of an image whose earlier pixels are known."""
    if y == 0:
        return c[0, x - 1] if x else np.array([255, 0, 0, 0])
    if x == 0:
        return c[y - 1, 0]
    right = c[y - 1, x + 1] if x + 1 < c.shape[1] else c[y, 0]
    return _predict(mode, c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])


def undo_predictor(c: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    out = c.copy()
    for y in range(c.shape[0]):
        for x in range(c.shape[1]):
            out[y, x] = (c[y, x] + _around(out, y, x, int(modes[y >> tile, x >> tile]))) & 255
    return out


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    signed = lambda v: np.where(v & 255 > 127, (v & 255) - 256, v & 255)
    return (signed(t) * signed(c)) >> 5


def _spread(tiles: np.ndarray, tile: int, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << tile, 0), 1 << tile, 1)[: shape[0], : shape[1]]


def undo_cross_colour(c: np.ndarray, tiles: np.ndarray, tile: int) -> np.ndarray:
    t = _spread(tiles, tile, c.shape[:2])
    out = c.copy()
    out[..., 1] = (c[..., 1] + _delta(t[..., 3], c[..., 2])) & 255
    out[..., 3] = (c[..., 3] + _delta(t[..., 2], c[..., 2]) + _delta(t[..., 1], out[..., 1])) & 255
    return out


def palette_bits(size: int) -> int:
    """log2 of the pixels that share one packed pixel."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    share = palette_bits(len(palette))
    index = (pixels >> 8) & 255
    if share:
        depth = 8 >> share
        x = np.arange(width)
        index = (index[:, x >> share] >> ((x & ((1 << share) - 1)) * depth)) & ((1 << depth) - 1)
    full = np.zeros(256, np.int64)
    full[: len(palette)] = palette
    return full[index]


def stream_of(data: bytes) -> bytes:
    """The VP8L stream of a RIFF file (or a bare stream)."""
    if data[:4] != b"RIFF":
        return data
    if data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image")


def head(data: bytes) -> tuple[Bits, int, int]:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    return bits, width, height


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height x width) of a lossless WebP file."""
    bits, width, height = head(stream_of(data))
    transforms, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (x[0] for x in transforms):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            tw, th = (w + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            transforms.append((kind, tile, np.array(pixels_of(bits, tw, th, False), np.int64).reshape(th, tw), w))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = channels(np.array(pixels_of(bits, n, 1, False), np.int64))
            transforms.append((kind, 0, packed(np.cumsum(steps, 0)), w))
            share = palette_bits(n)
            w = (w + (1 << share) - 1) >> share
        else:
            transforms.append((kind, 0, None, w))
    pixels = np.array(pixels_of(bits, w, height, True), np.int64).reshape(height, w)
    for kind, tile, image, before in reversed(transforms):
        if kind == PREDICTOR:
            pixels = packed(undo_predictor(channels(pixels), (image >> 8) & 15, tile))
        elif kind == CROSS_COLOUR:
            pixels = packed(undo_cross_colour(channels(pixels), channels(image), tile))
        elif kind == SUBTRACT_GREEN:
            c = channels(pixels)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            pixels = packed(c)
        else:
            pixels = undo_palette(pixels, image, before)
    return pixels


# --- the encoder ----------------------------------------------------------------------------------


class Writer:
    """Collects little-endian bit fields."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts, most: int = 12) -> list[int]:
    """Lengths of a Huffman code, `most` bits at most; a lone symbol has length 1."""
    counts = list(counts)
    while True:
        leaves = sorted((n, k) for k, n in enumerate(counts) if n)
        out = [0] * len(counts)
        if len(leaves) < 2:
            for _, k in leaves:
                out[k] = 1
            return out
        m = len(leaves)  # nodes: leaves by count, then pairs as they are made, whose counts never fall
        weights, above = [n for n, _ in leaves], [0] * (2 * m)
        end = weights[-1] * m + sum(weights) + 1
        weights.append(end)
        pairs, i, j = [], 0, 0
        for new in range(m, 2 * m - 1):
            total = 0
            for _ in (0, 1):
                if j < len(pairs) and pairs[j] < weights[i]:
                    total += pairs[j]
                    above[m + j] = new
                    j += 1
                else:
                    total += weights[i]
                    above[i] = new
                    i += 1
            pairs.append(total)
        depth = [0] * (2 * m)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        for k, (_, s) in enumerate(leaves):
            out[s] = depth[k]
        if max(out, default=0) <= most:
            return out
        counts = [n and (n >> 1) + 1 for n in counts]  # flatter


# The code of code lengths is the same for all: 4 bits for each of the lengths 0 to 12 and the three repeats.
_SAID = {s: (code, n) for s, code, n in canonical([4] * 13 + [0] * 3 + [4] * 3)}


def put_code(out: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Writes a prefix code; returns symbol -> (code, bits)."""
    used = [k for k, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(used[0], 8)
        return {used[0]: (0, 0)}
    out.put(0, 1)
    out.put(19 - 4, 4)
    for k in LENGTH_ORDER:
        out.put(4 if k in _SAID else 0, 3)
    out.put(0, 1)  # all symbols' lengths follow
    value = size = at = 0
    for k in [*used, len(lengths)]:
        while k - at >= 3:
            run = min(k - at, 138)
            code, n, extra, least = (*_SAID[18], 7, 11) if run >= 11 else (*_SAID[17], 3, 3)
            value |= (code | run - least << n) << size
            size += n + extra
            at += run
        for x in lengths[at : k + 1]:
            code, n = _SAID[x]
            value |= code << size
            size += n
        at = k + 1
    out.put(value, size)
    if len(used) == 1:
        return {used[0]: (0, 0)}
    return {s: (code, n) for s, code, n in canonical(lengths)}


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, how many) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    return 2 * top + ((v >> (top - 1)) & 1), v & ((1 << (top - 1)) - 1), top - 1


def put_pixels(out: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, refer: bool = False) -> None:
    """An entropy-coded image; refer: with back-references by a table of three pixels."""
    cache, tokens, seen = [None] * (1 << cache_bits), [], {}
    k = 0

    def enter(x: int) -> None:
        if cache_bits:
            cache[(CACHE_MULTIPLIER * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x

    near = {}
    for n, (x, y) in enumerate(NEAR if refer else []):
        near.setdefault(max(1, x + y * width), n + 1)
    while k < len(pixels):
        x, n, back = pixels[k], 0, seen.get(tuple(pixels[k : k + 3])) if refer else None
        if back is not None:
            while k + n < len(pixels) and n < 4096 and pixels[back + n] == pixels[k + n]:
                n += 1
        if n >= 3:
            tokens.append(("copy", n, near.get(k - back, k - back + 120)))
        elif cache_bits and cache[h := (CACHE_MULTIPLIER * x & 0xFFFFFFFF) >> (32 - cache_bits)] == x:
            n = 1
            tokens.append(("cache", h, 0))
        else:
            n = 1
            tokens.append(("pixel", x, 0))
        for j in range(k, k + n):
            seen[tuple(pixels[j : j + 3])] = j
            enter(pixels[j])
        k += n
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    counts = [[0] * s for s in sizes]
    for kind, a, b in tokens:
        if kind == "pixel":
            for c, shift in enumerate((8, 16, 0, 24)):
                counts[c][(a >> shift) & 255] += 1
        elif kind == "cache":
            counts[0][280 + a] += 1
        else:
            counts[0][256 + prefix_of(a)[0]] += 1
            counts[4][prefix_of(b)[0]] += 1
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    for c in counts:
        if not any(c):
            c[0] = 1
    codes = [put_code(out, code_lengths(c)) for c in counts]
    for kind, a, b in tokens:
        if kind == "pixel":
            for c, shift in enumerate((8, 16, 0, 24)):
                out.put(*codes[c][(a >> shift) & 255])
        elif kind == "cache":
            out.put(*codes[0][280 + a])
        else:
            s, extra, n = prefix_of(a)
            out.put(*codes[0][256 + s])
            out.put(extra, n)
            s, extra, n = prefix_of(b)
            out.put(*codes[4][s])
            out.put(extra, n)


def put_head(out: Writer, width: int, height: int) -> None:
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)


def riff(stream: bytes, more: bytes = b"") -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1) + more
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode(pixels: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, refer: bool = True, tile: int = 2) -> bytes:
    """A lossless WebP file of ARGB pixels, with the transforms asked for (modes and multipliers by tile)."""
    height, width = pixels.shape
    out = Writer()
    put_head(out, width, height)
    pixels = pixels.astype(np.int64)
    if palette:
        colours = np.unique(pixels)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        c = channels(colours)
        put_pixels(out, packed(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64))).tolist(), len(colours), False)
        share = palette_bits(len(colours))
        index = np.searchsorted(colours, pixels)
        index = np.pad(index, ((0, 0), (0, -width % (1 << share)))).reshape(height, -1, 1 << share)
        pixels = (index << (np.arange(1 << share) * (8 >> share))).sum(-1) << 8 | 255 << 24
        width = pixels.shape[1]
    if predictor is not None:
        c = channels(pixels)
        rest = np.array([[(c[y, x] - _around(c, y, x, int(predictor[y >> tile, x >> tile]))) & 255 for x in range(width)] for y in range(height)])
        pixels = packed(rest)
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(tile - 2, 3)
        put_pixels(out, (predictor.astype(np.int64) << 8 | 255 << 24).ravel().tolist(), predictor.shape[1], False)
    if cross is not None:
        c, t = channels(pixels), _spread(channels(cross), tile, pixels.shape)
        changed = c.copy()
        changed[..., 1] = (c[..., 1] - _delta(t[..., 3], c[..., 2])) & 255
        changed[..., 3] = (c[..., 3] - _delta(t[..., 2], c[..., 2]) - _delta(t[..., 1], c[..., 1])) & 255
        pixels = packed(changed)
        out.put(1, 1)
        out.put(CROSS_COLOUR, 2)
        out.put(tile - 2, 3)
        put_pixels(out, cross.astype(np.int64).ravel().tolist(), cross.shape[1], False)
    if green:
        c = channels(pixels)
        c[..., 1] -= c[..., 2]
        c[..., 3] -= c[..., 2]
        pixels = packed(c)
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
    out.put(0, 1)
    put_pixels(out, pixels.ravel().tolist(), width, True, cache_bits, refer)
    return riff(out.value.to_bytes((out.n + 7) // 8, "little"))
