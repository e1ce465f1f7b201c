"""Media columns: texts stored as lossless WebP images, read back into pixel arrays and described by features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.llm import webp
from lexmill.llm.common import blocks_of, utf8

UNIT = 576  #: payloads are padded to a multiple of so many bytes
WIDEST, HIGHEST = 16384, 16384
BUNDLED = 16  #: palettes of so few colours put several pixels into one; texts with so few bytes go without
CACHE_BITS, OFTEN = 8, 16  #: size of colour caches, and how often a value comes at least that is looked up there
CACHED = 512  #: marks samples that came from the cache
TILE = 9  #: log2 of the side of a predictor's tiles, the largest: an image has one mode
FEW = 64  #: lanes below which images are decoded one by one


def most_bytes() -> int:
    """Bytes of the largest payload that fits one image."""
    return WIDEST // UNIT * UNIT * HIGHEST


def shape_of(n: int) -> tuple[int, int]:
    """Width and height of the image of an n-byte payload: UNIT wide, wider only if it would be too high."""
    k = -(-n // (UNIT * HIGHEST))
    if UNIT * k > WIDEST:
        raise ValueError("a payload that is too large for an image")
    return UNIT * k, -(-n // (UNIT * k))


@lru_cache(64)
def _slots(bits: int, around: int) -> np.ndarray:
    """Places in a colour cache of so many bits of the pixels with green samples 0 to 255, the other channels as in around."""
    return ((np.arange(256, dtype=np.uint64) << np.uint64(8) | np.uint64(around)) * np.uint64(webp.CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


SLOTS = _slots(CACHE_BITS, 0).astype(np.int64)


def residuals(index: np.ndarray, mode: int) -> np.ndarray:
    """What a predictor mode leaves of an image of green samples: 0 (none), 1 (left) or 2 (above), edges by the format."""
    out = index.copy()
    out[0, 1:] -= index[0, :-1]
    out[1:, 0] -= index[:-1, 0]
    if mode == 1:
        out[1:, 1:] -= index[1:, :-1]
    elif mode == 2:
        out[1:, 1:] -= index[:-1, 1:]
    return out


def restored(rest: np.ndarray, mode: int) -> np.ndarray:
    """The inverse of residuals()."""
    out = rest.copy()
    if mode == 2:
        out[0] = np.cumsum(rest[0], dtype=np.uint8)
        return np.cumsum(out, 0, dtype=np.uint8)
    out[:, 0] = np.cumsum(rest[:, 0], dtype=np.uint8)
    if mode == 1:
        return np.cumsum(out, 1, dtype=np.uint8)
    out[0] = np.cumsum(rest[0], dtype=np.uint8)
    return out


def _tokens(rest: np.ndarray) -> np.ndarray:
    """Symbols of pixels with green samples as in rest: a literal at the first place of a value, its place in the colour
    cache at later ones. Rare values and those that share a place with others are literals throughout."""
    counts = np.bincount(rest, minlength=256)
    used = np.flatnonzero(counts)
    sole = np.bincount(SLOTS[used], minlength=1 << CACHE_BITS)[SLOTS] == 1
    cached = np.flatnonzero(sole & (counts >= OFTEN))
    as_symbol = np.arange(256)
    as_symbol[cached] = 280 + SLOTS[cached]
    out = as_symbol[rest]
    first = np.zeros(256, np.int64)
    first[rest[::-1]] = np.arange(len(rest) - 1, -1, -1)  # the last one written is the first place
    out[first[cached]] = cached
    return out


@lru_cache(4096)
def _palette(rows: tuple[int, ...]) -> tuple[int, int]:
    """The bits, and how many, of a palette transform with the 16 bytes of each row (by their upper halves) in order."""
    used = [16 * r + k for r in rows for k in range(16)]
    out = webp.Writer()
    out.put(1, 1)
    out.put(webp.PALETTE, 2)
    out.put(len(used) - 1, 8)
    webp.put_pixels(out, [(b - a) << 8 | (0 if k else 255 << 24) for k, (a, b) in enumerate(zip([0, *used], used))], len(used), False, refer=True)
    return out.value, out.n


@lru_cache(64)
def _predictor(mode: int, width: int, height: int) -> tuple[int, int]:
    """The bits, and how many, of a predictor transform with one mode in so many tiles."""
    out = webp.Writer()
    out.put(1, 1)
    out.put(webp.PREDICTOR, 2)
    out.put(TILE - 2, 3)
    webp.put_pixels(out, [255 << 24 | mode << 8] * (width * height), width, False)
    return out.value, out.n


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """WebP files of the padded payloads of rows: a byte is a pixel's green sample, alpha 255, red and blue 0.

    Each image (unless it has few colours) has a palette transform, of all bytes that share their upper half with one of
    the image's (so that palettes are few), a predictor transform over the palette's indices in the mode that leaves the least, and a colour cache; all have a prefix code of their own. Equal pixels at the end are
    back-references. Red and blue are constant, so cross-colour and subtract-green have nothing to take from them. Codes
    of all rows' symbols are looked up and packed into bits together.
    """
    rows = len(offsets) - 1
    wide = 280 + (1 << CACHE_BITS)
    codes, sizes = np.zeros((rows, wide), np.uint32), np.zeros((rows, wide), np.uint8)
    heads, tails, pads, bodies = [], [], [], []
    for k in range(rows):
        n = int(offsets[k + 1] - offsets[k])
        payload = -(-max(n, 1) // UNIT) * UNIT
        width, height = shape_of(payload)
        total = width * height
        image = np.full(total, 255, np.uint8)
        image[:n] = data[offsets[k] : offsets[k + 1]]
        counted = np.bincount(image, minlength=256)
        out = webp.Writer()
        webp.put_head(out, width, height)
        rich = np.count_nonzero(counted) > BUNDLED
        if rich:
            rows_of = counted.reshape(16, 16).any(1).nonzero()[0]
            used = (rows_of[:, None] * 16 + np.arange(16)).ravel()
            out.put(*_palette(tuple(rows_of.tolist())))
            rank = np.zeros(256, np.uint8)
            rank[used] = np.arange(len(used))
            index = rank[image].reshape(height, width)
            tried = [(m, residuals(index, m).ravel()) for m in ((0, 1, 2) if height > 1 else (1,))]
            mode, image = max(tried, key=lambda x: int((np.bincount(x[1]) ** 2).sum()))  # the fewest values in the most places
            out.put(*_predictor(mode, -(-width >> TILE), -(-height >> TILE)))
        other = np.flatnonzero(image != image[-1])
        left = total - 1 - (int(other[-1]) + 1 if len(other) else 0)  # pixels after the first of the last run
        if left < 3:
            left = 0
        body = image[: total - left]
        body = _tokens(body) if rich else body.astype(np.int64)
        counts = np.bincount(body, minlength=wide if rich else 280).tolist()
        copy = []
        while left > 0:
            step = min(left, 4096)
            copy.append(webp.prefix_of(step))
            counts[256 + copy[-1][0]] += 1
            left -= step
        out.put(0, 1)  # no other transform
        if rich:
            out.put(1 | CACHE_BITS << 1, 5)
        else:
            out.put(0, 1)
        out.put(0, 1)  # one group of codes
        of = webp.put_code(out, webp.code_lengths(counts))
        for only in (0, 0, 0 if rich else 255, 1 if copy else 0):  # red, blue, alpha (none left by the predictor); the distance code 2 is the pixel to the left
            out.put(0b101 | only << 3, 11)  # a simple code of one symbol of 8 bits
        at = list(of)
        codes[k, at], sizes[k, at] = [c for c, _ in of.values()], [n for _, n in of.values()]
        tail = webp.Writer()
        for s, extra, size in copy:
            tail.put(*of[256 + s])
            tail.put(extra, size)
        heads.append(out)
        tails.append(tail)
        bodies.append(body)
        pads.append(payload if total > payload else 0)
    lengths = np.array([len(x) for x in bodies], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(rows) * wide, lengths) + (np.concatenate(bodies) if rows else np.zeros(0, np.int64))
    size = sizes.ravel()[owner].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    body = at[ends] - at[ends - lengths]
    head = np.array([h.n for h in heads], np.int64)
    words = (head + body + np.array([t.n for t in tails], np.int64) + 31) // 32 + 1
    base = (np.cumsum(words) - words) * 32
    where = at[:-1] + np.repeat(base + head - at[ends - lengths], lengths)
    value = codes.ravel()[owner].astype(np.uint64) << (where & 31).astype(np.uint64)
    word = where >> 5
    out = np.zeros(int(words.sum()) + 1, np.uint32)
    if len(word):
        first = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        # Bits of different symbols never meet, so sums are unions.
        out[word[first]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
        out[word[first] + 1] += np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
    raw = out.view(np.uint8)
    files = []
    for k in range(rows):
        start, end = int(base[k]) // 8, int(head[k] + body[k])
        stream = bytearray(raw[start : start + int(words[k]) * 4].tobytes())
        _add(stream, heads[k].value, 0)
        _add(stream, tails[k].value, end)
        stream = bytes(stream[: (end + tails[k].n + 7) // 8])
        files.append(webp.riff(stream, b"size" + struct.pack("<IQ", 8, pads[k]) if pads[k] else b""))
    return files


def _add(stream: bytearray, value: int, at: int) -> None:
    value <<= at & 7
    for k, b in enumerate(value.to_bytes((value.bit_length() + 7) // 8, "little"), at >> 3):
        stream[k] |= b


def payload_size(file: bytes, pixels: int) -> int:
    """Bytes of the payload in a file of so many pixels: all, unless a chunk of its own says fewer."""
    n = struct.unpack_from("<I", file, 16)[0]
    at = 20 + n + (n & 1)
    return struct.unpack_from("<Q", file, at + 8)[0] if file[at : at + 4] == b"size" else pixels


class _Lane:
    """A plain stream that the batch decoder takes: no groups, no transforms but a palette of single pixels and then a predictor
    of one mode (0 to 2) throughout; red, blue, alpha and distance fixed; a cache each of whose used places is of one literal.

    table: the next bits -> symbol << 4 | length, where a place in the cache stands as CACHED | the literal it holds.
    """

    def __init__(self, file: bytes):
        self.stream = webp.stream_of(file)
        self.bits, self.width, self.height = webp.head(self.stream)
        self.n = self.width * self.height
        self.plain = self.cache = False
        self.palette = self.mode = None
        if self.bits.read(1):
            if self.bits.read(2) != webp.PALETTE or (n := self.bits.read(8) + 1) <= BUNDLED:
                return
            steps = np.array(webp.small_pixels(self.bits, n, 1), np.int64)
            self.palette = np.zeros(256, np.uint8)
            self.palette[:n] = np.cumsum(steps >> 8 & 255) & 255
            if self.bits.read(1):
                if self.bits.read(2) != webp.PREDICTOR:
                    return
                tile = self.bits.read(3) + 2
                modes = {x >> 8 & 15 for x in webp.small_pixels(self.bits, -(-self.width >> tile), -(-self.height >> tile))}
                self.mode = modes.pop()
                if modes or self.mode > 2 or self.bits.read(1):
                    return
        cache = self.bits.read(4) if self.bits.read(1) else 0
        if cache > 11 or self.bits.read(1):
            return
        self.green, *others = (webp.read_code(self.bits, k) for k in (280 + (1 << cache if cache else 0), 256, 256, 256, 40))
        self.plain = all(c.single is not None for c in others) and self.green.bits <= 12
        if self.plain:
            self.back = webp.distance(others[3].single + 1, self.width) if others[3].single < 4 else None
            self.plain = self.back is not None
        self.array = self.green.array
        if cache and self.plain:
            red, blue, alpha = (c.single for c in others[:3])
            symbols = self.array >> 4
            literals = np.flatnonzero(np.bincount(symbols, minlength=256)[:256])
            slots = _slots(cache, alpha << 24 | red << 16 | blue)[literals].astype(np.int64)
            held = np.full(1 << cache, -1)
            held[slots] = literals
            held[np.bincount(slots, minlength=1 << cache) > 1] = -1
            looked = symbols >= 280
            value = held[symbols[looked] - 280]
            self.plain = bool((value >= 0).all())
            self.array = self.array.copy()
            self.array[looked] = (CACHED | value) << 4 | self.array[looked] & 15
            self.cache = True

    def samples(self, greens: np.ndarray) -> np.ndarray | None:
        """The image's green samples from decoded symbols; None if a place in the cache was used before it was filled."""
        out = greens.astype(np.uint8)
        if self.cache:
            first = np.zeros(256, np.int64)
            first[out[::-1]] = np.arange(len(out) - 1, -1, -1)
            if (greens[first[out[first]]] >= CACHED).any() or greens[0] >= CACHED:
                return None
        if self.mode is not None:
            out = restored(out.reshape(self.height, self.width), self.mode).ravel()
        return out if self.palette is None else self.palette[out]


def decode_greens(files: list[bytes]) -> list[np.ndarray]:
    """The green samples of images, row by row. Plain streams advance together, a symbol of each at a time; the last
    few lanes, and streams with any other feature of the format, are decoded one by one."""
    lanes = [_Lane(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    plain = sorted((k for k, lane in enumerate(lanes) if lane.plain), key=lambda k: -lanes[k].n)
    for k, lane in enumerate(lanes):
        if not lane.plain:
            out[k] = ((webp.decode(files[k]) >> 8) & 255).astype(np.uint8).ravel()
    for a in range(0, len(plain), 1 << 12):
        part = plain[a : a + (1 << 12)]
        for k, green in zip(part, _together([lanes[k] for k in part]), strict=True):
            out[k] = lanes[k].samples(green)
            if out[k] is None:
                out[k] = ((webp.decode(files[k]) >> 8) & 255).astype(np.uint8).ravel()
    return out


def _together(lanes: list[_Lane]) -> list[np.ndarray]:
    sizes = np.array([x.n for x in lanes])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    greens = np.zeros(begins[-1] + 1, np.uint16)
    lengths = np.array([len(x.stream) + 8 for x in lanes])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    raw = np.frombuffer(b"".join(x.stream + bytes(8) for x in lanes) + bytes(8), np.uint8).astype(np.uint32)
    next32 = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    width = max(1 << x.green.bits for x in lanes)
    table = np.zeros((len(lanes), width), np.int16)
    for k, x in enumerate(lanes):
        table[k, : x.green.mask + 1] = x.array
    table = table.ravel()
    lane = np.arange(len(lanes))
    at = starts * 8 + np.array([x.bits.at for x in lanes])
    to = begins[:-1].copy()
    end = begins[1:]
    row, mask = lane * width, np.array([x.green.mask for x in lanes], np.uint32)
    while len(lane) > FEW:
        entry = table[row + ((next32[at >> 3] >> (at & 7).astype(np.uint32)) & mask)]
        symbol = entry >> 4
        at += entry & 15
        refers = symbol & 256
        if not refers.any():
            greens[to] = symbol
            to += 1
        else:
            literal = refers == 0
            greens[to[literal]] = symbol[literal]
            to[literal] += 1
            for j in np.flatnonzero(~literal).tolist():
                at[j], to[j] = _copy(lanes[lane[j]], greens, int(symbol[j]), int(at[j]), int(starts[lane[j]]), int(to[j]), int(begins[lane[j]]), int(end[j]))
        going = to < end
        if not going.all():
            lane, at, to, end, row, mask = (v[going] for v in (lane, at, to, end, row, mask))
    for j in range(len(lane)):  # one by one
        x, k = lanes[lane[j]], int(lane[j])
        base, p, n, stop = int(starts[k]), int(at[j]) - int(starts[k]) * 8, int(to[j]), int(end[j])
        words = next32[base : base + int(lengths[k])].tolist()
        entries, m = x.array.tolist(), x.green.mask
        got: list[int] = []
        while n < stop:
            entry = entries[(words[p >> 3] >> (p & 7)) & m]
            p += entry & 15
            symbol = entry >> 4
            if not symbol & 256:
                got.append(symbol)
                n += 1
            else:
                greens[n - len(got) : n] = got
                got = []
                p, n = _copy(x, greens, symbol, p + base * 8, base, n, int(begins[k]), stop)
                p -= base * 8
        greens[n - len(got) : n] = got
    return [greens[begins[k] : begins[k + 1]] for k in range(len(lanes))]


def _copy(lane: _Lane, greens: np.ndarray, symbol: int, at: int, base: int, to: int, begin: int, end: int) -> tuple[int, int]:
    """Carries out a back-reference; returns the next bit and pixel."""
    bits = webp.Bits(lane.stream, at - base * 8)
    n = webp.read_value(bits, symbol - 256)
    d = lane.back
    if to - d < begin or to + n > end:
        raise ValueError("a back-reference outside the image")
    for k in range(0, n, d):
        step = min(d, n - k)
        greens[to + k : to + k + step] = greens[to + k - d : to + k - d + step]
        if d < 64 and k == 0 and n > d:  # doubled from here on
            have = d + step
            while have < n + d:
                more = min(have, n + d - have)
                greens[to - d + have : to - d + have + more] = greens[to - d : to - d + more]
                have += more
            break
    return bits.at + base * 8, to + n


def feature_of(payload: np.ndarray, cells: int = 16) -> str:
    """Means of 16 equal runs of samples as hex, then the spread and the number of distinct samples."""
    means = payload.reshape(cells, -1).sum(1, dtype=np.uint64) // (len(payload) // cells)
    counts = np.bincount(payload, minlength=256)
    mean = counts @ np.arange(256) / len(payload)
    spread = np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(payload))
    return bytes(means.astype(np.uint8)).hex() + f"-{int(spread * 16):04x}-{int((counts > 0).sum()):02x}"


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) as (doc_id, n_bytes, media): each whole text as a lossless WebP file.

    A text is its UTF-8 bytes, null an empty one, padded with bytes 255 to a positive multiple of UNIT. Equal texts have
    equal files; every row counts for itself; an empty table gives an empty one; extra columns are ignored. Texts of up to
    most_bytes() (250 MB) fit one image of the format; longer ones have a null file, and n_bytes tells so.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def work(batches):
        for batch in batches:
            for part in blocks_of(batch, "text", 1 << 22):
                data, offsets = utf8(part.column("text"))
                fits = np.diff(offsets) <= most_bytes()
                if fits.all():
                    files = encode_payloads(data, offsets)
                else:
                    files = [encode_payloads(data[a:b], np.array([0, b - a]))[0] if ok else None for a, b, ok in zip(offsets, offsets[1:], fits)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def describe_media(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) with what the stored files hold, read back: payload digests, sizes and features.

    A null file has null digests.
    """
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    kinds = {"payload_bytes": T.LongType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType()}
    schema = T.StructType([media.schema["doc_id"], media.schema["n_bytes"], *(T.StructField(n, kinds.get(n, T.StringType())) for n, _ in fields)])

    def describe(file: bytes, green: np.ndarray) -> tuple:
        payload = green[: payload_size(file, len(green))]
        raw = payload.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(payload)

    def work(batches):
        for batch in batches:
            for part in blocks_of(batch, "media", 1 << 21):
                files = part.column("media").to_pylist()
                known = [k for k, f in enumerate(files) if f is not None]
                rows: list[tuple] = [(None,) * len(fields)] * len(files)
                for k, green in zip(known, decode_greens([files[k] for k in known]), strict=True):
                    rows[k] = describe(files[k], green)
                columns = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=schema.fieldNames())

    return media.mapInArrow(work, schema)


def pixel_arrays(media: DataFrame) -> DataFrame:
    """media(doc_id, media) as (doc_id, width, height, pixels): any lossless WebP as ARGB numbers, row by row.

    A null or broken file has null columns.
    """
    schema = T.StructType([media.schema["doc_id"], T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.LongType()))])

    def work(batches):
        for batch in batches:
            rows = []
            for file in batch.column("media").to_pylist():
                try:
                    image = webp.decode(file) if file is not None else None
                except (ValueError, IndexError, struct.error):
                    image = None
                rows.append((None, None, None) if image is None else (image.shape[1], image.shape[0], image.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=schema.fieldNames())

    return media.select("doc_id", "media").mapInArrow(work, schema)
