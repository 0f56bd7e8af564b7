"""Lossless WebP (VP8L): a decoder of the whole format to pixel arrays; payloads stored as WebP and read back.

The decoder follows the public specification of the WebP lossless bitstream: prefix codes (simple and normal, with meta codes
by tile), back-references with the two-dimensional distance map, the colour cache, and the inverses of the
predictor, cross-colour, subtract-green and palette (with pixel bundling) transforms.

An image with one group of codes is read by numpy: what a token at each bit position would be, and where the one after it
begins, is looked up for all positions at once; the true positions are then walked from the first, literals are put
in their places together, and references and cache hits are resolved in order. Images whose codes all have one length and
refer to nothing are unpacked at once; those with several groups are read symbol by symbol. The writer is in
webp_writer.py.

Null texts are empty; texts are stored whole, whatever their length, as one file for each 16,384 rows of 192 bytes. Equal
texts have equal files and values; rows that repeat, or lack an id, are stored each. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import small_batches, trimmed, written

WIDTH = 64
ROW = 3 * WIDTH
MOST_ROWS = 16384

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
#: Near neighbours by distance, then by |x|, the right one before the left: what distance codes 1 to 120 stand for.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: Order of table entries when the first bit of a code is the lowest of its index, by the bits of the index.
_order: dict[int, np.ndarray] = {}


def _reversed(n: int) -> np.ndarray:
    if n not in _order:
        x = np.arange(1 << n)
        _order[n] = sum(((x >> k) & 1) << (n - 1 - k) for k in range(n)) if n else x
    return _order[n]


class Bits:
    """Reads bits, the least significant of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


class Code:
    """A prefix code from its lengths (symbol -> bits); `symbols` in order and `width` if all have one length."""

    def __init__(self, lengths: dict[int, int]):
        self.symbols = sorted(lengths)
        self.lengths = lengths
        self.width: int | None = None
        self.listed: tuple[list, list, int] | None = None
        self.arrays: tuple[np.ndarray, np.ndarray, int] | None = None
        if len(lengths) == 1:
            self.width = 0
            return
        sizes = set(lengths.values())
        if len(sizes) == 1 and len(lengths) == 1 << next(iter(sizes)):
            self.width = next(iter(sizes))
        if sum(1 << (15 - n) for n in lengths.values()) != 1 << 15:
            raise ValueError("incomplete prefix code")

    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """For what the next bits can be, the symbol and its length; and how many bits are looked at."""
        if self.arrays is None:
            self.arrays = self._table()
        return self.arrays

    def _table(self) -> tuple[np.ndarray, np.ndarray, int]:
        if self.width == 0:
            return np.array(self.symbols, np.int16), np.zeros(1, np.uint8), 0
        symbol, size = np.array(self.symbols), np.array([self.lengths[s] for s in self.symbols])
        by_size = np.argsort(size, kind="stable")
        symbol, size = symbol[by_size], size[by_size]
        most = int(size[-1])
        spans, order = 1 << (most - size), _reversed(most)
        return np.repeat(symbol.astype(np.int16), spans)[order], np.repeat(size.astype(np.uint8), spans)[order], most

    def read(self, bits: Bits) -> int:
        if self.width == 0:
            return self.symbols[0]
        if self.listed is None:
            symbols, sizes, most = self.table()
            self.listed = symbols.tolist(), sizes.tolist(), most
        symbols, sizes, most = self.listed
        at = bits.peek(most)
        bits.at += sizes[at]
        return symbols[at]


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + [bits.read(8) for _ in range(two)]
        return Code(dict.fromkeys(symbols, 1))
    count = 4 + bits.read(4)
    own = {s: n for s in LENGTH_ORDER[:count] if (n := bits.read(3))}
    left = alphabet
    lengths_code = Code(own)
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    values, sizes, most = lengths_code.table()
    values, sizes, mask = values.tolist(), sizes.tolist(), (1 << most) - 1
    # Fourteen bits at most for each token, of which there are `left` at most.
    byte = bits.at >> 3
    ahead, at = int.from_bytes(bits.data[byte : byte + 2 * left + 8], "little"), bits.at & 7
    lengths: dict[int, int] = {}
    symbol, before = 0, 8
    while symbol < alphabet and left:
        left -= 1
        k = ahead >> at & mask
        n = values[k]
        at += sizes[k]
        if n < 16:
            if n:
                lengths[symbol] = before = n
            symbol += 1
        elif n == 16:
            for _ in range(3 + (ahead >> at & 3)):
                lengths[symbol] = before
                symbol += 1
            at += 2
        elif n == 17:
            symbol += 3 + (ahead >> at & 7)
            at += 3
        else:
            symbol += 11 + (ahead >> at & 127)
            at += 7
    bits.at = 8 * byte + at
    return Code(lengths)


def _number(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Groups of codes read lately: their bits as a number, how many, and the codes. Many images have the same.
_groups: list[tuple[int, int, int, list[Code]]] = []
KEPT_GROUPS = 4


def _read_group(bits: Bits, cache_bits: int) -> list[Code]:
    byte, phase = bits.at >> 3, bits.at & 7
    for k, (own, size, cache, codes) in enumerate(_groups):
        if cache == cache_bits and int.from_bytes(bits.data[byte : byte + ((phase + size + 7) >> 3)], "little") >> phase & ((1 << size) - 1) == own:
            bits.at += size
            _groups.insert(0, _groups.pop(k))
            return codes
    start = bits.at
    codes = [_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    size = bits.at - start
    own = int.from_bytes(bits.data[byte : byte + ((phase + size + 7) >> 3)], "little") >> phase & ((1 << size) - 1)
    _groups.insert(0, (own, size, cache_bits, codes))
    del _groups[KEPT_GROUPS:]
    return codes


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as ARGB numbers, row after row, of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tile, tiles, per_row = 0, np.zeros(1, np.int64), 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        per_row = -(-width >> tile)
        tiles = (_image(bits, per_row, -(-height >> tile), False).astype(np.int64) >> 8) & 0xFFFF
    groups = [_read_group(bits, cache_bits) for _ in range(int(tiles.max()) + 1)]
    n = width * height
    green, red, blue, alpha, _ = groups[0]
    if len(groups) == 1 and not cache_bits and all(c.width is not None for c in groups[0][:4]) and green.symbols[-1] < 256:
        total = sum(c.width for c in groups[0][:4])
        start = bits.at
        bits.at += n * total
        raw = np.frombuffer(bits.data, np.uint8, offset=start >> 3)
        flags = np.unpackbits(raw[: ((start & 7) + n * total + 7) >> 3], bitorder="little")[start & 7 :][: n * total].reshape(n, total)
        parts, at = [], 0
        for c in (green, red, blue, alpha):
            index = np.zeros(n, np.int64)
            for k in range(c.width):
                index = index << 1 | flags[:, at + k]
            at += c.width
            parts.append(np.asarray(c.symbols, np.uint32)[index])
        return parts[3] << 24 | parts[1] << 16 | parts[0] << 8 | parts[2]
    if len(groups) == 1:
        return _by_position(bits, groups[0], cache_bits, width, n)
    return _by_symbol(bits, groups, cache_bits, width, n, tiles, tile, per_row)


def _by_position(bits: Bits, codes: list[Code], cache_bits: int, width: int, n: int) -> np.ndarray:
    green, red, blue, alpha, distance = (c.table() for c in codes)
    # A token takes 15 bits a channel, or two symbols and 28 more bits, at most.
    raw = np.frombuffer(bits.data, np.uint8, offset=bits.at >> 3)[: n * 8 + 16]
    start, total = bits.at & 7, 8 * len(raw)
    raw = np.concatenate([raw, np.zeros(16, np.uint8)]).astype(np.int64)
    wide = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    ahead = (wide[:, None] >> np.arange(8)).ravel()  # at each position the next 24 bits, and more
    index = ahead[:total] & ((1 << green[2]) - 1)
    symbol = green[0].take(index)
    after = np.arange(total) + green[1].take(index)
    ends = after
    places = []
    for symbols, sizes, most in (red, blue, alpha):
        places.append(ends)
        if most:
            ends = ends + sizes.take(ahead.take(ends) & ((1 << most) - 1))
    count = np.ones(total, np.int64)
    special = np.flatnonzero(symbol >= 256)
    if len(special):
        ends = ends.copy() if ends is after else ends
        ends[special] = after[special]
        refs = special[symbol[special] < 280]
        length, at = _numbers_at(ahead, after[refs], symbol[refs] - 256)
        code = distance[0][ahead[at] & ((1 << distance[2]) - 1)]
        at = at + distance[1][ahead[at] & ((1 << distance[2]) - 1)]
        far, at = _numbers_at(ahead, at, code)
        ends[refs], count[refs] = at, length
        distances = np.zeros(total, np.int64)
        distances[refs] = far
    follow, many = memoryview(np.ascontiguousarray(ends)), memoryview(count)
    path, done, p = [], 0, start
    add = path.append
    try:
        while done < n:
            add(p)
            done += many[p]
            p = follow[p]
    except IndexError:
        raise ValueError("the image breaks off") from None
    bits.at += p - start
    at = np.array(path)
    kind, sizes = symbol[at], count[at]
    first = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.uint32)
    plain = kind < 256
    own = at[plain]
    value = kind[plain].astype(np.uint32) << 8
    for (symbols, _, most), place, shift in zip((red, blue, alpha), places, (16, 0, 24)):
        got = symbols[ahead[place[own]] & ((1 << most) - 1)] if most else symbols[0]
        value |= np.asarray(got, np.uint32) << np.uint32(shift)
    out[first[plain]] = value
    rest = np.flatnonzero(~plain)
    if len(rest):
        spans = np.minimum(sizes[rest], n - first[rest]).tolist()
        far = np.where(kind[rest] < 280, distances[at[rest]], 0).tolist()
        _resolve(out, first[rest].tolist(), spans, far, (kind[rest] - 280).tolist(), cache_bits, width)
    return out


def _numbers_at(ahead: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols and the extra bits at these positions; and where those end."""
    prefix = prefix.astype(np.int64)
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + (ahead[at] & ((np.int64(1) << extra) - 1)) + 1, at + extra


def _reach(code: int, width: int) -> int:
    """How many pixels back a distance code leads."""
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _resolve(out: np.ndarray, first: list, spans: list, codes: list, slots: list, cache_bits: int, width: int) -> None:
    """Fills in references (codes > 0) and cache hits, in order; literals are in their places."""
    if not cache_bits:
        for at, span, code in zip(first, spans, codes):
            far = _reach(code, width)
            if far > at:
                raise ValueError("a reference before the image's start")
            while span > 0:  # what has been copied can be copied again
                take = min(span, far)
                out[at : at + take] = out[at - far : at - far + take]
                at, span, far = at + take, span - take, far + take
        return
    shift = np.uint64(32 - cache_bits)
    slot = ((out.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> shift).tolist()
    px = out.tolist()
    cache = [0] * (1 << cache_bits)
    put = 0  # pixels that the cache has seen
    for at, span, code, own in zip(first, spans, codes, slots):
        if code:
            far = _reach(code, width)
            if far > at:
                raise ValueError("a reference before the image's start")
            for k in range(at, at + span):
                px[k], slot[k] = px[k - far], slot[k - far]
        else:
            for k in range(put, at):
                cache[slot[k]] = px[k]
            put = at
            px[at], slot[at] = cache[own], own
    out[:] = px


def _by_symbol(bits: Bits, groups: list, cache_bits: int, width: int, n: int, tiles: np.ndarray, tile: int, per_row: int) -> np.ndarray:
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    put = 0  # pixels that the cache has seen
    while len(out) < n:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, distance = groups[int(tiles[(y >> tile) * per_row + (x >> tile)])]
        symbol = green.read(bits)
        if symbol < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | symbol << 8 | b)
        elif symbol < 280:
            length = _number(bits, symbol - 256)
            far = _reach(_number(bits, distance.read(bits)), width)
            if far > len(out):
                raise ValueError("a reference before the image's start")
            for _ in range(min(length, n - len(out))):
                out.append(out[-far])
        else:
            while put < len(out):
                cache[(CACHE_FACTOR * out[put] & 0xFFFFFFFF) >> shift] = out[put]
                put += 1
            out.append(cache[symbol - 280])
    return np.asarray(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB numbers as columns alpha, red, green, blue."""
    return np.ascontiguousarray(pixels).astype(">u4").view(np.uint8).reshape(-1, 4).astype(np.int64)


def numbers(channels: np.ndarray) -> np.ndarray:
    return (channels & 0xFF).astype(np.uint8).view(">u4").ravel().astype(np.uint32)


def _predicted(mode: int, left, top, top_left, top_right) -> list[int]:
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda v: [min(255, max(0, x)) for x in v]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        near_left = sum(abs(t - c) for t, c in zip(top, top_left))
        near_top = sum(abs(x - c) for x, c in zip(left, top_left))
        return left if near_left < near_top else top
    if mode == 12:
        return clamp([x + t - c for x, t, c in zip(left, top, top_left)])
    if mode == 13:
        return clamp([m + int((m - c) / 2) for m, c in zip(mean(left, top), top_left)])
    return [255, 0, 0, 0]


def _unpredict(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Row by row: one that looks up (or left) alone is summed at once, others pixel by pixel."""
    rest = channels(pixels).reshape(-1, width, 4)
    per_row = -(-width >> bits)
    modes = ((modes >> 8) & 0xF).reshape(-1, per_row)
    out = np.zeros_like(rest)
    for y, own in enumerate(rest):
        row = modes[y >> bits]
        if y and (row == row[0]).all() and row[0] in (0, 2, 3, 4, 8, 9):
            top = out[y - 1]
            above_left, above_right = np.vstack([top[:1], top[:-1]]), np.vstack([top[1:], (own[:1] + top[:1]) & 0xFF])
            black = np.zeros_like(top) + (255, 0, 0, 0)
            guess = {0: black, 2: top, 3: above_right, 4: above_left, 8: (above_left + top) >> 1, 9: (top + above_right) >> 1}[int(row[0])].copy()
            guess[0] = top[0]
            out[y] = (own + guess) & 0xFF
        elif not y or (row == 1).all():
            own = own.copy()
            own[0] += out[y - 1, 0] if y else (255, 0, 0, 0)
            out[y] = own.cumsum(0) & 0xFF
        else:
            out[y] = _unpredict_row(own.tolist(), out[y - 1].tolist(), row.tolist(), bits)
    return numbers(out.reshape(-1, 4))


def _unpredict_row(own: list, top: list, modes: list, bits: int) -> list:
    out = [[(a + b) & 0xFF for a, b in zip(own[0], top[0])]]
    for x in range(1, len(own)):
        above_right = top[x + 1] if x + 1 < len(top) else out[0]
        guess = _predicted(modes[x >> bits], out[x - 1], top[x], top[x - 1], above_right)
        out.append([(a + b) & 0xFF for a, b in zip(own[x], guess)])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _uncross(pixels: np.ndarray, width: int, factors: np.ndarray, bits: int) -> np.ndarray:
    c = channels(pixels)
    y, x = np.divmod(np.arange(len(pixels)), width)
    f = channels(factors)[(y >> bits) * -(-width >> bits) + (x >> bits)]
    green = signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (signed(f[:, 3]) * green >> 5)) & 0xFF
    c[:, 3] += (signed(f[:, 2]) * green >> 5) + (signed(f[:, 1]) * signed(c[:, 1]) >> 5)
    return numbers(c)


def _unindex(pixels: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    shift = bundle(len(table))
    index = (pixels.reshape(height, -1) >> 8) & 0xFF
    if shift:
        size = 8 >> shift
        x = np.arange(width)
        index = (index[:, x >> shift] >> (size * (x & ((1 << shift) - 1)))) & ((1 << size) - 1)
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[index.ravel()]


def bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes (red, green, blue, alpha) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo = []
    now = width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            size = bits.read(3) + 2
            plane = _image(bits, -(-now >> size), -(-height >> size), False)
            undo.append((kind, now, plane, size))
        elif kind == 2:
            undo.append((kind, now, None, 0))
        else:
            count = bits.read(8) + 1
            table = numbers(channels(_image(bits, count, 1, False)).cumsum(0))
            undo.append((kind, now, table, 0))
            shift = bundle(count)
            now = (now + (1 << shift) - 1) >> shift
    pixels = _image(bits, now, height, True)
    for kind, w, plane, size in reversed(undo):
        if kind == 0:
            pixels = _unpredict(pixels, w, plane, size)
        elif kind == 1:
            pixels = _uncross(pixels, w, plane, size)
        elif kind == 2:
            green = (pixels >> 8) & 0xFF
            pixels = (pixels & 0xFF00FF00) | (((pixels >> 16) + green & 0xFF) << 16) | ((pixels + green) & 0xFF)
        else:
            pixels = _unindex(pixels, w, height, plane)
    if not has_alpha:
        pixels = pixels | np.uint32(BLACK)
    return np.stack([pixels >> 16, pixels >> 8, pixels, pixels >> 24], axis=1).astype(np.uint8).reshape(height, width, 4)


def pixels(media: bytes) -> np.ndarray:
    """What `store` wrote, as rows x 64 x 4 bytes."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append(decode(media[at : at + size]))
        at += size
    return np.concatenate(parts)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in bytes, and the bytes with spaces up to whole rows, one at least."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")


def feature(image: np.ndarray) -> str:
    """Rows; mean of each channel and of the step to the right neighbour, in hundredths; a 16-bin histogram of green."""
    rgb = image[:, :, :3].astype(np.int64)
    n = image.shape[0] * image.shape[1]
    means = rgb.sum((0, 1)) * 100 // n
    step = int(np.abs(np.diff(rgb[:, :, 1], axis=1)).sum()) * 100 // n
    bins = np.bincount(image[:, :, 1].ravel() >> 4, minlength=16) * 1000 // n
    return f"{image.shape[0]};{','.join(map(str, means))};{step};{','.join(map(str, bins))}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from airlens.llm.webp_writer import store

    for batch in batches:
        got = [padded(x) for x in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([store(p) for _, p in got], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as WebP files."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(_store), "doc_id long, n_bytes long, media binary")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = [None if x is None else pixels(x) for x in batch.column("media").to_pylist()]
        columns = [
            pa.array([None if x is None else x.shape[1] for x in images], pa.int32()),
            pa.array([None if x is None else x.shape[0] for x in images], pa.int32()),
            pa.array([None if x is None else x.tobytes() for x in images], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "width", "height", "rgba"])


def pixel_arrays(stored: DataFrame) -> DataFrame:
    """doc_id, width, height, rgba (rows of four bytes a pixel) of any lossless WebP files in `media`; null for null."""
    small_batches(stored.sparkSession)
    return stored.select("doc_id", "media").mapInArrow(trimmed(_arrays), "doc_id long, width int, height int, rgba binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
            image = pixels(stored)
            back = image[:, :, :3].tobytes()
            rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _DIGEST.split(", ")])


def digests(docs: DataFrame) -> DataFrame:
    """Writes every text's padded bytes as a table of WebP files, reads that table into pixel arrays, and describes both."""
    stored = written(media(docs), "media")
    return stored.mapInArrow(trimmed(_digest), _DIGEST)
