"""Writes 8-bit payloads as lossless WebP: prefix codes of uneven lengths, back-references, a colour cache, and a palette,
predictor, cross-colour or subtract-green transform where an estimate of the coded size says that it pays.

A payload is stored as RGB rows of 64 pixels (192 bytes). Equal runs of three pixels or more are referred to, pixels that
the cache still holds are named by their place there, the rest are literals. Prose is written by codes of fixed lengths
made from a rule (short for common letters), without transforms; for all else counts give the codes.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from airlens.llm.webp import BLACK, CACHE_FACTOR, LENGTH_ORDER, MOST_ROWS, NEAR, ROW, WIDTH, bundle, channels, numbers

LEAST_MATCH, MOST_MATCH, FARTHEST = 3, 4096, 1_000_000
#: Bits of the colour cache that are tried beside none.
CACHE_BITS = 7
#: Log2 of a transform's tile; one setting serves 512 rows.
TILE = 9

_REVERSED = np.zeros(1 << 15, np.uint32)
for _k in range(15):
    _REVERSED |= ((np.arange(1 << 15, dtype=np.uint32) >> _k) & 1) << (14 - _k)
#: Distance code of each near offset in rows of a given width.
_near: dict[int, dict[int, int]] = {}


#: Extra bits of the symbols of the code for lengths.
_EXTRA = np.array([0] * 16 + [2, 3, 7])


class Fields:
    """Numbers of so many bits each, the least significant bit first; arrays of them are added whole."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.close()
        self.parts.append((values, sizes))

    def close(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint32), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self.close()
        values, sizes = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        first = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        return np.packbits((np.repeat(values, sizes) >> within.astype(np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a complete prefix code (Huffman's) over the symbols that occur, `most` at most; 1 for a single symbol."""
    at = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(at) < 2:
        out[at] = 1
        return out
    own = counts[at].astype(np.int64)
    while True:
        order = np.argsort(own, kind="stable")
        weights = own[order].tolist()
        n = len(weights)
        parent, made = [0] * (2 * n - 1), []
        i = j = 0
        for k in range(n, 2 * n - 1):  # the two lightest of the leaves and of the nodes made so far, both in order
            total = 0
            for _ in (0, 1):
                if j >= len(made) or (i < n and weights[i] <= made[j]):
                    total += weights[i]
                    parent[i] = k
                    i += 1
                else:
                    total += made[j]
                    parent[n + j] = k
                    j += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out[at[order]] = depth[:n]
            return out
        own = own // 2 + 1


def code_bits(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, its first bit the least significant."""
    at = np.flatnonzero(lengths)
    order = at[np.lexsort((at, lengths[at]))]
    spans = np.int64(1) << (15 - lengths[order])
    out = np.zeros(len(lengths), np.uint32)
    out[order] = _REVERSED[np.cumsum(spans) - spans]
    return out


def put_code(fields: Fields, counts: np.ndarray, most: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for these counts of symbols; each symbol's bits, and how many. One symbol takes no bits."""
    at = np.flatnonzero(counts).tolist() or [0]
    if len(at) <= 2 and at[-1] < 256:
        fields.put(1, 1)
        fields.put(len(at) - 1, 1)
        fields.put(1, 1)
        for s in at:
            fields.put(s, 8)
        sizes = np.zeros(len(counts), np.int64)
        bits = np.zeros(len(counts), np.uint32)
        if len(at) == 2:
            sizes[at] = 1
            bits[at[1]] = 1
        return bits, sizes
    if len(at) == 1:  # a single symbol from 256 on: a code needs two
        counts = counts.copy()
        counts[0] = 1
    lengths = code_lengths(counts, most)
    tokens: list[int] = []  # symbols of the code for lengths
    extra: list[int] = []  # and what runs of zeros add
    before = -1
    at = np.flatnonzero(lengths)
    for s, n in zip(at.tolist(), lengths[at].tolist()):
        gap, before = s - before - 1, s
        while gap >= 11:
            take = min(gap, 138)
            tokens.append(18)
            extra.append(take - 11)
            gap -= take
        if gap >= 3:
            tokens.append(17)
            extra.append(gap - 3)
        elif gap:
            tokens += [0] * gap
            extra += [0] * gap
        tokens.append(n)
        extra.append(0)
    token = np.array(tokens)
    used = np.bincount(token, minlength=19)
    if np.count_nonzero(used) == 1:  # all of one length: another symbol completes the code
        used[0] = 1
    own = code_lengths(used, 7)
    shown = own.tolist()
    last = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if shown[s]))
    fields.put(0, 1)
    fields.put(last - 4, 4)
    for s in LENGTH_ORDER[:last]:
        fields.put(shown[s], 3)
    fields.put(1, 1)
    wide = next(k for k in range(8) if len(tokens) - 2 < 1 << (2 + 2 * k))
    fields.put(wide, 3)
    fields.put(len(tokens) - 2, 2 + 2 * wide)
    values = np.stack([code_bits(own)[token], np.array(extra, np.uint32)], axis=1)
    fields.put_all(values.ravel(), np.stack([own[token], _EXTRA[token]], axis=1).ravel())
    return code_bits(lengths), lengths


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, their extra bits and how many."""
    v = values.astype(np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    small = v < 4
    extra = np.where(small, 0, top - 1)
    symbol = np.where(small, v, 2 * top + ((v >> np.maximum(extra, 0)) & 1))
    return symbol, np.where(small, 0, v & ((np.int64(1) << extra) - 1)), extra


def near_codes(width: int) -> dict[int, int]:
    if width not in _near:
        found: dict[int, int] = {}
        for k, (x, y) in enumerate(NEAR):
            found.setdefault(max(1, x + y * width), k + 1)
        _near[width] = found
    return _near[width]


def matches(px: np.ndarray) -> list[tuple[int, int, int]]:
    """Where a run of equal pixels begins again: position, length, distance; the nearest equal beginning, greedily."""
    n = len(px)
    if n <= LEAST_MATCH:
        return []
    wide = px.astype(np.uint64)
    key = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + wide[2:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    before = np.full(len(key), -1, np.int64)
    before[order[same + 1]] = order[same]
    out, end = [], 0
    places = np.flatnonzero(before >= 0)
    at = 0
    while at < len(places):
        i = int(places[at])
        if i < end:
            at = int(np.searchsorted(places, end))
            continue
        at += 1
        j = int(before[i])
        if i - j > FARTHEST:
            continue
        length, step, limit = 0, 32, min(n - i, MOST_MATCH)
        while length < limit:
            take = min(step, limit - length)
            apart = np.flatnonzero(px[i + length : i + length + take] != px[j + length : j + length + take])
            if len(apart):
                length += int(apart[0])
                break
            length += take
            step *= 4
        if length >= LEAST_MATCH:
            out.append((i, length, i - j))
            end = i + length
    return out


def cache_slots(px: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot, and whether the slot holds the same pixel when its turn comes."""
    slot = ((px.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(px), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
    return slot, hit


def entropy(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take, and some for their codes; each row of counts is a code."""
    total = counts.sum(-1, keepdims=True)
    used = counts > 0
    several = used.sum(-1, keepdims=True) > 1
    each = np.where(used & several, counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1)) + 4, 0)
    return each.sum(tuple(range(-2, 0))) if counts.ndim > 1 else each.sum()


class Tokens(NamedTuple):
    """An image as literals, cache hits and references: for pixels outside references their places, symbols and whether they
    are literals; for references where they start; prefix symbols, extra bits and their number; counts for each code."""

    at: np.ndarray
    symbol: np.ndarray
    literal: np.ndarray
    channels: tuple[np.ndarray, ...]
    starts: np.ndarray
    span: tuple[np.ndarray, ...]
    place: tuple[np.ndarray, ...]
    counts: list[np.ndarray]


def tokens(px: np.ndarray, width: int, found: list[tuple[int, int, int]], cache_bits: int) -> Tokens:
    starts, lengths, far = np.array(found, np.int64).reshape(-1, 3).T
    at = np.arange(len(px))
    if found:
        covered = np.zeros(len(px) + 1, np.int64)
        covered[starts] += 1
        covered[starts + lengths] -= 1
        at = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
    span = place = (starts, starts, starts)
    if found:
        codes = near_codes(width)
        span, place = prefixed(lengths), prefixed(np.array([codes.get(d, d + 120) for d in far.tolist()], np.int64))
    own = px[at]
    red, green, blue, alpha = (own >> 16 & 0xFF, own >> 8 & 0xFF, own & 0xFF, own >> 24)
    symbol, literal = green, np.ones(len(at), bool)
    if cache_bits:
        slot, hit = cache_slots(px, cache_bits)
        literal = ~hit[at]
        symbol = np.where(literal, green, 280 + slot[at])
    counts = [np.bincount(symbol, minlength=280 + (1 << cache_bits if cache_bits else 0))]
    if found:
        counts[0][256:280] += np.bincount(span[0], minlength=24)
    counts += [np.bincount(x[literal], minlength=256) for x in (red, blue, alpha)]
    return Tokens(at, symbol, literal, (red, blue, alpha), starts, span, place, [*counts, np.bincount(place[0], minlength=40)])


def put_codes(fields: Fields, counts: list[np.ndarray], cache_bits: int, main: bool, most: int = 15) -> list[tuple[np.ndarray, np.ndarray]]:
    fields.put(int(cache_bits > 0), 1)
    if cache_bits:
        fields.put(cache_bits, 4)
    if main:
        fields.put(0, 1)  # one group of codes
    return [put_code(fields, x, most) for x in counts]


def put_tokens(fields: Fields, own: Tokens, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """A token is up to four numbers: symbol, red (or the extra bits of a length), blue (or distance), alpha (or its extra bits)."""
    plain = len(own.at)
    total = plain + len(own.starts)
    values, sizes = np.zeros((total, 4), np.uint32), np.zeros((total, 4), np.int64)
    values[:plain, 0], sizes[:plain, 0] = tables[0][0].take(own.symbol), tables[0][1].take(own.symbol)
    for k, channel in enumerate(own.channels, 1):
        values[:plain, k] = tables[k][0].take(channel)
        sizes[:plain, k] = tables[k][1].take(channel) * own.literal
    if len(own.starts):
        values[plain:, 0], sizes[plain:, 0] = tables[0][0][256 + own.span[0]], tables[0][1][256 + own.span[0]]
        values[plain:, 1], sizes[plain:, 1] = own.span[1], own.span[2]
        values[plain:, 2], sizes[plain:, 2] = tables[4][0][own.place[0]], tables[4][1][own.place[0]]
        values[plain:, 3], sizes[plain:, 3] = own.place[1], own.place[2]
        order = np.argsort(np.concatenate([own.at, own.starts]), kind="stable")
        values, sizes = values[order], sizes[order]
    fields.put_all(values.ravel(), sizes.ravel())


def put_image(fields: Fields, px: np.ndarray, width: int, main: bool) -> None:
    """An entropy-coded image of ARGB pixels with codes of its own; with a cache where that is estimated to be shorter."""
    found = matches(px)
    own, bits = tokens(px, width, found, 0), 0
    if main and len(own.at) > 128:
        other = tokens(px, width, found, CACHE_BITS)
        if sum(map(entropy, other.counts)) < sum(map(entropy, own.counts)):
            own, bits = other, CACHE_BITS
    put_tokens(fields, own, put_codes(fields, own.counts, bits, main))


#: Bytes by how common they are in prose, for the codes of images that hold prose: each counts 0.88 times the one before.
PROSE = " eaitnosrldcumhpgbfvqywjxzk,.\n-'\"ETAISCLDMPRNOUBGFHVWJQYXZK0123456789:;/()!?=@_"
#: Prose is what takes at most so many bits a byte by these codes, beside its references.
PROSE_BITS = 5.5


class Prose(NamedTuple):
    values: np.ndarray
    sizes: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def prose() -> Prose:
    """The codes for prose and how they are written: equal for all images, so that they are made and read once a worker."""
    rank = {b: k for k, b in enumerate(PROSE.encode())}
    channel = np.array([1 + int(1000 * 0.88 ** rank[b]) if b in rank else 1 for b in range(256)])
    channel[0xC3] += 60  # letters with marks, in UTF-8
    channel[0xA0:0xC0] += 6
    green = np.concatenate([channel, 400 // np.arange(2, 26), np.full(1 << CACHE_BITS, 8)])
    alpha = np.arange(256) // 255
    fields = Fields()
    tables = put_codes(fields, [green, channel, channel, alpha, np.arange(1, 41)], CACHE_BITS, True, 12)  # short tables
    fields.close()
    values, sizes = (np.concatenate([p[k] for p in fields.parts]) for k in (0, 1))
    return Prose(values, sizes, tables)


def put_prose(fields: Fields, px: np.ndarray) -> bool:
    """Writes the image by the codes for prose, without transforms, if they suit it."""
    fixed = prose()
    own = tokens(px, WIDTH, matches(px), CACHE_BITS)
    taken = sum(int(c @ t[1]) for c, t in zip(own.counts[:4], fixed.tables))
    if taken > PROSE_BITS * 3 * max(1, len(own.at)):
        return False
    fields.put(0, 1)
    fields.put_all(fixed.values, fixed.sizes)
    put_tokens(fields, own, fixed.tables)
    return True


def predicted(rgb: np.ndarray, mode: int) -> np.ndarray:
    """What is left of rows x WIDTH x 3 bytes when each pixel is told from its left (1) or upper (2) neighbour."""
    out = rgb.copy()
    if mode == 1:
        out[:, 1:] -= rgb[:, :-1]
        out[1:, 0] -= rgb[:-1, 0]
    else:
        out[1:] -= rgb[:-1]
        out[0, 1:] -= rgb[0, :-1]
    return out


def uncoupled(rgb: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    """Red and blue less what green (and red) tell of them, in 32nds: green to red, green to blue, red to blue."""
    out = rgb.copy()
    red, green = (rgb[..., k].view(np.int8).astype(np.int16) for k in (0, 1))
    out[..., 0] -= (factors[0] * green >> 5).astype(np.uint8)
    out[..., 2] -= ((factors[1] * green >> 5) + (factors[2] * red >> 5)).astype(np.uint8)
    return out


def coupling(rgb: np.ndarray) -> tuple[int, int, int]:
    red, green, blue = rgb.reshape(-1, 3).view(np.int8).astype(np.float32).T
    square = max(float(green @ green), 1.0)
    slope = lambda x: int(np.clip(round(32 * x), -128, 127))
    to_red, to_blue = slope(float(green @ red) / square), slope(float(green @ blue) / square)
    return to_red, to_blue, slope(float(red @ (blue - np.floor(to_blue * green / 32))) / max(float(red @ red), 1.0))


def pixels_of(rgb: np.ndarray, alpha: int) -> np.ndarray:
    wide = rgb.reshape(-1, 3).astype(np.uint32)
    return np.uint32(alpha << 24) | wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2]


def put_best(fields: Fields, rgb: np.ndarray, px: np.ndarray) -> None:
    """Writes the image after the transform that an estimate favours, or none."""
    height = len(rgb)
    width = WIDTH
    less_green = rgb - rgb[..., 1:2]
    less_green[..., 1] = rgb[..., 1]
    factors = coupling(rgb)
    options = {"none": rgb, "green": less_green, "left": predicted(rgb, 1), "top": predicted(rgb, 2), "cross": uncoupled(rgb, factors)}
    # All channels of all options are counted together.
    every = np.stack(list(options.values())).reshape(len(options), -1, 3) + 256 * np.arange(3 * len(options)).reshape(-1, 1, 3)
    counts = np.bincount(every.ravel(), minlength=768 * len(options)).reshape(-1, 3, 256)
    costs = dict(zip(options, entropy(counts) + np.array([0, 0, 64, 64, 64])))
    best = min(costs, key=costs.get)
    if len(colours := np.unique(px)) <= 256:
        shift = bundle(len(colours))
        narrow = -(-WIDTH >> shift)
        index = np.zeros((height, narrow << shift), np.uint32)
        index[:, :WIDTH] = np.searchsorted(colours, px).reshape(height, WIDTH)
        held = index.reshape(height, narrow, 1 << shift) << np.arange(1 << shift, dtype=np.uint32) * (8 >> shift)
        packed = held.sum(2, dtype=np.uint32).ravel()
        if entropy(np.bincount(packed, minlength=256)) + 20 * len(colours) < costs[best]:
            best, width, coded = "palette", narrow, np.uint32(BLACK) | packed << 8
    if best != "palette":
        # A predictor works on alpha as well; all but the first pixel then have 0 left of it.
        coded = pixels_of(options[best], 0 if best in ("left", "top") else 255)
        if best in ("left", "top"):
            coded[0] &= np.uint32(0x00FFFFFF)
    plane = lambda value: np.full(-(-height >> TILE), BLACK | value, np.uint32)
    if best != "none":
        fields.put(1, 1)
        fields.put({"left": 0, "top": 0, "cross": 1, "green": 2, "palette": 3}[best], 2)
    if best in ("left", "top"):
        fields.put(TILE - 2, 3)
        put_image(fields, plane((1 if best == "left" else 2) << 8), 1, False)
    elif best == "cross":
        fields.put(TILE - 2, 3)
        put_image(fields, plane((factors[2] & 0xFF) << 16 | (factors[1] & 0xFF) << 8 | factors[0] & 0xFF), 1, False)
    elif best == "palette":
        fields.put(len(colours) - 1, 8)
        steps = channels(colours)
        steps[1:] -= steps[:-1].copy()
        put_image(fields, numbers(steps), len(colours), False)
    fields.put(0, 1)
    put_image(fields, coded, width, True)


def encode(payload: bytes) -> bytes:
    """Whole rows of 192 bytes, at most MOST_ROWS, as one file."""
    height = len(payload) // ROW
    if len(payload) != height * ROW or not 0 < height <= MOST_ROWS:
        raise ValueError("a payload is 1 to 16384 rows of 192 bytes")
    rgb = np.frombuffer(payload, np.uint8).reshape(height, WIDTH, 3)
    px = pixels_of(rgb, 255)
    fields = Fields()
    fields.put(WIDTH - 1, 14)
    fields.put(height - 1, 14)
    fields.put(0, 4)  # opaque, version
    if not put_prose(fields, px):
        put_best(fields, rgb, px)
    data = b"\x2f" + fields.bytes()
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + padded


def store(payload: bytes) -> bytes:
    """Files one after another, each of at most MOST_ROWS rows."""
    return b"".join(encode(payload[k : k + MOST_ROWS * ROW]) for k in range(0, len(payload), MOST_ROWS * ROW))
