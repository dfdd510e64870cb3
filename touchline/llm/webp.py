"""Lossless WebP (VP8L) in numpy: the codec under operator 1.

Decoding is data-parallel where the format allows. Bits are decoded speculatively: for every bit position of a block the whole token that
would start there is sized by table lookups, then one walk along those sizes finds the positions where tokens really start. Back-references
become pointers from pixels to earlier pixels; so do colour cache codes, each to the latest pixel before it with its hash; pointer
doubling resolves them all. Images with several prefix code groups, and very small ones, are decoded pixel by pixel.

Transforms: palettes with bundled pixels, subtracted green, cross-colour and all fourteen predictors are inverted; the encoder writes any of
them on request and chooses a palette, a predictor, a colour cache and back-references by itself where they pay.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cache

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES = 24, 40  # prefixes of lengths and distances
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
MOST_SIDE = 1 << 14


class WebPError(ValueError):
    """The bytes are no lossless WebP."""


def near_distances() -> list[tuple[int, int]]:
    """Columns and rows back that distance codes 1 to 120 mean: the nearest first."""
    spots = [(x, y) for x in range(-7, 9) for y in range(8) if y or x > 0]
    return sorted(spots, key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), s[0] < 0))


NEAR = near_distances()


@cache
def near_table(width: int) -> np.ndarray:
    """Pixels back by distance code, from 1 up."""
    return np.array([0] + [max(1, x + y * width) for x, y in NEAR])


@cache
def reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1 << n, np.int64)
    for k in range(n):
        out |= (np.arange(1 << n) >> k & 1) << (n - 1 - k)
    return out


def prefix_extra(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extra bits of a length or distance prefix, and its smallest value."""
    small = prefix < 4
    extra = np.where(small, 0, (prefix - 2) >> 1)
    return extra, np.where(small, prefix + 1, ((2 + (prefix & 1)) << extra) + 1)


PREFIX_EXTRA, PREFIX_LEAST = prefix_extra(np.arange(DISTANCES))


def to_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and what they hold, of values from 1 up."""
    prefix = np.searchsorted(PREFIX_LEAST, value, "right") - 1
    return prefix, PREFIX_EXTRA[prefix], value - PREFIX_LEAST[prefix]


# Reading


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise WebPError("the image ends too early")
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


@dataclass
class Code:
    """A prefix code as tables over the next `bits` bits."""

    bits: int
    symbol: np.ndarray
    length: np.ndarray

    def read(self, bits: Bits) -> int:
        byte = bits.at >> 3
        k = int.from_bytes(bits.data[byte : byte + 4], "little") >> (bits.at & 7) & ((1 << self.bits) - 1)
        bits.at += int(self.length[k])
        if bits.at > bits.end:
            raise WebPError("the image ends too early")
        return int(self.symbol[k])


def code_of(lengths: np.ndarray) -> Code:
    """The canonical code of code lengths; one symbol alone takes no bits."""
    used = np.nonzero(lengths)[0]
    if len(used) < 2:
        return Code(0, np.array([used[0] if len(used) else 0], np.int32), np.zeros(1, np.int32))
    used = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[used].astype(np.int64)
    bits = int(own[-1])
    spans = 1 << (bits - own)
    if int(spans.sum()) != 1 << bits:
        raise WebPError("a prefix code is not complete")
    order = reversed_bits(bits)
    return Code(bits, np.repeat(used, spans)[order].astype(np.int32), np.repeat(own, spans)[order].astype(np.int32))


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebPError("a symbol is outside its alphabet")
        lengths[symbols] = 1
        return code_of(lengths)
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    lengths_code = code_of(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    # at most 14 bits a length: all of them from one integer
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * alphabet + 8], "little") >> (bits.at & 7)
    symbols, sizes, mask = lengths_code.symbol.tolist(), lengths_code.length.tolist(), (1 << lengths_code.bits) - 1
    found: list[int] = []
    before, used = 8, 0
    while len(found) < alphabet and left:
        left -= 1
        k, size = symbols[ahead & mask], sizes[ahead & mask]
        ahead >>= size
        used += size
        if k < 16:
            found.append(k)
            before = k or before
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[k - 16]
        found += [before if k == 16 else 0] * (least + (ahead & ((1 << extra) - 1)))
        ahead >>= extra
        used += extra
    bits.at += used
    if bits.at > bits.end:
        raise WebPError("the image ends too early")
    if len(found) > alphabet:
        raise WebPError("code lengths run past their alphabet")
    lengths[: len(found)] = found
    return code_of(lengths)


def cache_hash(pixels: np.ndarray, bits: int) -> np.ndarray:
    return (pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as a flat array of ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = read_pixels(bits, -(-width >> meta_bits), -(-height >> meta_bits), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    alphabets = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, n) for n in alphabets] for _ in range(groups)]
    total = width * height
    if groups == 1 and not any(c.bits for c in codes[0][:4]) and codes[0][0].symbol[0] < 256:
        g, r, b, a = (int(c.symbol[0]) for c in codes[0][:4])
        return np.full(total, a << 24 | r << 16 | g << 8 | b, np.uint32)
    if groups > 1 or total <= 32 or not codes[0][0].bits:
        return _read_one_by_one(bits, width, total, cache_bits, codes, meta, meta_bits)
    return _read_together(bits, width, total, cache_bits, codes[0])


def _read_one_by_one(bits: Bits, width: int, total: int, cache_bits: int, codes: list, meta, meta_bits: int) -> np.ndarray:
    out, cached, hashed = np.zeros(total, np.uint32), [0] * (1 << cache_bits), 0
    near, meta_width = near_table(width), -(-width >> meta_bits)

    def value(prefix: int) -> int:
        return int(PREFIX_LEAST[prefix]) + bits.read(int(PREFIX_EXTRA[prefix]))

    def catch_up(to: int) -> None:
        nonlocal hashed
        if cache_bits:
            for pixel in out[hashed:to].tolist():
                cached[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
        hashed = to

    at = 0
    while at < total:
        green, red, blue, alpha, distance = codes[0 if meta is None else int(meta[(at // width >> meta_bits) * meta_width + (at % width >> meta_bits)])]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + LENGTHS:
            n, d = value(s - 256), value(distance.read(bits))
            d = int(near[d]) if d <= len(NEAR) else d - len(NEAR)
            if d > at or at + n > total:
                raise WebPError("a reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            at += n
        else:
            catch_up(at)
            out[at] = cached[s - 256 - LENGTHS]
            at += 1
    return out


#: Bit positions that are decoded at once, and the bits a token has at most.
BLOCK, MARGIN = 1 << 18, 64


def _read_together(bits: Bits, width: int, total: int, cache_bits: int, codes: list[Code]) -> np.ndarray:
    green, red, blue, alpha, distance = codes
    data = np.frombuffer(bits.data, np.uint8)
    parts: list[tuple[np.ndarray, ...]] = []
    made, at = 0, bits.at
    plain = not (green.symbol >= 256).any()  # literals only

    def literals(symbols: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Pixels from their green and the places of what follows it."""
        pixel = symbols.astype(np.uint32) << 8
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if code.bits:
                j = windows[where] & ((1 << code.bits) - 1)
                pixel |= code.symbol[j].astype(np.uint32) << shift
                where = where + code.length[j]
            else:
                pixel |= np.uint32(int(code.symbol[0]) << shift)
        return pixel

    wide = 24  # bits of a window: more than any code or extra field has
    while made < total:
        if at >= bits.end:
            raise WebPError("the image ends too early")
        base = at & ~7
        n = min(BLOCK, bits.end - base, (total - made) * MARGIN + 8)
        raw = data[base >> 3 : (base + n + 2 * MARGIN >> 3) + 4]
        raw = np.concatenate((raw, np.zeros((n + 2 * MARGIN >> 3) + 5 - len(raw), np.uint8))).astype(np.uint32)
        words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        windows = (words[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << wide) - 1)).ravel().astype(np.int32)

        def field(code: Code, where: np.ndarray) -> np.ndarray:
            return windows[where] & ((1 << code.bits) - 1)

        k = windows[:n] & ((1 << green.bits) - 1)
        after = green.length[k]
        after += np.arange(n, dtype=np.int32)
        following = after
        rest = [code for code in (red, blue, alpha) if code.bits]
        if rest:
            following = after.copy()
            for code in rest:
                following += code.length[field(code, following)]
        if not plain:
            special = np.nonzero((green.symbol >= 256)[k])[0]
            symbol = green.symbol[k[special]]
            following = after.copy() if following is after else following
            following[special] = after[special]
            copy = symbol < 256 + LENGTHS
            special, symbol = special[copy], symbol[copy]
            to = after[special] + PREFIX_EXTRA[symbol - 256]
            j = field(distance, to)
            following[special] = to + distance.length[j] + PREFIX_EXTRA[distance.symbol[j]]
        # the walk takes four tokens a step; positions behind the block lead to themselves
        one = np.concatenate((following, np.arange(n, n + 2 * MARGIN, dtype=np.int32)))
        two = one[one]
        step, p, starts = memoryview(two[two]), at - base, []
        put = starts.append
        while p < n:
            put(p)
            p = step[p]
        at = base + p
        p = np.array(starts, np.int64)
        p = np.stack((p, one[p], two[p], one[two[p]]), 1).ravel()
        p = p[p < n]
        if plain:
            p = p[: total - made]
            parts.append((literals(green.symbol[k[p]], after[p]),))
            made += len(p)
            bits.at = base + int(following[p[-1]])
            continue
        s, q, stop = green.symbol[k[p]], after[p].astype(np.int64), base + following[p].astype(np.int64)
        pixel, size, back = np.zeros(len(p), np.uint32), np.ones(len(p), np.int64), np.zeros(len(p), np.int64)
        lit = np.nonzero(s < 256)[0]
        pixel[lit] = literals(s[lit], q[lit])
        cop = np.nonzero((s >= 256) & (s < 256 + LENGTHS))[0]
        if len(cop):
            prefix, where = s[cop] - 256, q[cop]
            size[cop] = PREFIX_LEAST[prefix] + (windows[where] & ((1 << PREFIX_EXTRA[prefix]) - 1))
            where = where + PREFIX_EXTRA[prefix]
            j = field(distance, where)
            prefix, where = distance.symbol[j], where + distance.length[j]
            far = PREFIX_LEAST[prefix] + (windows[where] & ((1 << PREFIX_EXTRA[prefix]) - 1))
            back[cop] = np.where(far <= len(NEAR), near_table(width)[np.minimum(far, len(NEAR))], far - len(NEAR))
        cached = np.where(s >= 256 + LENGTHS, s - 256 - LENGTHS, -1)
        made += int(size.sum())
        parts.append((pixel, size, back, cached, stop))
    if plain:
        if bits.at > bits.end:
            raise WebPError("the image ends too early")
        return parts[0][0] if len(parts) == 1 else np.concatenate([x for x, in parts])
    pixel, size, back, cached, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum(size)
    tokens = int(np.searchsorted(ends, total)) + 1
    if ends[tokens - 1] != total:
        raise WebPError("a reference leaves the image")
    pixel, size, back, cached, first = pixel[:tokens], size[:tokens], back[:tokens], cached[:tokens], ends[:tokens] - size[:tokens]
    bits.at = int(stop[tokens - 1])
    if np.any(back > first):
        raise WebPError("a reference leaves the image")
    out = np.zeros(total, np.uint32)
    single = back == 0
    out[first[single]] = pixel[single]
    if bits.at > bits.end:
        raise WebPError("the image ends too early")
    source = np.arange(total)
    if not single.all():
        source -= np.repeat(back, size)
    origin = _roots(source)
    if (cached >= 0).any():
        slot = np.zeros(total, np.int64)
        code = np.full(total, -1, np.int64)
        code[first[cached >= 0]] = cached[cached >= 0]
        slot = np.where(code >= 0, code, cache_hash(out, cache_bits).astype(np.int64))[origin]
        order = np.argsort(slot, kind="stable")
        before = np.full(total, -1, np.int64)  # the latest pixel before with the same hash
        same = slot[order[1:]] == slot[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        asks = code >= 0
        # a code that no pixel has filled means pixel 0
        empty = asks & (before < 0)
        source = np.where(asks & ~empty, before, source)
        origin = _roots(source)
    return out[origin]


def _roots(source: np.ndarray) -> np.ndarray:
    """Where pointers to earlier places end."""
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return source
        source = further


# Transforms. Channels are int32 arrays of shape (height, width, 4): alpha, red, green, blue.


def split(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    return pixels.astype(">u4").view(np.uint8).reshape(height, width, 4).astype(np.int32)


def join(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view(">u4").astype(np.uint32).ravel()


def predicted(mode: int, left, top, top_left, top_right) -> np.ndarray:
    """What a predictor makes of neighbours; arrays whose last axis is the four channels."""
    half = lambda a, b: a + b >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        off = mean - top_left
        return np.clip(mean + np.where(off < 0, -(-off >> 1), off >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), np.shape(left))  # 0, and the two that mean nothing


def tile_values(values: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """A value a pixel from a value a tile."""
    grid = values.reshape(-(-height >> bits), -(-width >> bits))
    return np.repeat(np.repeat(grid, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]


def _neighbours(full: np.ndarray, y: int, x: int):
    """Left, top, top left and top right in a flat image of a known width; arrays of indices may stand for x."""
    width = full.shape[1]
    flat = full.reshape(-1, 4)
    at = y * width + x
    return flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1]


def add_predictions(residual: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Pixels from residuals and the mode of each pixel."""
    height, width, _ = residual.shape
    out = residual.copy()
    out[0, 0] += (255, 0, 0, 0)
    out[0] = np.cumsum(out[0], axis=0) & 255
    columns = np.arange(1, width)
    for y in range(1, height):
        out[y, 0] = out[y, 0] + out[y - 1, 0] & 255
        own = modes[y, 1:]
        mode = int(own[0]) if width > 1 else 0
        if width == 1:
            continue
        if (own == mode).all() and mode == 1:
            out[y] = np.cumsum(out[y], axis=0) & 255
        elif (own == mode).all() and mode in (0, 2, 3, 4, 8, 9, 14, 15):
            out[y, 1:] = out[y, 1:] + predicted(mode, *_neighbours(out, y, columns)) & 255
        else:
            for x in range(1, width):
                out[y, x] = out[y, x] + predicted(int(modes[y, x]), *_neighbours(out, y, x)) & 255
    return out


def take_predictions(channels: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Residuals of pixels; the inverse of add_predictions."""
    height, width, _ = channels.shape
    out = channels.copy()
    out[0, 1:] -= channels[0, :-1]
    out[0, 0] -= (255, 0, 0, 0)
    out[1:, 0] -= channels[:-1, 0]
    for mode in np.unique(modes[1:, 1:]).tolist() if height > 1 and width > 1 else []:
        y, x = np.nonzero(modes[1:, 1:] == mode)
        out[y + 1, x + 1] -= predicted(mode, *_neighbours(channels, y + 1, x + 1))
    return out & 255


def color_delta(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return factor.astype(np.int8).astype(np.int32) * channel.astype(np.uint8).astype(np.int8).astype(np.int32) >> 5


def cross_colors(channels: np.ndarray, tiles: np.ndarray, sign: int) -> np.ndarray:
    """Take (sign -1) or give back (1) what green says of red and blue, and red of blue; tiles: (height, width, 3) factors a pixel."""
    out = channels.copy()
    red, green = channels[..., 1], channels[..., 2]
    green_to_red, green_to_blue, red_to_blue = (tiles[..., k] for k in range(3))
    out[..., 1] = red + sign * color_delta(green_to_red, green) & 255
    true_red = out[..., 1] if sign > 0 else red
    out[..., 3] = channels[..., 3] + sign * (color_delta(green_to_blue, green) + color_delta(red_to_blue, true_red)) & 255
    return out


def bundle_bits(colors: int) -> int:
    """Of pixels in one: 8, 4, 2 or 1, as a power of two."""
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def decode_image(data: bytes) -> np.ndarray:
    """The pixels of a VP8L stream: uint8 of shape (height, width, 4), alpha first."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise WebPError("no lossless image")
    full_width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("an unknown version")
    width, todo = full_width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in todo]:
            raise WebPError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            size = bits.read(3) + 2
            todo.append((kind, width, size, read_pixels(bits, -(-width >> size), -(-height >> size), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(split(read_pixels(bits, n, 1, False), 1, n)[0], axis=0) & 255
            todo.append((kind, width, bundle_bits(n), table))
            width = -(-width >> bundle_bits(n))
        else:
            todo.append((kind, width, 0, None))
    pixels = read_pixels(bits, width, height, True)
    if todo and todo[-1][0] == SUBTRACT_GREEN:  # on whole pixels, where it comes first
        todo.pop()
        green = pixels >> 8 & np.uint32(255)
        pixels = pixels & np.uint32(0xFF00FF00) | (pixels & np.uint32(0xFF00FF)) + (green << 16 | green) & np.uint32(0xFF00FF)
    if not todo:
        return pixels.astype(">u4").view(np.uint8).reshape(height, width, 4)
    channels = split(pixels, height, width)
    for kind, width, size, extra in reversed(todo):
        if kind == PREDICTOR:
            channels = add_predictions(channels, tile_values(extra >> 8 & 15, size, height, width))
        elif kind == CROSS_COLOR:
            factors = np.stack([tile_values(extra & 255, size, height, width), tile_values(extra >> 8 & 255, size, height, width), tile_values(extra >> 16 & 255, size, height, width)], -1)
            channels = cross_colors(channels, factors, 1)
        elif kind == SUBTRACT_GREEN:
            channels[..., 1] = channels[..., 1] + channels[..., 2] & 255
            channels[..., 3] = channels[..., 3] + channels[..., 2] & 255
        else:
            per, depth = 1 << size, 8 >> size
            packed = channels[..., 2]
            if size:
                packed = (packed[..., None] >> np.arange(per) * depth & (1 << depth) - 1).reshape(height, -1)[:, :width]
            table = np.vstack([extra, np.zeros((256 - len(extra), 4), extra.dtype)])
            channels = table[packed]
    return channels.astype(np.uint8)


# Writing


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of an optimal code in which none is above most; symbols with a count of 0 have none."""
    floor = 1
    while True:
        heap = [(max(c, floor), k, (k,)) for k, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
            return lengths
        heapq.heapify(heap)
        parent: dict[int, int] = {}
        number = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = number
            heapq.heappush(heap, (a[0] + b[0], number, ()))
            number += 1
        depth = {number - 1: 0}
        for k in range(number - 2, -1, -1):
            if k in parent:
                depth[k] = depth[parent[k]] + 1
                if k < len(counts):
                    lengths[k] = depth[k]
        if max(lengths) <= most:
            return lengths
        floor *= 2


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol, first bit lowest; one symbol alone has none."""
    out = np.zeros(len(lengths), np.int64)
    used = np.nonzero(lengths)[0]
    if len(used) < 2:
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[used]
    bits = int(own[-1])
    steps = 1 << (bits - own)
    out[used] = reversed_bits(bits)[np.cumsum(steps) - steps]
    return out


class Writer:
    """Gathers fields of bits, least significant first."""

    def __init__(self):
        self.values: list = []
        self.sizes: list = []

    def put(self, value: int, size: int) -> None:
        self.values.append(np.array([value], np.int64))
        self.sizes.append(np.array([size], np.int64))

    def put_all(self, values, sizes) -> None:
        self.values.append(np.asarray(values, np.int64))
        self.sizes.append(np.asarray(sizes, np.int64))

    def bytes(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        keep = sizes > 0
        values, sizes = values[keep].astype(np.uint64), sizes[keep]
        ends = np.cumsum(sizes)
        at = ends - sizes
        word = at >> 5
        values <<= (at & 31).astype(np.uint64)  # fields have 32 bits at most
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        # fields don't overlap, so sums are unions; what runs over goes to the next word
        out[word[first]] = np.add.reduceat(values & np.uint64(0xFFFFFFFF), first)
        out[word[first] + 1] += np.add.reduceat(values >> np.uint64(32), first)
        return out.astype("<u4").tobytes()[: int(ends[-1]) + 7 >> 3]


def write_code(out: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the code for counts; lengths and bits of its symbols."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        if len(symbols) == 2:
            lengths[symbols] = 1
        # simple, number of symbols, 8 bits for the first one
        out.put_all([1, len(symbols) - 1, 1, *symbols], [1, 1, 1, *[8] * len(symbols)])
        return lengths, codes_of(lengths)
    lengths = np.array(code_lengths(counts.tolist(), 15), np.int64)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, extra bits
    edges = [0, *(np.nonzero(np.diff(lengths))[0] + 1).tolist(), len(lengths)]
    for begin, end in zip(edges, edges[1:], strict=False):
        value, left = int(lengths[begin]), end - begin
        if value:
            tokens.append((value, 0, 0))
            left -= 1
        while left >= 3:
            n = min(left, 6 if value else 138)
            tokens.append((16, n - 3, 2) if value else (17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            left -= n
        tokens += [(value, 0, 0)] * left
    symbols = np.array([t[0] for t in tokens])
    own = np.array(code_lengths(np.bincount(symbols, minlength=19).tolist(), 7), np.int64)
    order = own[list(CODE_LENGTH_ORDER)]
    n = max(4, int(np.nonzero(order)[0][-1]) + 1)
    out.put_all([0, n - 4, *order[:n].tolist(), 0], [1, 4, *[3] * n, 1])
    bits = codes_of(own)
    sizes = own if np.count_nonzero(own) > 1 else np.zeros(19, np.int64)
    fields = np.empty((len(tokens), 2), np.int64)
    widths = np.empty((len(tokens), 2), np.int64)
    fields[:, 0], widths[:, 0] = bits[symbols], sizes[symbols]
    fields[:, 1], widths[:, 1] = [t[1] for t in tokens], [t[2] for t in tokens]
    out.put_all(fields.ravel(), widths.ravel())
    if np.count_nonzero(lengths) == 1:
        lengths = np.zeros_like(lengths)
    return lengths, codes_of(lengths)


#: Pixels in the shortest reference unless the caller says otherwise, and in the longest.
SHORTEST, LONGEST = 4, 4096


def references(pixels: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Places, lengths and distances of repeats, from left to right: of each place that isn't covered the latest earlier one with the same start."""
    n = len(pixels) - shortest + 1
    if n < 2:
        return []
    h, have = pixels.astype(np.uint64), 1
    while have < shortest:  # the hash of twice as many pixels, or of as many as are asked for
        step = min(have, shortest - have)
        h = h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ h[step:] >> np.uint64(31))
        have += step
    if shortest > SHORTEST:  # long repeats are found from an eighth of their places, and then grown to the left
        places = np.flatnonzero(h >> np.uint64(40) & np.uint64(7) == 0)
        h = h[places]
    else:
        places = np.arange(n)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    before = np.full(len(h), -1, np.int64)
    before[order[1:][same]] = places[order[:-1][same]]
    out, free = [], 0
    for k in np.nonzero(before >= 0)[0].tolist():
        at, start = int(places[k]), int(before[k])
        if at < free:
            continue
        while at > free and start > 0 and pixels[at - 1] == pixels[start - 1]:
            at, start = at - 1, start - 1
        most = min(LONGEST, len(pixels) - at)
        differs = np.nonzero(pixels[at : at + most] != pixels[start : start + most])[0]
        size = int(differs[0]) if len(differs) else most
        if size >= shortest:
            out.append((at, size, at - start))
            free = at + size
    return out


def cache_codes(pixels: np.ndarray, bits: int) -> np.ndarray:
    """The cache code of each pixel that the colour cache holds when it comes; else -1."""
    slot = cache_hash(pixels, bits).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    out = np.full(len(pixels), -1, np.int64)
    out[order[1:][hit]] = slot[order[1:][hit]]
    return out


def write_pixels(out: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int | None = None, shortest: int | None = SHORTEST, meta: tuple[int, np.ndarray] | None = None, grey: bool = False) -> None:
    """An entropy-coded image of flat ARGB. grey: it is opaque, and has green alone. cache_bits: None to choose. shortest: of references, or None. meta: tile size as bits, and a group a tile."""
    n = len(pixels)
    copies = references(pixels, shortest) if shortest else []
    starts = np.ones(n, bool)
    for at, size, _ in copies:
        starts[at + 1 : at + size] = False
    at = np.nonzero(starts)[0]
    if cache_bits is None:
        cache_bits = 0
        if n > 256:
            hits = cache_codes(pixels, 8)
            cache_bits = 8 if np.count_nonzero(hits[at] >= 0) > 0.25 * len(at) else 0
    out.put_all([1, cache_bits] if cache_bits else [0], [1, 4] if cache_bits else [1])
    alphabets = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    if not copies and not cache_bits and meta is None:  # literals only
        if main:
            out.put(0, 1)
        fields = []
        for shift, alphabet in zip((8, 16, 0, 24), alphabets, strict=False):
            if grey and shift != 8:
                only = 255 if shift == 24 else 0
                out.put_all([1, 0, 1, only], [1, 1, 1, 8])
                continue
            own = (pixels >> shift & np.uint32(255)).astype(np.int64)
            lengths, bits = write_code(out, np.bincount(own, minlength=alphabet))
            if lengths.any():
                fields.append((bits[own], lengths[own]))
        write_code(out, np.zeros(DISTANCES, np.int64))
        if fields:
            out.put_all(*(np.stack(x, 1).ravel() for x in zip(*fields, strict=True)))
        return
    own = pixels[at].astype(np.int64)
    # four fields a token: symbols of codes 0 to 4, or of none (-1) and then plain bits
    symbol = np.stack([own >> 8 & 255, own >> 16 & 255, own & 255, own >> 24], 1)
    code = np.tile(np.arange(4), (len(at), 1))
    plain, plain_bits = np.zeros_like(symbol), np.zeros_like(symbol)
    if cache_bits:
        held = cache_codes(pixels, cache_bits)[at]
        hit = held >= 0
        symbol[hit, 0] = 256 + LENGTHS + held[hit]
        code[hit, 1:] = -1
    if copies:
        where = np.searchsorted(at, [c[0] for c in copies])
        size, extra, rest = to_prefix(np.array([c[1] for c in copies]))
        near = {int(d): k for k, d in reversed(list(enumerate(near_table(width).tolist()))) if k}
        distance, far, far_rest = to_prefix(np.array([near.get(c[2], c[2] + len(NEAR)) for c in copies]))
        symbol[where, 0], code[where] = 256 + size, (0, -1, 4, -1)
        symbol[where, 2] = distance
        plain[where, 1], plain_bits[where, 1], plain[where, 3], plain_bits[where, 3] = rest, extra, far_rest, far
    group = np.zeros(len(at), np.int64)
    if main:
        out.put(0 if meta is None else 1, 1)
        if meta is not None:
            tile, groups = meta
            out.put(tile - 2, 3)
            write_pixels(out, groups.astype(np.uint32) << 8 | np.uint32(OPAQUE), -(-width >> tile), False)
            group = groups[(at // width >> tile) * -(-width >> tile) + (at % width >> tile)].astype(np.int64)
    value, size = plain, plain_bits
    for g in range(1 if meta is None else int(meta[1].max()) + 1):
        for c, alphabet in enumerate(alphabets):
            column = 2 if c == 4 else c  # a distance stands where blue would
            rows = np.nonzero((code[:, column] == c) & (group == g))[0]
            own = symbol[rows, column]
            lengths, bits = write_code(out, np.bincount(own, minlength=alphabet))
            if lengths.any():
                value[rows, column], size[rows, column] = bits[own], lengths[own]
    out.put_all(value.ravel(), size.ravel())


def encode_image(
    channels: np.ndarray,
    predictor: tuple[int, np.ndarray] | str | None = "auto",
    cross_color: tuple[int, np.ndarray] | None = None,
    subtract_green: bool = False,
    palette: bool | None = None,
    **how,
) -> bytes:
    """A VP8L stream of uint8 (height, width, 4), alpha first. predictor: tile size as bits and a mode a tile; cross_color: tile size as bits
    and (green to red, green to blue, red to blue) a tile; palette: None to choose; how: see write_pixels."""
    height, width, _ = channels.shape
    if max(height, width) > MOST_SIDE:
        raise ValueError("the image is too large")
    out = Writer()
    opaque = bool((channels[..., 0] == 255).all())
    out.put_all([SIGNATURE, width - 1, height - 1, not opaque, 0], [8, 14, 14, 1, 3])
    pixels, x = join(channels), channels.astype(np.int32)
    colors, index = np.unique(pixels, return_inverse=True) if palette is None or palette else (pixels, None)
    if len(colors) <= 256 and index is not None:
        table = split(colors, 1, len(colors))
        steps = np.diff(table, axis=1, prepend=0) & 255
        out.put_all([1, PALETTE, len(colors) - 1], [1, 2, 8])
        write_pixels(out, join(steps), len(colors), False)
        size = bundle_bits(len(colors))
        per, depth = 1 << size, 8 >> size
        index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % per)))
        packed = (index.reshape(height, -1, per) << np.arange(per) * depth).sum(-1)
        width = packed.shape[1]
        x = np.zeros((height, width, 4), np.int32)
        x[..., 0], x[..., 2] = 255, packed
    elif palette:
        raise ValueError("too many colours for a palette")
    elif isinstance(predictor, str):
        # where most pixels repeat the one before or above, predict that
        share = lambda d: float((pixels[d:] == pixels[:-d]).mean()) if len(pixels) > d else 0.0
        left, top = share(1), share(width)
        mode = 1 if left >= top else 2
        predictor = (9, np.full(-(-height >> 9) * -(-width >> 9), mode)) if max(left, top) > 0.5 else None
    if predictor is not None and not isinstance(predictor, str):
        size, modes = predictor
        out.put_all([1, PREDICTOR, size - 2], [1, 2, 3])
        write_pixels(out, np.asarray(modes).ravel().astype(np.uint32) << 8 | np.uint32(OPAQUE), -(-width >> size), False)
        x = take_predictions(x, tile_values(np.asarray(modes).ravel(), size, height, width))
    if cross_color is not None:
        size, factors = cross_color
        out.put_all([1, CROSS_COLOR, size - 2], [1, 2, 3])
        f = (factors.reshape(-1, 3) & 255).astype(np.uint32)
        write_pixels(out, np.uint32(OPAQUE) | f[:, 2] << 16 | f[:, 1] << 8 | f[:, 0], -(-width >> size), False)
        x = cross_colors(x, np.stack([tile_values(f[:, k], size, height, width) for k in range(3)], -1), -1)
    if subtract_green:
        out.put_all([1, SUBTRACT_GREEN], [1, 2])
        x = x.copy()
        x[..., 1], x[..., 3] = x[..., 1] - x[..., 2] & 255, x[..., 3] - x[..., 2] & 255
    out.put(0, 1)
    write_pixels(out, join(x), width, True, **how)
    return out.bytes()


def encode_grey(samples: np.ndarray, shortest: int = SHORTEST) -> bytes:
    """A VP8L stream of uint8 (height, width) as an opaque image whose red and blue equal green: what encode_image() with subtract_green writes,
    or its choice of a palette or a predictor where pixels are few or repeat."""
    height, width = samples.shape
    flat = samples.ravel()
    few = np.count_nonzero(np.bincount(flat, minlength=256)) <= 16
    share = lambda d: np.count_nonzero(flat[d:] == flat[:-d]) if len(flat) > d else 0
    if few or 2 * max(share(1), share(width)) > len(flat):
        image = np.full((height, width, 4), 255, np.uint8)
        image[..., 1:] = samples[..., None]
        return encode_image(image, palette=few, subtract_green=not few, cache_bits=0, shortest=shortest)
    out = Writer()
    out.put_all([SIGNATURE, width - 1, height - 1, 0, 0, 1, SUBTRACT_GREEN, 0], [8, 14, 14, 1, 3, 1, 2, 1])
    write_pixels(out, flat.astype(np.uint32) << 8 | np.uint32(OPAQUE), width, True, cache_bits=0, shortest=shortest, grey=True)
    return out.bytes()


def to_riff(stream: bytes) -> bytes:
    """A file of a VP8L stream."""
    pad = len(stream) & 1
    return b"RIFF" + (12 + len(stream) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + bytes(pad)


def from_riff(data: bytes) -> list[bytes]:
    """The VP8L streams of files that stand one after the other; other chunks are passed over."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise WebPError("no WebP file")
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        at += 12
        while at < end:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"VP8L":
                out.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return out
