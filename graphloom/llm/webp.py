"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder for 8-bit samples.

The format is public (RFC 9649). Pixels are uint32 ARGB, row by row.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MAX_SIDE = 1 << 14
LITERALS, LENGTHS, DISTANCES = 256, 24, 40

#: Fixed values of the format: the order of code length codes, and the near places of the first 120 distance codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads a bit stream, least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7) & (1 << n) - 1

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the stream ends early")
        return v


def codes_of(lengths: list[int]) -> list[int]:
    """The canonical prefix code of code lengths, each code in the order in which its bits are stored."""
    count = [0] * 17
    for n in lengths:
        count[n] += 1
    count[0], code, first = 0, 0, [0] * 17
    for n in range(1, 17):
        code = (code + count[n - 1]) << 1
        first[n] = code
    out = []
    for n in lengths:
        out.append(int(f"{first[n]:0{n}b}"[::-1], 2) if n else 0)
        first[n] += 1 if n else 0
    return out


class Prefix:
    """A prefix code. only: its symbol, if it has but one."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            raise ValueError("a prefix code without symbols")
        if self.only is None:
            if sum(2.0**-lengths[s] for s in used) != 1:
                raise ValueError("a prefix code that isn't complete")
            self.width = max(lengths)
            symbol, size = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int32)
            for s, code in zip(used, [c for c, n in zip(codes_of(list(lengths)), lengths, strict=True) if n], strict=True):
                symbol[code :: 1 << lengths[s]] = s
                size[code :: 1 << lengths[s]] = lengths[s]
            self.arrays = symbol, size
            self.table = list(zip(symbol.tolist(), size.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        s, n = self.table[bits.peek(self.width)]
        bits.at += n
        return s

    def runs(self) -> list[tuple[int, bytes]]:
        """For each 16 bits: how many of them whole literals take, and these literals; 0 if the first symbol is no literal."""
        symbol, size = (np.tile(a, 1 << 16 - self.width) for a in self.arrays)
        at, whole = np.zeros(1 << 16, np.int64), np.arange(1 << 16)
        text = np.zeros((1 << 16, 16), np.uint8)
        count, going = np.zeros(1 << 16, np.int64), np.ones(1 << 16, bool)
        for _ in range(16):
            window = whole >> at
            s, n = symbol[window & (1 << 16) - 1], size[window & (1 << 16) - 1]
            going &= (s < LITERALS) & (at + n <= 16)
            k = np.flatnonzero(going)
            if not len(k):
                break
            text[k, count[k]] = s[k]
            at[k] += n[k]
            count[k] += 1
        return [(a, t[:c].tobytes()) for a, t, c in zip(at.tolist(), text, count.tolist(), strict=True)]


@lru_cache(maxsize=256)
def prefix_of(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(lengths)


@lru_cache(maxsize=8)
def runs_of(lengths: tuple[int, ...]) -> list[tuple[int, bytes]]:
    return prefix_of(lengths).runs()


def _read_lengths(bits: Bits, size: int) -> tuple[int, ...]:
    out = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return tuple(out)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code, left = prefix_of(tuple(own)), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            out[at] = s
            at, last = at + 1, s or last
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("too many code lengths")
            out[at : at + n] = [last if s == 16 else 0] * n
            at += n
    return tuple(out)


def _value(bits: Bits, s: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


@dataclass
class Plan:
    """What stands before an image's pixels: cache bits, block bits and groups of lengths of the five codes."""

    cache: int
    block: int
    which: np.ndarray | None
    groups: list[tuple[tuple[int, ...], ...]]


def _plan(bits: Bits, width: int, height: int, main: bool) -> Plan:
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("a colour cache too large")
    block, which, n = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = (_image(bits, -(-width >> block), -(-height >> block)) >> 8) & 0xFFFF
        n = int(which.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)
    return Plan(cache, block, which, [tuple(_read_lengths(bits, k) for k in sizes) for _ in range(n)])


def _image(bits: Bits, width: int, height: int) -> np.ndarray:
    return _pixels(bits, _plan(bits, width, height, False), width, height)


def _pixels(bits: Bits, plan: Plan, width: int, height: int) -> np.ndarray:
    n = width * height
    codes = [[prefix_of(x) for x in g] for g in plan.groups]
    if len(codes) == 1 and not plan.cache and all(c.only is not None for c in codes[0][1:4]) and codes[0][0].only is None:
        red, blue, alpha = (c.only for c in codes[0][1:4])
        green = np.frombuffer(_greens(bits, plan.groups[0], codes[0][4], width, n), np.uint8).astype(np.uint32)
        return green << 8 | np.uint32(alpha << 24 | red << 16 | blue)
    out, at = [0] * n, 0
    cache, shift = [0] * (1 << plan.cache), 32 - plan.cache
    across = -(-width >> plan.block) if plan.block else 0
    while at < n:
        g = codes[0] if plan.which is None else codes[int(plan.which[(at // width >> plan.block) * across + (at % width >> plan.block)])]
        s = g[0].read(bits)
        if s < LITERALS:
            red, blue, alpha = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < LITERALS + LENGTHS:
            length = _value(bits, s - LITERALS)
            back = _distance(_value(bits, g[4].read(bits)), width)
            if back > at or length > n - at:
                raise ValueError("a copy from outside the image")
            new = [out[at - back + i % back] for i in range(length)]
        else:
            new = [cache[s - LITERALS - LENGTHS]]
        out[at : at + len(new)] = new
        at += len(new)
        if plan.cache:
            for p in new:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _greens(bits: Bits, lengths: tuple[tuple[int, ...], ...], distances: Prefix, width: int, n: int) -> bytes:
    """The green channel where the others don't change: several literals at a look, copies one by one."""
    runs, single = runs_of(lengths[0]), prefix_of(lengths[0])
    d = np.frombuffer(bits.data, np.uint8).astype(np.uint32)
    word = (d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24).tolist()
    at, out, last = bits.at, bytearray(), bits.end
    while len(out) < n:
        if at > last:
            raise ValueError("the stream ends early")
        k, literals = runs[word[at >> 3] >> (at & 7) & 0xFFFF]
        if k:
            out += literals
            at += k
            continue
        bits.at = at
        length = _value(bits, single.read(bits) - LITERALS)
        back = _distance(_value(bits, distances.read(bits)), width)
        at, size = bits.at, len(out)
        if back > size or length > n - size:
            raise ValueError("a copy from outside the image")
        if back >= length:
            out += out[size - back : size - back + length]
        else:
            out += (bytes(out[size - back :]) * (length // back + 1))[:length]
    bits.at = at
    return bytes(out[:n])


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> 24, pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255]).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def predicted(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """A pixel's prediction, by channel, from its left, top, top right and top left neighbours."""
    pairs = {5: None, 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return [((a + c >> 1) + b) >> 1 for a, b, c in zip(left, top, right, strict=True)]
    if mode in pairs:
        return [a + b >> 1 for a, b in zip(*pairs[mode], strict=True)]
    if mode == 10:
        return [(a + d >> 1) + (b + c >> 1) >> 1 for a, b, c, d in zip(left, top, right, corner, strict=True)]
    if mode == 11:
        to_left = sum(abs(b - d) for b, d in zip(top, corner, strict=True))
        to_top = sum(abs(a - d) for a, d in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, a + b - d)) for a, b, d in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [min(255, max(0, m + int((m - d) / 2))) for m, d in ((a + b >> 1, d) for a, b, d in zip(left, top, corner, strict=True))]
    return [255, 0, 0, 0]


def _add_predictions(pixels: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    rest = _channels(pixels).T.tolist()
    across = -(-width >> block)
    for at in range(width * height):
        x, y = at % width, at // width
        if at == 0:
            guess = [255, 0, 0, 0]
        elif y == 0:
            guess = rest[at - 1]
        elif x == 0:
            guess = rest[at - width]
        else:
            mode = int(modes[(y >> block) * across + (x >> block)]) >> 8 & 15
            guess = predicted(mode, rest[at - 1], rest[at - width], rest[at - width + 1], rest[at - width - 1])
        rest[at] = [(a + b) & 255 for a, b in zip(rest[at], guess, strict=True)]
    return _join(np.array(rest, np.int32).T)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def _add_colours(pixels: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    a, r, g, b = _channels(pixels)
    at = np.arange(width * height)
    _, red_blue, green_blue, green_red = _channels(factors)[:, (at // width >> block) * -(-width >> block) + (at % width >> block)]
    r = (r + _delta(green_red, g)) & 255
    b = b + _delta(green_blue, g) + _delta(red_blue, r)
    return _join(np.stack([a, r, g, b]))


def _add_greens(pixels: np.ndarray) -> np.ndarray:
    g = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) + g & 255) << 16 | (pixels + g) & 255


def _from_palette(pixels: np.ndarray, width: int, narrow: int, height: int, bundle: int, palette: np.ndarray) -> np.ndarray:
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    index, depth = (pixels >> 8 & 255).reshape(height, narrow), 8 >> bundle
    x = np.arange(width)
    return full[(index[:, x >> bundle] >> (depth * (x & (1 << bundle) - 1)).astype(np.uint32)) & (1 << depth) - 1].ravel()


#: Streams that begin with the same bits have the same codes: (bits, mask, transforms, plan, length), the latest first.
_seen: list[tuple[int, int, list, Plan, int]] = []


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels of a VP8L stream, (height, width) of ARGB."""
    if len(data) < 6 or data[0] != 0x2F:
        raise ValueError("not a lossless stream")
    head = int.from_bytes(data[1:5], "little")
    width, height, version = (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1, head >> 29
    if version:
        raise ValueError("an unknown version")
    bits = Bits(data)
    bits.at = 40
    first = int.from_bytes(data[5:520], "little")
    for known, mask, transforms, plan, size in _seen:
        if first & mask == known:
            bits.at += size
            narrow = width
            break
    else:
        transforms, narrow, kinds = [], width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in kinds:
                raise ValueError("a transform that comes twice")
            kinds.add(kind)
            if kind in (0, 1):
                block = bits.read(3) + 2
                transforms.append((kind, narrow, block, _image(bits, -(-narrow >> block), -(-height >> block))))
            elif kind == 2:
                transforms.append((kind, narrow, 0, None))
            else:
                n = bits.read(8) + 1
                steps = _channels(_image(bits, n, 1))
                bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                transforms.append((kind, narrow, bundle, _join(np.cumsum(steps, 1))))
                narrow = -(-narrow >> bundle)
        plan = _plan(bits, narrow, height, True)
        size = bits.at - 40
        if kinds <= {2} and plan.which is None and size <= 4096:  # nothing in it depends on the sides
            mask = (1 << size) - 1
            _seen.insert(0, (first & mask, mask, transforms, plan, size))
            del _seen[8:]
    pixels = _pixels(bits, plan, narrow, height)
    for kind, wide, extra, data_ in reversed(transforms):
        if kind == 0:
            pixels = _add_predictions(pixels, wide, height, extra, data_)
        elif kind == 1:
            pixels = _add_colours(pixels, wide, height, extra, data_)
        elif kind == 2:
            pixels = _add_greens(pixels)
        else:
            pixels = _from_palette(pixels, wide, -(-wide >> extra), height, extra, data_)
    return pixels.reshape(height, width)


def decode(file: bytes) -> np.ndarray:
    """The pixels of a WebP file with a lossless image, plain or extended."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + int.from_bytes(file[4:8], "little")
    while at + 8 <= end:
        size = int.from_bytes(file[at + 4 : at + 8], "little")
        if file[at : at + 4] == b"VP8L":
            return decode_stream(file[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


# ---- encoding of 8-bit samples


def lengths_of(weights: list[float], most: int = 15) -> list[int]:
    """Huffman code lengths of at most `most` bits."""
    floor = sum(weights) / (1 << most - 2)
    heap = [(max(w, floor), i, (i,)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    out = [0] * len(weights)
    tie = len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            out[i] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    assert max(out) <= most
    return out


def _sample_weights() -> list[float]:
    """How often samples are expected: text in Latin script, by rank of letters; copies in all lengths."""
    w = [2e-5] * LITERALS
    for rank, c in enumerate(b" etaoinsrhldcumfpgwybvkxjqz"):
        w[c] = 0.16 / (1 + 0.35 * rank)
        if c != 32:
            w[c - 32] = w[c] / 30
    for c in b".,\n-'|":
        w[c] = 6e-3
    for c in b"0123456789\0!?:;()\"#$%&*/=+_":
        w[c] = 1.5e-3
    for c in range(0x80, 0xC0):
        w[c] = 4e-4
    w[0xC3] = 8e-3
    return w + [2e-4] * LENGTHS


GREEN = tuple(lengths_of(_sample_weights()))
#: 24 short and 16 longer codes fill the code of distances.
DISTANCE = (5,) * 24 + (6,) * 16
#: Copies are looked for at places that their own samples pick, one in PICK, and taken from so many samples on.
PICK, LEAST_COPY, LONGEST_COPY = 8, 24, 4096


class _Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.size
        self.size += n

    def lengths(self, lengths: tuple[int, ...]) -> None:
        """Code lengths, each written out in a 4-bit code."""
        self.put(0, 1)
        self.put(15, 4)
        for s in CODE_LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)

    def only(self, symbol: int) -> None:
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            self.put(v, n)

    def few(self, used: list[int], size: int) -> dict[int, tuple[int, int]]:
        """A code of equally long words for a few of `size` symbols, its lengths written with runs of zeros: symbol to (code, bits)."""
        if len(used) == 1:
            self.only(used[0])
            return {used[0]: (0, 0)}
        deep = (len(used) - 1).bit_length()
        spare = (1 << deep) - len(used)  # so many words are one bit shorter
        lengths = [0] * size
        for i, symbol in enumerate(sorted(used)):
            lengths[symbol] = deep - 1 if i < spare else deep
        tokens: list[tuple[int, int, int]] = []
        at = 0
        while at < size:
            zeros = 0
            while at + zeros < size and lengths[at + zeros] == 0 and zeros < 138:
                zeros += 1
            if zeros >= 11:
                tokens.append((18, zeros - 11, 7))
            elif zeros >= 3:
                tokens.append((17, zeros - 3, 3))
            else:
                zeros = 1
                tokens.append((lengths[at], 0, 0))
            at += zeros
        kinds = sorted({t[0] for t in tokens})
        wide = max(1, (len(kinds) - 1).bit_length())
        own = [0] * 19
        for i, kind in enumerate(kinds):  # complete: the first ones are one bit shorter
            own[kind] = wide - 1 if i < (1 << wide) - len(kinds) and wide > 1 else wide
        if len(kinds) == 1:
            own[kinds[0]] = 1
        self.put(0, 1)
        self.put(15, 4)
        for kind in CODE_LENGTH_ORDER:
            self.put(own[kind], 3)
        self.put(0, 1)
        words = codes_of(own)
        for kind, extra, n in tokens:
            if len(kinds) > 1:
                self.put(words[kind], own[kind])
            self.put(extra, n)
        codes = codes_of(lengths)
        return {symbol: (codes[symbol], lengths[symbol]) for symbol in used}


@lru_cache(maxsize=1)
def _head() -> tuple[int, int]:
    """The bits between the sides and the samples: subtracted green, no cache, no blocks, the codes."""
    w = _Writer()
    for v, n in ((1, 1), (2, 2), (0, 1), (0, 1), (0, 1)):
        w.put(v, n)
    w.lengths(GREEN)
    for symbol in (0, 0, 255):
        w.only(symbol)
    w.lengths(DISTANCE)
    return w.value, w.size


def symbol_of(v: int) -> tuple[int, int, int]:
    """(prefix symbol, number of extra bits, extra bits) of a length or distance."""
    d = v - 1
    if d < 4:
        return d, 0, 0
    high = d.bit_length() - 1
    n = high - 1
    return 2 * high + (d >> n & 1), n, d & (1 << n) - 1


def copies(b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that came before, from left to right."""
    n = len(b)
    if n < 2 * LEAST_COPY:
        return []
    eight = np.ndarray((n - 15,), np.dtype("<u8"), b.tobytes(), 0, (1,))
    picked = np.flatnonzero((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61) == 0)
    if not len(picked):
        return []
    later = np.ndarray((n - 15,), np.dtype("<u8"), b.tobytes(), 8, (1,))
    order = np.argsort(eight[picked], kind="stable")
    at = picked[order]
    same = (eight[at[1:]] == eight[at[:-1]]) & (later[at[1:]] == later[at[:-1]])
    place, before = at[1:][same], at[:-1][same]
    out, done = [], 0
    for k in np.argsort(place, kind="stable"):
        p, q = int(place[k]), int(before[k])
        if p < done:
            continue
        while p > done and q > 0 and b[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
        size, step = 0, 64
        while p + size < n:
            m = min(step, n - p - size)
            differ = np.flatnonzero(b[p + size : p + size + m] != b[q + size : q + size + m])
            size += int(differ[0]) if len(differ) else m
            if len(differ):
                break
            step *= 4
        if size >= LEAST_COPY:
            out += [(p + i, min(LONGEST_COPY, size - i), p - q) for i in range(0, size, LONGEST_COPY)]
            done = p + size
    return out


_GREEN_CODES = np.array(codes_of(list(GREEN)), np.uint64)
_GREEN_SIZES = np.array(GREEN, np.int64)
_DISTANCE_CODES = codes_of(list(DISTANCE))


#: Images of so few values are also stored with a palette, several samples a pixel; the smaller file is taken.
PALETTE = 16


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of grey pixels, (height, width) of uint8."""
    plain = _with_greens(samples)
    values = np.unique(samples)
    if len(values) > PALETTE:
        return plain
    small = _with_palette(samples, values)
    return small if len(small) < len(plain) else plain


def _file(stream: bytes) -> bytes:
    body = b"VP8L" + len(stream).to_bytes(4, "little") + stream + bytes(len(stream) & 1)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def _with_palette(samples: np.ndarray, values: np.ndarray) -> bytes:
    """The samples as places in a palette, as many a pixel as fit; equal pixels that follow one another are copies."""
    height, width = samples.shape
    bundle = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    depth, each = 8 >> bundle, 1 << bundle
    places = np.searchsorted(values, samples).astype(np.uint32)
    narrow = -(-width // each)
    places = np.pad(places, ((0, 0), (0, narrow * each - width))).reshape(height, narrow, each)
    green = (places << (depth * np.arange(each, dtype=np.uint32))).sum(2).ravel()
    w = _Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4), (1, 1), (3, 2), (len(values) - 1, 8)):
        w.put(v, n)
    steps = np.diff(np.append(0, values.astype(np.int64))) & 255
    w.put(0, 1)  # the palette has no colour cache
    codes = [w.few(sorted(set(steps.tolist())), n) for n in (LITERALS + LENGTHS, 256, 256)]
    alpha = w.few([0, 255] if len(values) > 1 else [255], 256)
    w.only(0)
    for i, step in enumerate(steps.tolist()):
        for code in codes:
            w.put(*code[step])
        w.put(*alpha[0 if i else 255])
    w.put(0, 1)  # no further transform
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # no blocks
    starts = np.flatnonzero(np.append(True, green[1:] != green[:-1]))
    parts: list[tuple[int, int]] = []
    for place, length in zip(green[starts].tolist(), np.diff(np.append(starts, len(green))).tolist(), strict=True):
        parts.append((place, 0))
        length -= 1
        while length:
            take = min(length, LONGEST_COPY) if length >= 4 else 1
            parts.append((place, 0) if length < 4 else (LITERALS + symbol_of(take)[0], take))
            length -= take
    code = w.few(sorted({p for p, _ in parts}), LITERALS + LENGTHS)
    for symbol in (0, 0, 255):
        w.only(symbol)
    near = symbol_of(2)  # the place to the left
    w.only(near[0])
    out = _Joined(w.value, w.size)
    for symbol, length in parts:
        out.put(*code[symbol])
        if length:
            _, n, extra = symbol_of(length)
            out.put(extra, n)
            out.put(near[2], near[1])
    return _file(out.bytes())


class _Joined:
    """Many short writes: whole integers are joined now and then, so that none grows long."""

    def __init__(self, value: int, size: int):
        self.done, self.value, self.size = bytearray(), value, size

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.size
        self.size += n
        if self.size > 4096:
            whole = self.size // 8
            self.done += (self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.size -= 8 * whole

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.size + 7) // 8, "little")


def _with_greens(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    b = np.ascontiguousarray(samples).ravel()
    value, size = _GREEN_CODES[b], _GREEN_SIZES[b]
    for place, length, back in copies(b):
        w = _Writer()
        s, n, extra = symbol_of(length)
        w.put(int(_GREEN_CODES[LITERALS + s]), int(_GREEN_SIZES[LITERALS + s]))
        w.put(extra, n)
        s, n, extra = symbol_of(back + 120)
        w.put(_DISTANCE_CODES[s], DISTANCE[s])
        w.put(extra, n)
        size[place : place + length] = 0
        value[place], size[place] = w.value, w.size
    keep = size > 0
    value, size = value[keep], size[keep]
    head, head_size = _head()
    end = 40 + head_size + np.cumsum(size)
    start = end - size
    words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
    in_word = (start & 63).astype(np.uint64)
    of = start >> 6
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    words[of[first]] = np.bitwise_or.reduceat(value << in_word, first)
    over = np.flatnonzero((start & 63) + size > 64)
    words[of[over] + 1] |= value[over] >> (np.uint64(64) - in_word[over])
    front = 0x2F | (width - 1) << 8 | (height - 1) << 22 | head << 40
    n_front = (40 + head_size + 63) // 64
    words[:n_front] |= np.frombuffer((front).to_bytes(8 * n_front, "little"), "<u8")
    stream = words.tobytes()[: (int(end[-1]) + 7) // 8]
    return _file(stream)
