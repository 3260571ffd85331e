"""Lossless WebP in numpy: pixel arrays to files and back.

decode_image reads every construct of the lossless format: simple and normal prefix codes, several code groups by
block, back-references with two-dimensional distances, the colour cache, and the predictor, cross-colour,
subtract-green and colour-index transforms. encode_image writes any of them on request; images of few colours get a
palette and prefix codes by default. Pixels are unsigned 32-bit integers, alpha in the top byte, then red, green, blue.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib

import numpy as np

# Fixed values of the format -----------------------------------------------------------------------------------------
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEX = 0, 1, 2, 3
CACHE_FACTOR = 0x1E35A7BD
#: (columns to the left, rows up) of the distance codes 1 to 120
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
LITERALS, LENGTHS, DISTANCES, MOST_BITS, MOST_SIDE, FARTHEST = 256, 24, 40, 15, 16384, (1 << 20) - 120


# Prefix codes --------------------------------------------------------------------------------------------------------
def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """symbol -> bits of an optimal prefix code of at most `most` bits; one symbol alone has no bits."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 0)
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        bits = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            (n, _, a), (m, t, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in (both := a + b):
                bits[s] += 1
            heapq.heappush(heap, (n + m, t, both))
        if max(bits.values()) <= most:
            return bits
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def _reversed(bits: int) -> np.ndarray:
    """Each number below 2**bits with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for b in range(bits):
        out = np.concatenate([out, out + 1]) if not b else np.concatenate([out << 1, (out << 1) + 1])
    return out


_REVERSED = [_reversed(b) for b in range(MOST_BITS + 1)]


def canonical(bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, their lengths and codes, the bits of a code in the order in which they are read; shorter codes first."""
    pairs = sorted((b, s) for s, b in bits.items() if b)
    if not pairs:
        return (np.zeros(0, np.int64),) * 3
    lengths, symbols = np.array(pairs, np.int64).T
    spans = np.int64(1) << MOST_BITS - lengths
    ends = np.cumsum(spans)
    return symbols, lengths, _REVERSED[MOST_BITS][ends - spans]


class Code:
    """A prefix code for reading. `table`: by the next `width` bits, the symbol times 16 and the length."""

    def __init__(self, bits: dict[int, int]):
        self.only = next(iter(bits), 0) if len(bits) < 2 else None
        self.width = 0 if self.only is not None else max(bits.values())
        self.mask = (1 << self.width) - 1
        self.largest = max(bits, default=0)
        if self.only is None:
            symbols, lengths, _ = canonical(bits)
            ordered = np.repeat(symbols << 4 | lengths, np.int64(1) << self.width - lengths)
            if len(ordered) != 1 << self.width:
                raise ValueError("not a full prefix code")
            self.table = ordered[_REVERSED[self.width]].astype(np.uint16)
            self.listed = self.table.tolist() if self.width < 9 else self.table


# Bits ----------------------------------------------------------------------------------------------------------------
class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def read(self, n: int) -> int:
        byte, bit = divmod(self.at, 8)
        self.at += n
        if self.at > 8 * len(self.data) - 40:
            raise ValueError("the image data end early")
        return int.from_bytes(self.data[byte : byte + 8], "little") >> bit & (1 << n) - 1

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        byte, bit = divmod(self.at, 8)
        x = int.from_bytes(self.data[byte : byte + 4], "little") >> bit & code.mask
        x = int(code.listed[x])
        self.at += x & 15
        return x >> 4


class Writer:
    """Bits that are put one by one or, in `put_all`, by the array."""

    def __init__(self):
        self.parts, self.value, self.bits = [], 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        """values below 2**32; the bits of 64 at a time are joined with one `or` over a run."""
        used = bits > 0
        if not used.all():
            values, bits = values[used], bits[used]
        if not len(values):
            return
        ends = np.cumsum(bits, dtype=np.int64)
        head = self.bits % 8
        at = ends - bits + head
        word, shift = at >> 6, (at & 63).view(np.uint64)
        v = values.astype(np.uint64, copy=False)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1] + head >> 6) + 2, np.uint64)
        out[word[starts]] = np.bitwise_or.reduceat(v << shift, starts)
        out[word[starts] + 1] |= np.bitwise_or.reduceat(v >> np.uint64(1) >> (np.uint64(63) - shift), starts)
        out[0] |= np.uint64(self.value >> self.bits - head)
        whole = self.bits - head
        if whole:
            self.parts.append((self.value & (1 << whole) - 1).to_bytes(whole // 8, "little"))
        total = int(ends[-1]) + head
        raw = out.tobytes()
        self.parts.append(raw[: total // 8])
        self.bits = total % 8
        self.value = raw[total // 8] & (1 << self.bits) - 1

    def done(self) -> bytes:
        return b"".join([*self.parts, self.value.to_bytes((self.bits + 7) // 8, "little")])


# Entropy-coded images ------------------------------------------------------------------------------------------------
def write_code(out: Writer, bits: dict[int, int], alphabet: int) -> None:
    if len(bits) <= 2 and max(bits, default=0) < 256:
        symbols = sorted(bits) or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(int(symbols[0] > 1), 1)
        out.put(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return
    if len(bits) == 1:  # a lone symbol that the simple form can't name: a code of one bit, with a partner
        bits = {next(iter(bits)): 1, 0: 1}
    runs, s, last = [], 0, max(bits)
    while s <= last:
        if s in bits:
            runs.append((bits[s], 0, 0))
            s += 1
            continue
        gap = next(t for t in range(s, last + 1) if t in bits) - s
        s += gap
        while gap:
            k = min(gap, 138)
            runs += [(18, k - 11, 7)] if k >= 11 else [(17, k - 3, 3)] if k >= 3 else [(0, 0, 0)] * k
            gap -= k
    used: dict[int, int] = {}
    for r, _, _ in runs:
        used[r] = used.get(r, 0) + 1
    short = code_lengths(used, 7)
    told = dict(short) if len(short) > 1 else dict.fromkeys(short, 1)
    last = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if s in told) + 1
    out.put(0, 1)
    out.put(max(last, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(last, 4)]:
        out.put(told.get(s, 0), 3)
    n = len(runs)
    out.put(1, 1)
    width = max(2, (max(n - 2, 0)).bit_length() + 1 & ~1)
    out.put((width - 2) // 2, 3)
    out.put(max(n - 2, 0), width)
    codes = dict(zip(*(x.tolist() for x in canonical(short)[::2])))
    for r, extra, width in runs:
        out.put(codes.get(r, 0), short[r])
        out.put(extra, width)


def read_code(data: Reader, alphabet: int) -> Code:
    if data.read(1):
        two = data.read(1)
        symbols = [data.read(8 if data.read(1) else 1)]
        if two:
            symbols.append(data.read(8))
        return Code(dict.fromkeys(symbols, 1))
    n = 4 + data.read(4)
    lengths = Code({s: b for s in CODE_LENGTH_ORDER[:n] if (b := data.read(3))})
    left = 2 + data.read(2 + 2 * data.read(3)) if data.read(1) else alphabet
    bits: dict[int, int] = {}
    s, before = 0, 8
    while s < alphabet and left:
        left -= 1
        x = data.symbol(lengths)
        if x < 16:
            if x:
                bits[s] = before = x
            s += 1
        elif x == 16:
            for _ in range(3 + data.read(2)):
                bits[s] = before
                s += 1
        else:
            s += 3 + data.read(3) if x == 17 else 11 + data.read(7)
    if s > alphabet:
        raise ValueError("more code lengths than symbols")
    return Code(bits)


def prefixed(value: int) -> tuple[int, int, int]:
    """A length or distance from 1 as (symbol, extra bits' value, how many)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    k = v.bit_length() - 2
    return 2 * k + 2 + (v >> k & 1), v & (1 << k) - 1, k


def unprefixed(symbol: int, data: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    k = symbol - 2 >> 1
    return (2 + (symbol & 1) << k) + data.read(k) + 1


def cache_slot(pixel: int, bits: int) -> int:
    return (CACHE_FACTOR * pixel & 0xFFFFFFFF) >> 32 - bits


def write_pixels(out: Writer, pixels: np.ndarray, main: bool = False, cache_bits: int = 0, matches: bool = False, block_bits: int = 0, groups: np.ndarray | None = None) -> None:
    """pixels (rows, columns). groups, with block_bits: the code group of each block of 2**block_bits pixels a side."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            out.put(block_bits - 2, 3)
            write_pixels(out, (groups.astype(np.uint32) << 8) | np.uint32(0xFF000000))
    flat = np.ascontiguousarray(pixels, np.uint32).ravel()
    sizes = [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
    if not (cache_bits or matches or groups is not None):
        raw = flat.view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
        rest = flat & np.uint32(0xFFFF00FF)
        if len(flat) and (rest == rest[0]).all():
            told = [None, *(int(raw[0, i]) for i in (2, 0, 3))]
        else:
            told = [None] * 4
        codes, channels = [], []
        for i, only in zip((1, 2, 0, 3), told):
            if only is not None:
                codes.append({only: 0})
                continue
            counts = np.bincount(raw[:, i], minlength=256)
            used = np.flatnonzero(counts)
            codes.append(code_lengths(dict(zip(used.tolist(), counts[used].tolist())), 12))
            if len(used) > 1:
                symbols, lengths, own = canonical(codes[-1])
                v, n = np.zeros(256, np.uint64), np.zeros(256, np.int64)
                v[symbols], n[symbols] = own, lengths
                channels.append((v[raw[:, i]], n[raw[:, i]]))
        for c, size in zip([*codes, {}], sizes):
            write_code(out, c, size)
        if channels:
            out.put_all(*(x[0] if len(x) == 1 else np.stack(x, 1).ravel() for x in zip(*channels)))
        return
    rows, width = pixels.shape
    listed = flat.tolist()
    which = [0] * len(listed) if groups is None else groups[np.arange(rows)[:, None] >> block_bits, np.arange(width)[None, :] >> block_bits].ravel().tolist()
    tokens, cache, seen, i = [], [0] * (1 << cache_bits), {}, 0
    while i < len(listed):
        length = distance = 0
        if matches and (j := seen.get(tuple(listed[i : i + 3]))) is not None:
            while length < 4096 and i + length < len(listed) and listed[j + length] == listed[i + length]:
                length += 1
            distance = i - j
        if length >= 3 and distance <= FARTHEST:
            flatly = NEAR.index((distance % width, distance // width)) + 1 if (distance % width, distance // width) in NEAR else distance + 120
            (a, x, m), (b, y, n) = prefixed(length), prefixed(flatly)
            tokens.append((which[i], [(0, 256 + a, x, m), (4, b, y, n)]))
        else:
            length, p = 1, listed[i]
            if cache_bits and cache[cache_slot(p, cache_bits)] == p:
                tokens.append((which[i], [(0, LITERALS + LENGTHS + cache_slot(p, cache_bits), 0, 0)]))
            else:
                tokens.append((which[i], [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]))
        for k in range(i, i + length):
            seen[tuple(listed[k : k + 3])] = k
            if cache_bits:
                cache[cache_slot(listed[k], cache_bits)] = listed[k]
        i += length
    codes = []
    for g in range(max(which, default=0) + 1):
        for c in range(5):
            n: dict[int, int] = {}
            for h, parts in tokens:
                for d, s, _, _ in parts if h == g else ():
                    if d == c:
                        n[s] = n.get(s, 0) + 1
            code = code_lengths(n)
            if len(code) == 1 and max(code) > 255:
                code = {max(code): 1, 0: 1}
            codes.append((code, dict(zip(*(x.tolist() for x in canonical(code)[::2])))))
            write_code(out, code, sizes[c])
    for g, parts in tokens:
        for c, s, extra, width in parts:
            bits, code = codes[5 * g + c]
            out.put(code.get(s, 0), bits[s])
            out.put(extra, width)


def read_pixels(data: Reader, width: int, rows: int, main: bool = False) -> np.ndarray:
    cache_bits = data.read(4) if data.read(1) else 0
    block_bits, groups, n = 0, None, 1
    if main and data.read(1):
        block_bits = data.read(3) + 2
        groups = read_pixels(data, (width + (1 << block_bits) - 1) >> block_bits, (rows + (1 << block_bits) - 1) >> block_bits) >> 8 & 0xFFFF
        n = int(groups.max()) + 1
    sizes = [LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES]
    codes = [[read_code(data, s) for s in sizes] for _ in range(n)]
    green, red, blue, alpha, _ = codes[0]
    if n == 1 and green.largest < LITERALS and all(c.only is not None for c in (red, blue, alpha)):
        rest = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
        return (one_code(data, green, width * rows).astype(np.uint32) << np.uint32(8) | rest).reshape(rows, width)
    return np.array(mixed_codes(data, codes, width, rows, cache_bits, block_bits, groups), np.uint32).reshape(rows, width)


def one_code(data: Reader, code: Code, n: int) -> np.ndarray:
    """n symbols of one code. Where each begins depends on all before it; what begins at each bit does not, so that is
    looked up for all bits of a block at once and the rest is one addition a symbol."""
    if code.only is not None:
        return np.full(n, code.only, np.uint8)
    out = bytearray(n)
    done, block, width, whole = 0, 1 << 13, code.width, len(data.data)
    shifts = np.arange(8, dtype=np.uint32)
    while done < n:
        byte, p = divmod(data.at, 8)
        raw = np.frombuffer(data.data, np.uint8, min(block, whole - byte), byte).astype(np.uint32)
        if len(raw) < 5:
            raise ValueError("the image data end early")
        words = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        found = code.table[(words[:, None] >> shifts & np.uint32(code.mask)).ravel()]
        symbols, bits = (found >> 4).astype(np.uint8).tobytes(), (found & 15).astype(np.uint8).tobytes()
        while done < n and (sure := min((len(bits) - p) // width, n - done)) > 0:
            for i in range(done, done + sure):
                out[i] = symbols[p]
                p += bits[p]
            done += sure
        data.at = 8 * byte + p
    if data.at > 8 * (whole - 8):
        raise ValueError("the image data end early")
    return np.frombuffer(out, np.uint8)


def mixed_codes(data: Reader, codes: list, width: int, rows: int, cache_bits: int, block_bits: int, groups: np.ndarray | None) -> list[int]:
    out: list[int] = []
    cache, cached = [0] * (1 << cache_bits), 0
    total, which = width * rows, None if groups is None else groups.tolist()
    while len(out) < total:
        i = len(out)
        green, red, blue, alpha, far = codes[0] if which is None else codes[which[i // width >> block_bits][i % width >> block_bits]]
        s = data.symbol(green)
        if s < LITERALS:
            out.append(data.symbol(red) << 16 | s << 8 | data.symbol(blue) | data.symbol(alpha) << 24)
        elif s < LITERALS + LENGTHS:
            length = unprefixed(s - LITERALS, data)
            d = unprefixed(data.symbol(far), data)
            if d > 120:
                d -= 120
            else:
                left, up = NEAR[d - 1]
                d = max(1, left + up * width)
            if d > i or i + length > total:
                raise ValueError("a back-reference leaves the image")
            if d >= length:
                out += out[i - d : i - d + length]
            else:
                out += (out[i - d :] * -(-length // d))[:length]
        else:
            while cached < i:
                cache[cache_slot(out[cached], cache_bits)] = out[cached]
                cached += 1
            out.append(cache[s - LITERALS - LENGTHS])
    return out


# Transforms ----------------------------------------------------------------------------------------------------------
def channels_of(p: np.ndarray) -> np.ndarray:
    """(rows, columns) -> (rows, columns, 4): alpha, red, green, blue."""
    return np.stack([p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype(np.int32)


def pixels_of(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: int, left, top, top_right, top_left) -> list[int]:
    """The prediction of one pixel's four channels."""
    avg = lambda a, b: [x + y >> 1 for x, y in zip(a, b)]
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode == 11:
        toward = sum(abs(t - c) - abs(x - c) for x, t, c in zip(left, top, top_left))
        # the channel sums of |left + top - top_left - side| are |top - top_left| for the left side and the reverse
        return list(left) if toward < 0 else list(top)
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, top_left)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(avg(left, top), top_left)]
    plain = {1: left, 2: top, 3: top_right, 4: top_left}
    if mode in plain:
        return list(plain[mode])
    if mode == 5:
        return avg(avg(left, top_right), top)
    if mode == 10:
        return avg(avg(left, top_left), avg(top, top_right))
    return avg(*{6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}[mode])


def predict(pixels: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or takes away each pixel's prediction from the pixels before it. modes: of each block."""
    c = channels_of(pixels)
    rows, width = pixels.shape
    known, out = (np.zeros_like(c), None) if inverse else (c, np.zeros_like(c))
    for y in range(rows):
        above = known[y - 1].tolist() if y else None
        row = [] if inverse else c[y].tolist()
        made, now = [], c[y].tolist()
        for x in range(width):
            if y == 0:
                guess = row[x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = above[0]
            else:
                mode = int(modes[y >> bits, x >> bits])
                guess = predicted(mode, row[x - 1], above[x], above[x + 1] if x + 1 < width else row[0], above[x - 1])
            if inverse:
                row.append([(a + b) & 255 for a, b in zip(now[x], guess)])
            else:
                made.append([(a - b) & 255 for a, b in zip(now[x], guess)])
        if inverse:
            known[y] = row
        else:
            out[y] = made
    return pixels_of(known if inverse else out)


def cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """factors: of each block, as pixels (red to blue, green to blue, green to red in red, green, blue)."""
    c = channels_of(pixels)
    rows, width = pixels.shape
    f = factors[np.arange(rows)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    delta = lambda t, v: signed(t) * signed(v) >> 5
    green_red, green_blue, red_blue = f & 255, f >> 8 & 255, f >> 16 & 255
    sign = 1 if inverse else -1
    red = c[..., 1]  # in either direction blue is moved by the true red
    c[..., 3] += sign * delta(green_blue, c[..., 2])
    moved = red + sign * delta(green_red, c[..., 2])
    c[..., 3] += sign * delta(red_blue, moved if inverse else red)
    c[..., 1] = moved
    return pixels_of(c)


def subtract_green(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    green, sides = (pixels >> np.uint32(8) & np.uint32(255)) * np.uint32(0x10001), np.uint32(0xFF00FF)
    # a borrow of the lower side must not reach the upper one, so 256 is lent to each
    moved = (pixels & sides) + green if inverse else (pixels & sides) + np.uint32(0x1000100) - green
    return pixels & ~sides | moved & sides


def bundle_bits(colours: int) -> int:
    """2**bits palette indexes share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def bundled(index: np.ndarray, colours: int) -> np.ndarray:
    b = bundle_bits(colours)
    per = 1 << b
    rows, width = index.shape
    padded = np.zeros((rows, -(-width // per) * per), np.uint32)
    padded[:, :width] = index
    parts = padded.reshape(rows, -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(8 // per))
    return np.bitwise_or.reduce(parts, 2) << np.uint32(8) | np.uint32(0xFF000000)


def unbundled(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    green, b = pixels >> 8 & 255, bundle_bits(len(palette))
    if b:
        per = 1 << b
        green = (green[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(8 // per)) & np.uint32((1 << 8 // per) - 1)).reshape(len(pixels), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[green]


# Files ---------------------------------------------------------------------------------------------------------------
def encode_image(pixels: np.ndarray, transforms: tuple = (), palette: bool | None = None, **how) -> bytes:
    """A file of the pixels (rows, columns). transforms: ('predictor', modes, bits), ('cross', factors, bits), ('green',)
    in the order in which they are applied; palette: write indexes (by default where at most 256 colours occur and no
    transform is named, but for gray images of over 16 values, where subtracting green does as well); how: cache_bits,
    matches, block_bits and groups of write_pixels."""
    pixels = np.ascontiguousarray(pixels, np.uint32)
    rows, width = pixels.shape
    blue = pixels & np.uint32(255)
    gray = palette is not False and not transforms and bool((pixels == blue * np.uint32(0x010101) + np.uint32(0xFF000000)).all())
    if gray and palette is None and (np.bincount(blue.ravel(), minlength=256) > 0).sum() > 16:
        transforms = (("green",),)
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(rows - 1, 14)
    out.put(int((pixels >> 24 != 255).any()), 1)
    out.put(0, 3)
    for kind, *rest in transforms:
        out.put(1, 1)
        if kind == "green":
            out.put(SUBTRACT_GREEN, 2)
            pixels = subtract_green(pixels, False)
            continue
        table, bits = rest
        out.put(PREDICTOR if kind == "predictor" else CROSS_COLOUR, 2)
        out.put(bits - 2, 3)
        if kind == "predictor":
            write_pixels(out, (table.astype(np.uint32) << 8) | np.uint32(0xFF000000))
            pixels = predict(pixels, table, bits, False)
        else:
            write_pixels(out, table)
            pixels = cross_colour(pixels, table, bits, False)
    if palette or palette is None and not transforms:
        colours, index = np.unique(pixels, return_inverse=True)
        index = index.reshape(pixels.shape).astype(np.uint32)
        if len(colours) <= 256:
            out.put(1, 1)
            out.put(COLOUR_INDEX, 2)
            out.put(len(colours) - 1, 8)
            steps = channels_of(colours[None, :])
            steps[:, 1:] -= steps[:, :-1].copy()
            write_pixels(out, pixels_of(steps))
            pixels = bundled(index, len(colours))
    out.put(0, 1)
    write_pixels(out, pixels, True, **how)
    data = out.done()
    even = data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(even)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + even


def decode_image(file: bytes) -> np.ndarray:
    """The pixels (rows, columns) of a lossless WebP file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    data = Reader(file[20 : 20 + struct.unpack_from("<I", file, 16)[0]])
    if data.read(8) != 0x2F:
        raise ValueError("the image data have no signature")
    width, rows = data.read(14) + 1, data.read(14) + 1
    data.read(1)
    if data.read(3):
        raise ValueError("an unknown version")
    undo, wide = [], width
    while data.read(1):
        kind = data.read(2)
        if kind == SUBTRACT_GREEN:
            undo.append(lambda p: subtract_green(p, True))
        elif kind == COLOUR_INDEX:
            n = data.read(8) + 1
            colours = pixels_of(np.cumsum(channels_of(read_pixels(data, n, 1)), 1))[0]
            undo.append(lambda p, colours=colours, w=wide: unbundled(p, colours, w))
            wide = (wide + (1 << bundle_bits(n)) - 1) >> bundle_bits(n)
        else:
            bits = data.read(3) + 2
            side = lambda k, bits=bits: (k + (1 << bits) - 1) >> bits
            table = read_pixels(data, side(wide), side(rows))
            if kind == PREDICTOR:
                undo.append(lambda p, t=table >> 8 & 15, b=bits: predict(p, t, b, True))
            else:
                undo.append(lambda p, t=table, b=bits: cross_colour(p, t, b, True))
    pixels = read_pixels(data, wide, rows, True)
    if data.at > 8 * (len(data.data) - 8):
        raise ValueError("the image data end early")
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


# Payloads ------------------------------------------------------------------------------------------------------------
WIDTH = 192
#: Back-references are written where a general compressor needs at most this share of the bytes that the samples' entropy
#: does: searching for them takes a step for each pixel.
REPETITIVE = 0.7


def shape_of(size: int) -> tuple[int, int]:
    """(rows, columns) of the image for that many samples: 192 columns, or the fewest multiple of 192 that the format has
    rows enough for."""
    wide = WIDTH * -(-size // (WIDTH * MOST_SIDE))
    return -(-size // wide), wide


def encode_payload(payload: bytes) -> bytes:
    """Bytes, a positive multiple of WIDTH, as the gray samples of an image; spaces fill its last row.

    Beyond what one image can hold (267 million samples) the rest follows in further ones.
    """
    parts, most = [], MOST_SIDE * (MOST_SIDE // WIDTH * WIDTH)
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        rows, columns = shape_of(len(part))
        samples = np.frombuffer(part + b" " * (rows * columns - len(part)), np.uint8)
        gray = samples.astype(np.uint32) * np.uint32(0x010101) + np.uint32(0xFF000000)
        parts.append(encode_image(gray.reshape(rows, columns), matches=_repetitive(samples)))
    return b"".join(parts)


def _repetitive(samples: np.ndarray) -> bool:
    n = np.bincount(samples, minlength=256)
    n = n[n > 0]
    entropy = float(n @ np.log2(len(samples) / n)) / 8
    return len(zlib.compress(samples.tobytes(), 1)) <= REPETITIVE * entropy


def decode_payload(media: bytes, size: int) -> np.ndarray:
    """The first `size` samples of the images in `media`."""
    parts, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        parts.append(decode_image(media[at:end]).ravel().view(np.uint8)[1::4])
        at = end
    return np.ascontiguousarray(parts[0][:size]) if len(parts) == 1 else np.concatenate(parts)[:size]


def feature_of(samples: np.ndarray) -> str:
    """mean | standard deviation | entropy in bits | distinct values of the samples."""
    n = np.bincount(samples, minlength=256)
    total, v = len(samples), np.arange(256)
    mean = float(n @ v) / total
    spread = math.sqrt(max(0.0, float(n @ (v * v)) / total - mean * mean))
    share = n[n > 0] / total
    return f"{mean:.4f}|{spread:.4f}|{float(-(share * np.log2(share)).sum()) + 0.0:.4f}|{len(share)}"
