"""Lossless WebP (VP8L): a complete decoder, an encoder of bytes, and their Spark operators over columns of media."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import as_bytes, slices

#: Fixed values of the format: the order in which code length code lengths are stored, and the near distances (x, y) of the first 120 codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
SIGNATURE, MAX_SIDE = 0x2F, 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

#: Bits of a window whose literals are looked up together.
RUN_BITS = 16
#: Row n has its first n places set.
FIRST_FEW = np.tri(RUN_BITS + 1, RUN_BITS, -1, bool)
#: The longest code that the encoder writes, and the colour cache's bits in its grey images (no two of 256 indices share a place) and in its colour images.
LONGEST_CODE, CACHE_BITS = 13, {True: 10, False: 6}
#: Bytes (grey images) or pixels that a back-reference copies at least.
LEAST_COPY = {True: 20, False: 3}
#: Characters of written text, the most frequent first, and the bytes from which on a text has codes made for it.
TYPICAL, OWN_CODES_FROM = b" etnairsoluhdcmpgbfvy.\n,wkqzxj", 1 << 16
#: How far back-references look, how much one copies at most, and the bits of a place among the pixels that are searched.
FARTHEST, MOST_COPIED, PLACE_BITS = (1 << 20) - 121, 4096, 28


class BadImage(ValueError):
    """The bytes are no lossless WebP image, or end too early."""


class Bits:
    """Reads numbers from a bit stream, least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise BadImage("the stream ends early")
        value = self.peek(n)
        self.at += n
        return value


class PrefixCode:
    """A canonical prefix code from code lengths: a table by the next `width` bits gives symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lengths, self.uses, self.table_of_runs = lengths, 0, None
        self.only = int(used[0]) if len(used) == 1 else None
        if len(used) <= 1:
            if not len(used):
                self.only = 0
            self.width, self.symbols, self.sizes = 0, None, None
            return
        self.width = int(lengths.max())
        if sum(1 << (self.width - int(x)) for x in lengths[used]) != 1 << self.width:
            raise BadImage("a prefix code is incomplete")
        order = used[np.lexsort((used, lengths[used]))]
        # In the order of the codes each symbol takes 2^(width - length) of the table's places; the stream has the bits reversed.
        spans = 1 << (self.width - lengths[order])
        symbols, sizes = np.repeat(order, spans), np.repeat(lengths[order], spans)
        places = np.arange(1 << self.width)
        flipped = np.zeros_like(places)
        for k in range(self.width):
            flipped |= ((places >> k) & 1) << (self.width - 1 - k)
        self.symbols, self.sizes, self.table = symbols[flipped].tolist(), sizes[flipped].tolist(), symbols[flipped].astype(np.uint32)

    def runs(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """For each RUN_BITS bits the literals and cached pixels that they hold in full, how many, and the bits these take (none if a copy comes first); made for a code that has been used several times or has many symbols to tell."""
        if self.table_of_runs is None and self.only is None and (self.uses > 8 or count >= OWN_CODES_FROM) and self.width <= RUN_BITS:
            keys, sizes = np.arange(1 << RUN_BITS), np.array(self.sizes)
            table, n, used = np.zeros((len(keys), RUN_BITS), np.uint16), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            while len(keys):
                code = keys >> used[keys] & ((1 << self.width) - 1)
                symbol, size = self.table[code], sizes[code]
                fits = (used[keys] + size <= RUN_BITS) & ((symbol < 256) | (symbol >= 280))
                keys, symbol, size = keys[fits], symbol[fits], size[fits]
                table[keys, n[keys]] = symbol
                n[keys] += 1
                used[keys] += size
                keys = keys[used[keys] < RUN_BITS]
            self.table_of_runs = np.ascontiguousarray(table[:, : n.max()]), n.astype(np.uint8), used.astype(np.uint8)
        return self.table_of_runs

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        key = bits.peek(self.width)
        bits.at += self.sizes[key]
        if bits.at > bits.size:
            raise BadImage("the stream ends early")
        return self.symbols[key]


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):  # one or two symbols, written plainly
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        for symbol in [first, *([bits.read(8)] if two else [])]:
            if symbol >= alphabet:
                raise BadImage("a symbol lies outside its alphabet")
            lengths[symbol] = 1
        return PrefixCode(lengths)
    of_lengths = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
            continue
        value, run = {16: lambda: (last, 3 + bits.read(2)), 17: lambda: (0, 3 + bits.read(3)), 18: lambda: (0, 11 + bits.read(7))}[symbol]()
        if at + run > alphabet:
            raise BadImage("a run of code lengths passes the alphabet's end")
        lengths[at : at + run] = value
        at += run
    return PrefixCode(lengths)


#: Codes met before, by alphabet and first bits: how many bits they took, these bits, and the code. Files of one writer mostly share theirs.
KNOWN: dict[tuple[int, int], tuple[int, int, PrefixCode]] = {}


def known_code(bits: Bits, alphabet: int) -> PrefixCode:
    """read_code(), or what it gave for the same bits before."""
    first, off = bits.at >> 3, bits.at & 7
    if found := KNOWN.get((alphabet, bits.peek(48))):
        n, value, code = found
        if bits.at + n <= bits.size and (int.from_bytes(bits.data[first : first + (n + off + 7 >> 3)], "little") >> off) & ((1 << n) - 1) == value:
            bits.at += n
            code.uses += 1
            return code
    key, start = (alphabet, bits.peek(48)), bits.at
    code = read_code(bits, alphabet)
    n = bits.at - start
    if len(KNOWN) >= 256:
        for old in [k for k, (_, _, c) in KNOWN.items() if c.uses < 8] or list(KNOWN):
            del KNOWN[old]
    KNOWN[key] = (n, (int.from_bytes(bits.data[first : first + (n + off + 7 >> 3)], "little") >> off) & ((1 << n) - 1), code)
    return code


#: Images of palettes and tiles met before, as KNOWN holds codes.
KNOWN_IMAGES: dict[tuple[int, int, int], tuple[int, int, np.ndarray]] = {}


def known_pixels(bits: Bits, width: int, height: int) -> np.ndarray:
    """pixels() of an image that isn't the main one, or what it gave for the same bits before."""
    first, off = bits.at >> 3, bits.at & 7
    key = width, height, (int.from_bytes(bits.data[first : first + 25], "little") >> off) & ((1 << 192) - 1)
    if found := KNOWN_IMAGES.get(key):
        n, value, image = found
        if bits.at + n <= bits.size and (int.from_bytes(bits.data[first : first + (n + off + 7 >> 3)], "little") >> off) & ((1 << n) - 1) == value:
            bits.at += n
            return image
    start = bits.at
    image = pixels(bits, width, height, False)
    n = bits.at - start
    if len(image) <= 256:
        if len(KNOWN_IMAGES) >= 1024:
            KNOWN_IMAGES.clear()
        KNOWN_IMAGES[key] = (n, (int.from_bytes(bits.data[first : first + (n + off + 7 >> 3)], "little") >> off) & ((1 << n) - 1), image)
    return image


def far(bits: Bits, symbol: int) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image of the stream; only the main image (top) may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    groups_of, shift, n_groups = None, 0, 1
    if top and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        down = (height + (1 << shift) - 1) >> shift
        groups_of = ((pixels(bits, across, down, False) >> 8) & 0xFFFF).reshape(down, across)
        n_groups = int(groups_of.max()) + 1
    groups = [[known_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(n_groups)]
    count = width * height
    if n_groups == 1 and not cache_size and (even := evenly(bits, groups[0], count)) is not None:
        return even
    if n_groups == 1 and all(code.only is not None for code in groups[0][1:4]):
        start = bits.at
        if (one := of_one_channel(bits, groups[0], width, count, cache_bits, top)) is not None:
            return one
        bits.at = start
    out, cache, at, filled = [0] * count, [0] * cache_size, 0, 0
    kept = groups_of.tolist() if groups_of is not None else None
    green, red, blue, alpha, distances = groups[0]
    while at < count:
        if kept is not None:
            green, red, blue, alpha, distances = groups[kept[(at // width) >> shift][(at % width) >> shift]]
        symbol = green.read(bits)
        if symbol < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < 280:
            length, back = copied(bits, symbol, distances, width)
            if back > at or at + length > count:
                raise BadImage("a back-reference leaves the image")
            if back >= length:
                out[at : at + length] = out[at - back : at - back + length]
            else:
                for k in range(at, at + length):
                    out[k] = out[k - back]
            at += length
        else:
            for k in range(filled, at):
                cache[(0x1E35A7BD * out[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
            filled = at
            out[at] = cache[symbol - 280]
            at += 1
    return np.array(out, np.uint32)


def copied(bits: Bits, symbol: int, distances: PrefixCode, width: int) -> tuple[int, int]:
    """How many pixels a back-reference copies, and from how far back."""
    length = far(bits, symbol - 256)
    code = far(bits, distances.read(bits))
    if code > 120:
        return length, code - 120
    x, y = NEAR[code - 1]
    return length, max(1, x + y * width)


@lru_cache(16)
def cache_places(rest: int, cache_bits: int) -> np.ndarray:
    """Where the colour cache holds the pixels with each green and the same rest."""
    argb = np.uint64(rest) | np.arange(256, dtype=np.uint64) << np.uint64(8)
    return ((argb * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)


def copy_over(out: bytearray, length: int, back: int, room: int) -> None:
    """A back-reference: both numbers in pixels of two bytes."""
    length, back = 2 * length, 2 * back
    if back > len(out) or len(out) + length > room:
        raise BadImage("a back-reference leaves the image")
    if back >= length:
        out += out[len(out) - back : len(out) - back + length]
    else:
        out += (out[len(out) - back :] * (length // back + 1))[:length]


def told_one_by_one(bits: Bits, group: list[PrefixCode], width: int, count: int) -> bytearray:
    """The literals and cached pixels of an image of one channel, two bytes each, with its copies made."""
    green, distances = group[0], group[4]
    out, room, data = bytearray(), 2 * count, bits.data
    if green.only is not None:
        if 256 <= green.only < 280:
            raise BadImage("an image begins with a back-reference")
        out = bytearray(green.only.to_bytes(2, "little")) * count
    symbols, sizes, mask = green.symbols, green.sizes, (1 << green.width) - 1
    while len(out) < room:
        at = bits.at
        window, left, symbol = int.from_bytes(data[at >> 3 : (at >> 3) + 40], "little") >> (at & 7), 312, 0
        while left > 60 and not 256 <= symbol < 280 and len(out) < room:
            key = window & mask
            symbol, n = symbols[key], sizes[key]
            window >>= n
            left -= n
            if not 256 <= symbol < 280:
                out += symbol.to_bytes(2, "little")
        bits.at = at + 312 - left
        if bits.at > bits.size:
            raise BadImage("the stream ends early")
        if 256 <= symbol < 280:
            copy_over(out, *copied(bits, symbol, distances, width), room)
    return out


def told_by_runs(bits: Bits, group: list[PrefixCode], width: int, count: int) -> bytearray:
    """What told_one_by_one() gives: the bits that a run of pixels takes are looked up for every place of the stream, then places are followed from run to run, and the pixels of all runs are taken at once."""
    green, distances = group[0], group[4]
    table, many, used = green.runs(count)
    base, data = bits.at & ~7, np.frombuffer(bits.data[bits.at >> 3 :] + b"\0\0", np.uint8).astype(np.uint32)
    words = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    keys = np.empty((len(words), 8), np.uint16)
    for k in range(8):
        keys[:, k] = words >> np.uint32(k)
    keys = keys.ravel()
    steps, at, end, copies_at, met = used[keys].tobytes(), bits.at - base, bits.size - base, [], bytearray(len(keys))
    while at < end:
        if n := steps[at]:
            met[at] = 1
            at += n
            continue
        bits.at = base + at
        try:
            length, back = copied(bits, green.read(bits), distances, width)
        except BadImage:  # behind the last pixel stands anything; whether pixels are missing is seen below
            break
        copies_at.append((at, length, back, bits.at))
        at = bits.at - base
    places = np.flatnonzero(np.frombuffer(met, bool))
    runs = keys[places]
    sizes = many[runs]
    singles = table[runs][FIRST_FEW[sizes, : table.shape[1]]]
    ends, raw, room, out, taken = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), singles.tobytes(), 2 * count, bytearray(), 0
    until = ends[np.searchsorted(places, np.array([c[0] for c in copies_at], np.int64))].tolist()
    for to, copy in zip([*until, len(singles)], [*copies_at, None]):
        out += raw[2 * taken : 2 * to]
        if len(out) >= room:
            # The last pixel lies in a run: the image ends behind those of this run's pixels that still count.
            last = to - (len(out) - room) // 2
            k = int(np.searchsorted(ends, last)) - 1
            bits.at = base + int(places[k]) + int(green.lengths[singles[ends[k] : last]].sum())
            break
        if copy is None:
            raise BadImage("the stream ends early")
        taken = to
        copy_over(out, *copy[1:3], room)
        if len(out) == room:
            bits.at = copy[3]
            break
    if bits.at > bits.size:
        raise BadImage("the stream ends early")
    return out[:room]


def of_one_channel(bits: Bits, group: list[PrefixCode], width: int, count: int, cache_bits: int, top: bool) -> np.ndarray | None:
    """Pixels of an image whose red, blue and alpha are the same all over. None if places of the colour cache change hands or are read before they are filled, so that it has to be followed pixel by pixel."""
    green, red, blue, alpha, _ = group
    rest = alpha.only << 24 | red.only << 16 | blue.only
    # Only the last image of a stream may be read beyond its end.
    out = told_by_runs(bits, group, width, count) if top and green.runs(count) else told_one_by_one(bits, group, width, count)
    told = np.frombuffer(out, np.uint16)
    if cache_bits:
        places, n = cache_places(rest, cache_bits) + 280, 280 + (1 << cache_bits)
        first = np.full(n, count, np.int32)
        first[told[::-1]] = np.arange(count - 1, -1, -1, dtype=np.int32)
        held = np.flatnonzero(first[:256] < count)
        value, filled, at = np.arange(n, dtype=np.uint32), np.full(n, count, np.int32), places[held]
        value[at], filled[at] = held, first[held]
        if (value[at] != held).any() or ((first < count) & (filled > first))[280:].any():
            return None
        return (value << np.uint32(8) | np.uint32(rest))[told]
    return told.astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def evenly(bits: Bits, group: list[PrefixCode], count: int) -> np.ndarray | None:
    """All pixels at once where every channel's code has literals of one length only: the bits then lie on a grid."""
    green, red, blue, alpha, _ = group
    steps = []
    for code in (green, red, blue, alpha):
        if code.only is not None:
            if code.only >= 256:
                return None
            steps.append(0)
        elif code.lengths[256:].any() or (code.lengths[code.lengths > 0] != code.width).any():
            return None
        else:
            steps.append(code.width)
    stride = sum(steps)
    if bits.at + stride * count > bits.size:
        raise BadImage("the stream ends early")
    if not stride:
        return np.full(count, alpha.only << 24 | red.only << 16 | green.only << 8 | blue.only, np.uint32)
    out = np.zeros(count, np.uint32)
    if steps == [8, 8, 8, 8]:  # whole bytes, once the stream is shifted to a byte's start
        first, off = bits.at >> 3, bits.at & 7
        raw = np.frombuffer(bits.data, np.uint8, min(4 * count + 1, len(bits.data) - first), first)
        values = raw[: 4 * count]
        if off:
            values = (values >> off) | (raw[1 : 4 * count + 1] << (8 - off))
        values = values.reshape(count, 4)
        for code, k, place in zip(group, range(4), (8, 16, 0, 24)):
            out |= code.table[values[:, k]] << np.uint32(place)
    else:
        first, off = bits.at >> 3, bits.at & 7
        plain = np.unpackbits(np.frombuffer(bits.data, np.uint8)[first : (bits.at + stride * count + 7) >> 3], bitorder="little")[off : off + stride * count].reshape(count, stride)
        start = 0
        for code, step, place in zip(group, steps, (8, 16, 0, 24)):
            if step:
                keys = plain[:, start : start + step].astype(np.uint32) @ (1 << np.arange(step, dtype=np.uint32))
                out |= code.table[keys] << np.uint32(place)
            else:
                out |= np.uint32(code.only << place)
            start += step
    bits.at += stride * count
    return out


def guess(mode: int, left, top, corner, right) -> list[int]:
    """A pixel's prediction in modes 1 to 13 from its neighbours, channel by channel."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode in (1, 2, 3, 4):
        return [left, top, right, corner][mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        a, b = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode]
        return mean(a, b)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        to_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner)]
    if mode == 13:
        # The half of a difference is cut towards zero.
        return [clamp(a + int((a - c) / 2)) for a, c in zip(mean(left, top), corner)]
    return [255, 0, 0, 0]


def as_channels(argb: np.ndarray) -> np.ndarray:
    """The bytes B, G, R, A of each pixel, in place."""
    return argb.astype("<u4", copy=False).view(np.uint8).reshape(*argb.shape, 4)


def halfway(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean of bytes, rounded down."""
    return (a & b) + ((a ^ b) >> 1)


def unpredict(argb: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Pixels from what is left of them after their prediction. Where no tile looks to the upper right, one tile is done after the other, else row by row."""
    height, width = argb.shape
    argb = argb.copy()
    out = as_channels(argb)
    out[0, 0, 3:] += 255
    np.cumsum(out[0], axis=0, dtype=np.uint8, out=out[0])
    if height > 1:
        out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    for y, line in enumerate(((modes >> 8) & 15).tolist()):
        top, bottom = max(1, y << shift), min(height, (y + 1) << shift)
        # From, to and mode of neighbouring tiles with the same mode.
        starts = [k for k in range(len(line)) if not k or line[k] != line[k - 1]]
        parts = [(max(1, k << shift), min(width, end << shift), line[k]) for k, end in zip(starts, [*starts[1:], len(line)]) if width > max(1, k << shift)]
        if bottom <= top:
            continue
        if {0, 1, 2, 4, 8, 14, 15}.issuperset(line):
            for a, b, mode in parts:
                unpredict_tile(out, top, bottom, a, b, mode)
        else:
            for k in range(top, bottom):
                for a, b, mode in parts:
                    unpredict_tile(out, k, k + 1, a, b, mode)
    return argb


def unpredict_tile(out: np.ndarray, top: int, bottom: int, a: int, b: int, mode: int) -> None:
    """The pixels from a to b of some rows: all at once where they add up from the left or from above, else row by row."""
    if mode == 1:
        out[top:bottom, a - 1 : b] = np.cumsum(out[top:bottom, a - 1 : b], axis=1, dtype=np.uint8)
    elif mode == 2:
        out[top - 1 : bottom, a:b] = np.cumsum(out[top - 1 : bottom, a:b], axis=0, dtype=np.uint8)
    elif mode in (0, 14, 15):
        out[top:bottom, a:b, 3] += 255
    elif mode == 4:
        for y in range(top, bottom):
            out[y, a:b] += out[y - 1, a - 1 : b - 1]
    elif mode == 8:
        for y in range(top, bottom):
            out[y, a:b] += halfway(out[y - 1, a - 1 : b - 1], out[y - 1, a:b])
    else:
        for y in range(top, bottom):
            above, row = out[y - 1], out[y]
            # Right of the last column stands the row's own first pixel.
            right = above[a + 1 : b + 1] if b < out.shape[1] else np.concatenate([above[a + 1 :], row[:1]])
            if mode in (3, 9):
                row[a:b] += right if mode == 3 else halfway(above[a:b], right)
                continue
            done, left = [], row[a - 1].tolist()
            for rest, *others in zip(row[a:b].tolist(), above[a:b].tolist(), above[a - 1 : b - 1].tolist(), right.tolist()):
                left = [(v + p) & 255 for v, p in zip(rest, guess(mode, left, *others))]
                done.append(left)
            row[a:b] = done


def uncross(argb: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    height, width = argb.shape
    argb = argb.copy()
    if (factors == factors[0, 0]).all():
        factors = factors[:1, :1]
    else:
        factors = np.repeat(np.repeat(factors, 1 << shift, 0), 1 << shift, 1)[:height, :width]
    c, f = as_channels(argb), as_channels(np.ascontiguousarray(factors)).view(np.int8).astype(np.int16)
    green_to_red, green_to_blue, red_to_blue = f[..., 0], f[..., 1], f[..., 2]
    signed = lambda k: c[..., k].view(np.int8).astype(np.int16)
    green = signed(1)
    c[..., 2] += (green_to_red * green >> 5).astype(np.uint8)
    c[..., 0] += (green_to_blue * green >> 5).astype(np.uint8)
    if red_to_blue.any():
        c[..., 0] += (red_to_blue * signed(2) >> 5).astype(np.uint8)
    return argb


@lru_cache(64)
def colours(steps: bytes) -> np.ndarray:
    """The palette as 256 ARGB numbers, from each colour's difference from the one before: indices without a colour are transparent."""
    table = as_channels(np.frombuffer(steps, np.uint32))
    return np.pad(np.ascontiguousarray(np.cumsum(table, axis=0, dtype=np.uint8)).view(np.uint32).ravel(), (0, 256 - len(table)))


def decode(media: bytes) -> np.ndarray:
    """The image as an array (height, width) of ARGB numbers. Raises BadImage where the bytes are none."""
    if len(media) < 25 or media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise BadImage("no WebP container")
    at = 12
    while media[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(media[at + 4 : at + 8], "little") + 1 & ~1)
        if at + 8 > len(media):
            raise BadImage("no lossless image in the container")
    bits = Bits(media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")])
    if bits.read(8) != SIGNATURE:
        raise BadImage("no VP8L signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise BadImage("an unknown version")
    undo, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            w, h = (across + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            undo.append((kind, shift, known_pixels(bits, w, h).reshape(h, w), across))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = colours(known_pixels(bits, size, 1).tobytes())
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, packed, table, across))
            across = (across + (1 << packed) - 1) >> packed
        else:
            undo.append((kind, 0, None, across))
    image = pixels(bits, across, height, True).reshape(height, across)
    for kind, shift, table, wide in reversed(undo):
        if kind == PREDICTOR:
            image = unpredict(image, table, shift)
        elif kind == CROSS_COLOUR:
            image = uncross(image, table, shift)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            c = as_channels(image)
            c[..., 2] += c[..., 1]
            c[..., 0] += c[..., 1]
        else:
            index = as_channels(image)[..., 1]
            if shift:
                depth = 8 >> shift
                index = np.stack([(index >> (depth * k)) & ((1 << depth) - 1) for k in range(1 << shift)], -1).reshape(height, -1)[:, :wide]
            image = table[index]
    return image


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols that occur so often, LONGEST_CODE at most: counts are made more even until they fit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    least = max(1, sum(weights) >> LONGEST_CODE)
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapify(heap)
        parent, n = {}, len(weights)
        while len(heap) > 1:
            (v, a), (w, b) = heappop(heap), heappop(heap)
            parent[a] = parent[b] = n
            heappush(heap, (v + w, n))
            n += 1
        depth = {n - 1: 0}
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        lengths[used] = [depth[k] for k in range(len(used))]
        if lengths.max() <= LONGEST_CODE:
            return lengths
        weights, least = [max(w, least) for w in weights], 2 * least


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes, first bit lowest, as the stream has them; a lone symbol takes no bits."""
    used = np.flatnonzero(lengths)
    codes = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return codes
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order]
    spans = 1 << (LONGEST_CODE - sizes)
    value = (np.cumsum(spans) - spans) >> (LONGEST_CODE - sizes)
    flipped = np.zeros_like(value)
    for k in range(LONGEST_CODE):
        flipped = np.where(k < sizes, (flipped << 1) | ((value >> k) & 1), flipped)
    codes[order] = flipped.astype(np.uint64)
    return codes


def in_words(values: np.ndarray, sizes: np.ndarray, at: np.ndarray, n_words: int) -> np.ndarray:
    """Numbers of up to 56 bits at their places (bits) of a stream, which never go back; the stream in words of 64 bits."""
    word, off = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(n_words + 1, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(values << off, first)
    over = np.flatnonzero((at & 63) + sizes > 64)
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])
    return out


class Fields:
    """Numbers one after another, put into bytes at the end."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, *fields: tuple[int, int]) -> None:
        """Each with its bits; long ones (parts that stand in many files) are cut."""
        cut = [(v >> k & ((1 << 48) - 1), min(48, n - k)) for v, n in fields for k in range(0, n, 48)]
        self.many(np.array([v for v, _ in cut], np.uint64), np.array([n for _, n in cut], np.int64))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Of up to 56 bits each."""
        self.values.append(values)
        self.sizes.append(sizes)

    def whole(self) -> tuple[int, int]:
        """All as one number, and its bits."""
        return int.from_bytes(self.bytes(), "little"), int(sum(s.sum() for s in self.sizes))

    def bytes(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        return in_words(values, sizes, ends - sizes, int(ends[-1] >> 6) + 1).tobytes()[: -(-int(ends[-1]) // 8)]


def joined(*parts: tuple[int, int]) -> tuple[int, int]:
    """Numbers with their bits as one."""
    value = at = 0
    for v, n in parts:
        value |= v << at
        at += n
    return value, at


def put_code(fields: Fields, lengths: np.ndarray) -> None:
    """The lengths of one prefix code: plainly if it has one symbol, else as runs under a code of their own."""
    used = np.flatnonzero(lengths)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        fields.put((1, 1), (0, 1), (1, 1), (int(used[0]) if len(used) else 0, 8))
        return
    edges = np.flatnonzero(np.diff(lengths)) + 1
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    last = 8
    for value, n in zip(lengths[np.concatenate([[0], edges])].tolist(), np.diff(np.concatenate([[0], edges, [len(lengths)]])).tolist()):
        if value and value != last:
            tokens.append((value, 0, 0))
            n, last = n - 1, value
        while n:
            take = min(n, 138 if not value else 6)
            if take < 3:
                tokens += [(value, 0, 0)] * take
            elif value:
                tokens.append((16, take - 3, 2))
            else:
                tokens.append((17, take - 3, 3) if take < 11 else (18, take - 11, 7))
            n -= take
    # Seven bits are the most that a code length's own length may have; as many for all of 19 symbols are five.
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19))
    if own.max() > 7:
        own = np.where(np.arange(19) < 13, 4, 5)
    if len(np.flatnonzero(own)) < 2:
        own[[0, 16]] = 1
    codes, n = codes_of(own), max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    fields.put((0, 1), (n - 4, 4), *((int(own[s]), 3) for s in CODE_LENGTH_ORDER[:n]), (0, 1))
    fields.put(*((int(codes[t]) | extra << int(own[t]), int(own[t]) + size) for t, extra, size in tokens))


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances as symbol, extra value and extra bits (what far() undoes)."""
    v = values - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 1)
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + ((v >> (top - 1)) & 1))
    return symbol, np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


@lru_cache(64)
def near_codes(width: int) -> dict[int, int]:
    return {max(1, x + y * width): c for c, (x, y) in reversed(list(enumerate(NEAR, 1)))}


def copies(values: np.ndarray, least: int, starts: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place, length, distance) of the parts that stand somewhere before as well: looked up by the `least` values that begin there, the last such place first. Where values are those of several images (starts: of each, and the end), parts are copied inside one image only."""
    n = len(values) - least + 1
    if n < 2:
        return []
    # A window's hash from those of its halves; what is over overlaps.
    h, width = values.astype(np.uint64) + np.uint64(1), 1
    while width < least:
        step = min(width, least - width)
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        width += step
    # Hash and place in one number, so that equal hashes stand in the order of their places.
    low = np.uint64(PLACE_BITS)
    keys = np.sort(h >> low << low | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero(keys[1:] >> low == keys[:-1] >> low)
    at, before = ((keys[k] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) for k in (same + 1, same))
    starts = np.array([0, len(values)]) if starts is None else starts
    image = np.searchsorted(starts, at, "right")
    near = (at - before <= FARTHEST) & (before >= starts[image - 1]) & (at + least <= starts[image])
    order = np.argsort(at[near])
    at, before, ends = at[near][order], before[near][order], starts[image[near][order]]
    raw, out, free, size = values.tobytes(), [], 0, values.itemsize
    for at, source, end in zip(at.tolist(), before.tolist(), ends.tolist()):
        if at < free:
            continue
        length, most = 0, min(MOST_COPIED, end - at)
        a, b = source * size, at * size
        step = 32 * size
        while length < most and raw[a : a + step] == raw[b : b + step]:
            length += 32
            a, b = a + step, b + step
        length = min(length, most)
        while length < most and raw[(source + length) * size : (source + length + 1) * size] == raw[(at + length) * size : (at + length + 1) * size]:
            length += 1
        if length >= least:
            out.append((at, length, at - source))
            free = at + length
    return out


@cache
def standard() -> tuple[list[np.ndarray], list[np.ndarray], tuple[int, int]]:
    """Lengths and codes for what a prediction leaves of grey pixels of written text, and the bits that tell them: short for differences of two bytes that are frequent by TYPICAL, and for copies of words and lines."""
    byte = np.ones(256)
    byte[128:192], byte[0xC3] = 2, 8
    for rank, b in enumerate(TYPICAL):
        byte[b] = 1500 // (rank + 4)
    difference = np.array([(byte * np.roll(byte, r)).sum() for r in range(256)])
    green, back = np.ones(280 + (1 << CACHE_BITS[True])), np.ones(40)
    green[280:] = 0
    green[280 + cache_places(0xFF000000, CACHE_BITS[True])] = 1 + 20000 * difference / difference.sum()
    green[260:272], back[12:32] = 40, 12
    lone = np.zeros(256, np.int64)
    opaque = lone.copy()
    lone[0] = opaque[255] = 1
    sizes = [code_lengths(green.astype(np.int64)), lone, lone, opaque, code_lengths(back.astype(np.int64))]
    told = Fields()
    for size in sizes:
        put_code(told, size)
    return sizes, [codes_of(size) for size in sizes], told.whole()


def copy_symbols(found: list[tuple[int, int, int]], width: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Where back-references begin, and prefixed() of their lengths and of their distances."""
    near = near_codes(width)
    numbers = np.array([(at, n, near.get(d, d + 120)) for at, n, d in found], np.int64).reshape(-1, 3)
    return numbers[:, 0], [prefixed(numbers[:, k]) for k in (1, 2)]


def put_copies(value: np.ndarray, bits: np.ndarray, starts: np.ndarray, lengths: tuple, backs: tuple, sizes: np.ndarray, codes: np.ndarray) -> None:
    """Adds what stands behind the symbol of a back-reference's length (its extra bits, the distance under the last code, that one's extra bits) to the fields of its first pixel."""
    (_, length_extra, length_bits), (symbol, extra, extra_bits) = lengths, backs
    for v, n in ((length_extra, length_bits), (codes[symbol], sizes[symbol]), (extra, extra_bits)):
        value[starts] |= v.astype(np.uint64) << bits[starts].astype(np.uint64)
        bits[starts] += n


def put_image(fields: Fields, argb: np.ndarray, width: int, cache_bits: int, top: bool, least: int) -> None:
    """The pixels (one line of ARGB numbers) under prefix codes of their own, with back-references and, where cache_bits says, a colour cache."""
    count = len(argb)
    found = copies(argb, least) if least else []
    kind = np.zeros(count, np.int8)  # 0: literal, 1: cached, 2: begins a copy, 3: copied
    if cache_bits:
        if cache_bits == CACHE_BITS[True]:
            index = (argb >> np.uint32(8)).astype(np.uint8)
            place = cache_places(0xFF000000, cache_bits)[index]
            kind[held_before(index, np.array([0, count]))] = 1
        else:
            place = (argb * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)
            order = np.argsort(place, kind="stable")
            held = (place[order[1:]] == place[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
            kind[order[1:][held]] = 1
    for at, length, _ in found:
        kind[at : at + length] = 3
        kind[at] = 2
    symbols = [((argb >> np.uint32(s)) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
    if cache_bits:
        symbols[0][kind == 1] = 280 + place[kind == 1].astype(np.int64)
    starts, (lengths, backs) = copy_symbols(found, width)
    symbols[0][starts] = 256 + lengths[0]
    shown, literal = kind != 3, kind == 0
    fields.put(*([(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]), *([(0, 1)] if top else []))
    alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    parts = [symbols[0][shown], *(c[literal] for c in symbols[1:]), backs[0]]
    sizes = [code_lengths(np.bincount(p, minlength=a)) for p, a in zip(parts, alphabets)]
    for size in sizes:
        put_code(fields, size)
    codes = [codes_of(size) for size in sizes]
    sizes = [size if np.count_nonzero(size) > 1 else np.zeros_like(size) for size in sizes]
    value, bits = codes[0][symbols[0]], sizes[0][symbols[0]]
    for c in range(1, 4):
        more = sizes[c][symbols[c]]
        if more.any():
            value = np.where(literal, value | codes[c][symbols[c]] << bits.astype(np.uint64), value)
            bits += np.where(literal, more, 0)
    put_copies(value, bits, starts, lengths, backs, sizes[4], codes[4])
    fields.many(value[shown], bits[shown])


def held_before(index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the colour cache holds a pixel: each index has a place of its own there, so it does from the index's second time in an image on."""
    keys = index.astype(np.intp)
    if len(starts) > 2:
        keys += np.repeat(np.arange(len(starts) - 1) * 256, np.diff(starts))
    first, held = np.full(256 * (len(starts) - 1), -1), np.ones(len(index), bool)
    first[keys[::-1]] = np.arange(len(index) - 1, -1, -1)
    held[first[first >= 0]] = False
    return held


def under_standard_codes(index: np.ndarray, starts: np.ndarray, width: int, heads: list[tuple[int, int]]) -> list[bytes]:
    """The streams of images of one width (their indices one after another, starts: of each, and the end): what stands before the pixels, and these under the standard codes, with back-references and colour cache."""
    sizes, codes, _ = standard()
    cached = 280 + cache_places(0xFF000000, CACHE_BITS[True])
    symbol = index + (held_before(index, starts).astype(np.uint16) << np.uint16(8))
    value, bits = (np.concatenate([x[0][:256], x[0][cached]]).take(symbol) for x in (codes, sizes))
    found, shown = copies(index, LEAST_COPY[True], starts), np.ones(len(index), bool)
    for at, length, _ in found:
        shown[at + 1 : at + length] = False
    places, (lengths, backs) = copy_symbols(found, width)
    value[places], bits[places] = codes[0][256 + lengths[0]], sizes[0][256 + lengths[0]]
    put_copies(value, bits, places, lengths, backs, sizes[4], codes[4])
    # Each image begins with a word of its own.
    told = np.concatenate([[0], np.cumsum(shown)])[starts]
    value, bits = value[shown], bits[shown]
    ends = np.concatenate([[0], np.cumsum(bits)])
    before = np.array([n for _, n in heads])
    total = before + np.diff(ends[told])
    words = np.concatenate([[0], np.cumsum((total + 63) >> 6)])
    at = ends[:-1] + np.repeat(64 * words[:-1] + before - ends[told[:-1]], np.diff(told))
    raw, out = in_words(value, bits, at, int(words[-1])).tobytes(), []
    for (head, n), first, size in zip(heads, (8 * words).tolist(), ((total + 7) >> 3).tolist()):
        split = first + (n >> 3)
        head = (head | raw[split] << (n & ~7)).to_bytes((n >> 3) + 1, "little")
        out.append(head + raw[split + 1 : first + size])
    return out


def best_tiles(costs: np.ndarray, bits: int, down: np.ndarray | None = None) -> np.ndarray:
    """The cheapest choice of each tile (two to the power of bits a side, or from one row of `down` to the next), for costs (choice, row, column) of single pixels."""
    down, across = np.arange(0, costs.shape[1], 1 << bits) if down is None else down, np.arange(0, costs.shape[2], 1 << bits)
    return np.add.reduceat(np.add.reduceat(costs, across, axis=2, dtype=np.int64), down, axis=1).argmin(axis=0)


def spread(tiles: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def distance_from_zero(c: np.ndarray) -> np.ndarray:
    return np.minimum(c, -c)


def predicted(planes: np.ndarray, bits: int, heights: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """What a prediction leaves of the pixels of images that lie one below another, plane by plane (of bytes, alpha last if there are four), and the mode of each tile, image by image: from the left, from above, from either side of that, or means of these."""
    n_planes, height, width = len(planes), planes.shape[1] + len(heights), planes.shape[2]
    # Each image under a row of zeros, all in one line of pixels, so that a place's neighbours stand at fixed distances; first rows and columns are mended below.
    ends = np.cumsum(heights) + np.arange(1, len(heights) + 1)
    first = ends - heights
    own = np.ones(height, bool)
    own[first - 1] = False
    line = np.zeros((n_planes, (height + 1) * width + 1), np.uint8)
    corner, top, right, left, here = (line[:, k : k + height * width].reshape(n_planes, height, width) for k in (0, 1, 2, width, width + 1))
    here[:, own] = planes
    guesses = {1: left, 2: top, 3: right, 4: corner, 8: halfway(corner, top), 9: halfway(top, right)}
    rest = np.stack([here - g for g in guesses.values()])
    rest[:, :, first, 0] = here[:, first, 0]
    costs = distance_from_zero(rest)
    down = np.concatenate([np.concatenate([[a - 1], np.arange(a, b, 1 << bits)]) for a, b in zip(first.tolist(), ends.tolist())])
    tiles = own[down]
    mode = best_tiles(costs[:, 0] if n_planes == 1 else costs.sum(axis=1), bits, down)[tiles]
    out = np.empty_like(here)
    for a, b, line in zip(down[tiles].tolist(), np.append(down[1:], height)[tiles].tolist(), mode.tolist()):
        for x, k in enumerate(line):
            tile = (slice(None), slice(a, b), slice(x << bits, (x + 1) << bits))
            out[tile] = rest[k][tile]
    out[:, first, 1:], out[:, 1:, 0] = here[:, first, 1:] - here[:, first, :-1], here[:, 1:, 0] - here[:, :-1, 0]
    if n_planes == 4:
        out[3, first, 0] -= 255
    return out[:, own], np.split(np.array(list(guesses))[mode], np.cumsum([-(-h >> bits) for h in heights])[:-1])


def uncoloured(planes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Blue and red (planes 0 and 2) without their share of green, and each tile's factors as ARGB numbers; the reader adds what is taken here."""
    _, height, width = planes.shape
    factors = np.array([0, 8, 16, 32, -8, -16, -32], np.int16)
    green, out, chosen = planes[1].view(np.int8).astype(np.int16), planes.copy(), []
    for c in (2, 0):
        rest = planes[c] - (factors[:, None, None] * green >> 5).astype(np.uint8)
        best = best_tiles(distance_from_zero(rest), bits)
        out[c] = np.take_along_axis(rest, spread(best, bits, height, width)[None], 0)[0]
        chosen.append(factors[best] & 255)
    return out, factor_numbers(*chosen)


def factor_numbers(to_red: np.ndarray, to_blue: np.ndarray) -> np.ndarray:
    return np.uint32(0xFF000000) | to_blue.astype(np.uint32) << np.uint32(8) | to_red.astype(np.uint32)


def tile_bits(width: int) -> int:
    """Two tiles lie side by side, but none is smaller than 16 pixels a side or larger than 512."""
    return max(4, min(9, width.bit_length() - 2))


def side(n_pixels: int, least: int = 16) -> tuple[int, int]:
    """Width and height of n pixels: `least` across, or twice that and so on until the height fits and is a quarter of that at most (rows are the reader's steps)."""
    width = least
    while -(-n_pixels // width) > width // 4 and width < MAX_SIDE:
        width *= 2
    if -(-n_pixels // width) > MAX_SIDE:
        raise ValueError("more pixels than one image can hold")
    return width, -(-n_pixels // width)


@lru_cache(1024)
def small_image(argb: bytes, width: int, least: int) -> tuple[int, int]:
    """A palette, or the image of a transform's tiles, as one number with its bits."""
    fields = Fields()
    put_image(fields, np.frombuffer(argb, np.uint32), width, 0, False, least)
    return fields.whole()


@lru_cache(64)
def palette(values: bytes) -> tuple[int, int]:
    """A palette of what the transforms leave of greys, as one number with its bits: red and blue without green, each as its difference from the one before."""
    steps = np.diff(np.frombuffer(values, np.uint8), prepend=np.uint8(0)).astype(np.uint32)
    less = -steps.astype(np.uint8) & np.uint32(255)
    return joined((1, 1), (PALETTE, 2), (len(values) - 1, 8), small_image((less << np.uint32(16) | steps << np.uint32(8) | less).tobytes(), len(values), LEAST_COPY[False]))


def head(width: int, height: int, grey: bool, bits: int, modes: np.ndarray, factors: np.ndarray) -> tuple[int, int]:
    """A stream's beginning: size and three transforms, as one number with its bits."""
    modes, across = (np.uint32(0xFF000000) | modes.astype(np.uint32) << np.uint32(8)).tobytes(), modes.shape[1]
    return joined(
        (SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (int(not grey), 1), (0, 3),
        (1, 1), (PREDICTOR, 2), (bits - 2, 3), small_image(modes, across, 0),
        (1, 1), (CROSS_COLOUR, 2), (bits - 2, 3), small_image(factors.tobytes(), across, 0),
        (1, 1), (SUBTRACT_GREEN, 2),
    )


def in_file(stream: bytes) -> bytes:
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def encode_greys(payloads: list[bytes], width: int, heights: list[int]) -> list[bytes]:
    """encode() for grey images of one width, whose pixels are worked on together; no file depends on the others."""
    starts = np.concatenate([[0], np.cumsum(heights)])
    data = np.frombuffer(b"".join(p.ljust(width * h, b"\0") for p, h in zip(payloads, heights)), np.uint8).reshape(1, -1, width)
    bits = tile_bits(width)
    planes, modes = predicted(data, bits, heights)
    heads, alike, out = [], [], [b""] * len(payloads)
    for k, (payload, mode) in enumerate(zip(payloads, modes)):
        # Green tells all of red and blue: a factor of one (32 in 1/32) leaves nothing of them, in every tile.
        factors = factor_numbers(np.full(mode.shape, 32), np.full(mode.shape, 32))
        begin, index = head(width, heights[k], True, bits, mode, factors), planes[0, starts[k] : starts[k + 1]]
        values = np.flatnonzero(np.bincount(index.ravel(), minlength=256)).astype(np.uint8)
        if many := len(values) > 16:
            values = np.arange(256, dtype=np.uint8)
        begin = joined(begin, palette(values.tobytes()), (0, 1))
        if many and len(payload) < OWN_CODES_FROM:
            heads.append(joined(begin, (1, 1), (CACHE_BITS[True], 4), (0, 1), standard()[2]))
            alike.append(k)
            continue
        packed = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1 if len(values) <= 16 else 0
        if packed:
            place, together = np.zeros(256, np.uint8), 1 << packed
            place[values] = np.arange(len(values))
            parts = np.pad(place[index], ((0, 0), (0, -width % together))).reshape(heights[k], -1, together).astype(np.int64)
            index = (parts << (np.arange(together) * (8 >> packed))).sum(axis=-1)
        fields = Fields()
        fields.put(begin)
        put_image(fields, np.uint32(0xFF000000) | index.astype(np.uint32).ravel() << np.uint32(8), index.shape[1], CACHE_BITS[True], True, LEAST_COPY[True])
        out[k] = in_file(fields.bytes())
    if alike:
        kept = planes[0] if len(alike) == len(payloads) else np.concatenate([planes[0, starts[k] : starts[k + 1]] for k in alike])
        streams = under_standard_codes(kept.ravel(), np.concatenate([[0], np.cumsum([heights[k] * width for k in alike])]), width, heads)
        for k, stream in zip(alike, streams):
            out[k] = in_file(stream)
    return out


def encode_colours(payload: bytes) -> bytes:
    """encode() for an image of colour pixels."""
    width, height = side(len(payload) // 4)
    data, bits = np.frombuffer(payload.ljust(4 * width * height, b"\0"), np.uint8), tile_bits(width)
    planes, (modes,) = predicted(np.stack([data[k::4].reshape(height, width) for k in (2, 0, 1, 3)]), bits, [height])  # planes are B, G, R, A
    planes, factors = uncoloured(planes, bits)
    planes[[0, 2]] -= planes[1]
    fields = Fields()
    fields.put(head(width, height, False, bits, modes, factors), (0, 1))
    put_image(fields, np.ascontiguousarray(np.moveaxis(planes, 0, -1)).view(np.uint32).ravel(), width, CACHE_BITS[False], True, LEAST_COPY[False])
    return in_file(fields.bytes())


def encode_all(payloads: list[bytes], most_grey: int = MAX_SIDE * MAX_SIDE) -> list[bytes]:
    """Lossless WebP files that hold one payload each: as grey pixels of a byte each, or, where one image can't hold these (over most_grey bytes), as colour pixels of four bytes G, R, B, A.

    Each file goes through all that the format has. Pixels are predicted by tile; what green tells of red and blue is taken
    from them by tile, and green is subtracted. What is left of greys has as many colours as there are different bytes at
    most, so it has a palette: of its own with up to 16 colours, several to a pixel, or else all 256. The indices have
    back-references and a colour cache, under the standard codes up to OWN_CODES_FROM bytes, else under codes made for them.
    Colour pixels have more colours than a palette holds, and codes of their own. Zeros fill the last row.
    """
    out, alike = [b""] * len(payloads), {}
    for k, payload in enumerate(payloads):
        if len(payload) > most_grey:
            out[k] = encode_colours(payload)
        else:
            width, height = side(len(payload))
            # Long ones gain nothing by company.
            alike.setdefault((width, k if len(payload) >= OWN_CODES_FROM else -1), []).append((k, height))
    for (width, _), images in alike.items():
        for (k, _), file in zip(images, encode_greys([payloads[k] for k, _ in images], width, [h for _, h in images])):
            out[k] = file
    return out


def encode(payload: bytes, most_grey: int = MAX_SIDE * MAX_SIDE) -> bytes:
    """encode_all() of a single payload."""
    return encode_all([payload], most_grey)[0]


def is_grey(media: bytes) -> bool:
    """Whether a file of encode() has one byte in each pixel: it makes no use of alpha."""
    return not media[24] & 16


def samples(image: np.ndarray, grey: bool) -> bytes:
    """What encode() has put into the pixels: a byte each, or the bytes G, R, B, A of each."""
    if grey:
        return (image >> np.uint32(8)).astype(np.uint8).tobytes()
    return np.stack([(image.reshape(-1) >> np.uint32(s)).astype(np.uint8) for s in (8, 16, 0, 24)], axis=-1).tobytes()


def features(image: np.ndarray, stored: bytes) -> str:
    """Size, mean of each of four samples in turn to three places, and an average hash of 64 tiles of the image read as one line of samples (stored)."""
    data = np.frombuffer(stored, np.uint8)
    means = data.reshape(-1, 4).mean(axis=0)
    edges = np.arange(65) * len(data) // 64
    tiles = np.add.reduceat(data, edges[:-1], dtype=np.int64) / np.diff(edges)
    bits = np.packbits(tiles >= data.mean()).tobytes().hex()
    return f"{image.shape[1]}x{image.shape[0]};{','.join(f'{m:.3f}' for m in means)};{bits}"


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + b"\0" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, payload_bytes, media: each text as UTF-8, padded with zeros to a multiple of 64 bytes, as a lossless WebP file.

    Null and empty texts give one block of zeros. Texts over 1 GiB don't fit one image and stop the job. Equal texts give
    equal files, rows that repeat give repeated rows, and extra columns are ignored. No shuffle; a task holds about 2 MB of
    texts, or one longer text, at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = as_bytes(batch.column("text"))
            raw = data.tobytes()
            payloads = [padded(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array([len(p) for p in payloads], pa.int64()), pa.array(encode_all(payloads), pa.binary())], ["id", "n_bytes", "payload_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """store_texts() read back: its columns but media, and payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null or damaged file stops the job with BadImage: nothing is passed over. pixel_arrays() gives the pixels themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for size, media in zip(batch.column("payload_bytes").to_pylist(), batch.column("media").to_pylist()):
                image = decode(media or b"")
                stored = samples(image, is_grey(media))
                payload = stored[:size]
                rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(image, stored)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_bytes", "payload_bytes")), *columns], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    out = stored.select(F.col(id_col).alias("id"), "n_bytes", "payload_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)


def pixel_arrays(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """id, width, height, argb (array of long, row by row), error: the pixels of any lossless WebP column. Null media gives nulls; a damaged file gives its error and no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for data in batch.column("media").to_pylist():
                try:
                    image = None if data is None else decode(data)
                    rows.append((None,) * 4 if image is None else (image.shape[1], image.shape[0], image.reshape(-1).astype(np.int64), None))
                except BadImage as e:
                    rows.append((None, None, None, str(e)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "width", "height", "argb", "error"])

    kind = media.schema[id_col].dataType.simpleString()
    out = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, width int, height int, argb array<long>, error string")
    return out.withColumnRenamed("id", id_col)
