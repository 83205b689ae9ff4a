"""The decoder of lossless WebP on streams written bit by bit here, with pixels worked out by hand or by the format's formulas."""

import random

import numpy as np
import pytest

from cuelake.llm import webp

LONE = lambda symbol: [(1, 1), (0, 1), (1, 1), (symbol, 8)]
#: 256 symbols of 8 bits: of the code length symbols only 8 is used, so each of the 256 lengths takes no bits.
FLAT = [(0, 1), (8, 4), *[(0, 3)] * 11, (1, 3), (1, 1), (3, 3), (254, 8)]
NO_CACHE = [(0, 1)]


def flipped(symbol):
    return int(f"{symbol:08b}"[::-1], 2), 8


def literal(argb):
    a, r, g, b = (argb >> s & 255 for s in (24, 16, 8, 0))
    return [flipped(x) for x in (g, r, b, a)]


def plain_image(pixels, top):
    return [*NO_CACHE, *([(0, 1)] if top else []), *FLAT * 4, *LONE(0), *(f for p in pixels for f in literal(p))]


def media(width, height, *parts):
    value = at = 0
    for v, n in [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), *(f for p in parts for f in p)]:
        value |= v << at
        at += n
    data = value.to_bytes(-(-at // 8), "little")
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def pixels(*args):
    return webp.decode(media(*args)).tolist()


def test_simple_codes():
    two = [(1, 1), (1, 1), (1, 1), (5, 8), (9, 8)]  # symbols 5 and 9, one bit each
    got = pixels(3, 1, [(0, 1), *NO_CACHE, (0, 1)], two, LONE(1), LONE(2), LONE(255), LONE(0), [(0, 1), (1, 1), (0, 1)])
    assert got == [[0xFF010502, 0xFF010902, 0xFF010502]]


def test_code_lengths_in_runs_and_copies_from_near_and_far():
    # Green: lengths 2, 2, 2 (repeated by 16) for 0 to 2, zeros by 18 and 17, then length 2 for 257, a copy of two pixels.
    own = {2: 2, 16: 2, 17: 2, 18: 2}
    order = [own.get(s, 0) for s in webp.CODE_LENGTH_ORDER]
    codes = {2: 0b00, 16: 0b10, 17: 0b01, 18: 0b11}  # 2, 16, 17, 18 are 00, 01, 10, 11, first bit first
    green = [(0, 1), (15, 4), *((n, 3) for n in order), (0, 1)]
    token = lambda s, v=0, n=0: [(codes[s], 2), (v, n)]
    green += [*token(2), *token(2), *token(2), *token(18, 138 - 11, 7), *token(18, 105 - 11, 7), *token(17, 8, 3 + 0)[:1], (8 - 3, 3), *token(17)[:1], (3 - 3, 3), *token(2), *token(18, 22 - 11, 7)]
    distances = [(1, 1), (1, 1), (1, 1), (1, 8), (14, 8)]  # symbols 1 and 14: distance codes 2, and 129 and more with 6 bits more
    head = [(0, 1), *NO_CACHE, (0, 1), *green, *LONE(7), *LONE(8), *LONE(255), *distances]
    zero, one, two, copy = (0b00, 2), (0b10, 2), (0b01, 2), (0b11, 2)
    image = lambda g: 0xFF070008 | g << 8
    # Distance code 2 is the pixel to the left; code 129 + 0 is distance 9 in a line.
    got = pixels(13, 1, head, [zero, one, two, copy, (0, 1), zero, one, two, two, copy, (1, 1), (0, 6), zero, zero])
    assert got == [[image(g) for g in (0, 1, 2, 2, 2, 0, 1, 2, 2, 0, 1, 0, 0)]]


def test_colour_cache():
    cached = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 31
    red = next(p for p in (0xFF010203 + k for k in range(99)) if cached(p) == 1)
    blue = next(p for p in (0xFF030901 + k for k in range(99)) if cached(p) == 0)
    # Green: the two greens and the two cache places with two bits each.
    lengths = {red >> 8 & 255: 2, blue >> 8 & 255: 2, 280: 2, 281: 2}
    sizes = np.zeros(282, np.int64)
    sizes[list(lengths)] = 2
    fields = webp.Fields()
    webp.put_code(fields, sizes)
    green = [(int(v), int(n)) for v, n in zip(np.concatenate(fields.values), np.concatenate(fields.sizes))]
    codes = {s: k for k, s in enumerate(sorted(lengths))}
    bit = lambda s: (int(f"{codes[s]:02b}"[::-1], 2), 2)
    rest = lambda p: [flipped(x) for x in (p >> 16 & 255, p & 255, p >> 24)]
    data = [bit(red >> 8 & 255), *rest(red), bit(blue >> 8 & 255), *rest(blue), bit(280), bit(281), bit(281)]
    got = pixels(5, 1, [(0, 1), (1, 1), (1, 4), (0, 1)], green, FLAT, FLAT, FLAT, LONE(0), data)
    assert got == [[red, blue, blue, red, red]]


def test_groups_of_codes_by_tile():
    groups = plain_image([0xFF000000, 0xFF000100], False)  # the left tile has group 0, the right one 1
    got = pixels(8, 1, [(0, 1), *NO_CACHE, (1, 1), (0, 3)], groups, LONE(10), LONE(1), LONE(2), LONE(3), LONE(0), LONE(20), LONE(4), LONE(5), LONE(6), LONE(0))
    assert got == [[0x03010A02] * 4 + [0x06041405] * 4]


def expected(rest, modes, shift, width, height):
    """The format's definition of the predictors, channel by channel."""
    split = lambda p: [p >> s & 255 for s in (24, 16, 8, 0)]
    out = [[None] * width for _ in range(height)]
    mean = lambda a, b: (a + b) // 2
    clamp = lambda v: max(0, min(255, v))
    for y in range(height):
        for x in range(width):
            if (x, y) == (0, 0):
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = out[0][x - 1]
            elif x == 0:
                guess = out[y - 1][0]
            else:
                ll, tt, cc = out[y][x - 1], out[y - 1][x], out[y - 1][x - 1]
                rr = out[y - 1][x + 1] if x + 1 < width else out[y][0]
                mode = modes[y >> shift][x >> shift]
                if mode == 11:
                    p = [a + b - c for a, b, c in zip(ll, tt, cc)]
                    guess = ll if sum(abs(a - b) for a, b in zip(p, ll)) < sum(abs(a - b) for a, b in zip(p, tt)) else tt
                else:
                    guess = []
                    for left, top, corner, right in zip(ll, tt, cc, rr):
                        half = mean(left, top)
                        simple = {1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: half, 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}
                        guess.append({12: clamp(left + top - corner), 13: clamp(half + int((half - corner) / 2))}.get(mode, simple.get(mode)))
                    guess = [255, 0, 0, 0] if mode in (0, 14, 15) else guess
            out[y][x] = [(a + b) & 255 for a, b in zip(split(rest[y * width + x]), guess)]
    return [[a << 24 | r << 16 | g << 8 | b for a, r, g, b in row] for row in out]


@pytest.mark.parametrize("mode", range(15))
def test_predictors(mode):
    r = random.Random(mode)
    rest = [r.getrandbits(32) for _ in range(6 * 5)]
    modes = [[mode, (mode + 3) % 14], [(mode + 7) % 14, mode]]
    tiles = plain_image([0xFF000000 | m << 8 for row in modes for m in row], False)
    got = pixels(6, 5, [(1, 1), (0, 2), (0, 3)], tiles, [(0, 1)], plain_image(rest, True))
    assert got == expected(rest, modes, 2, 6, 5)


def test_cross_colour_and_green():
    # Factors are 3.5 bit fixed point numbers: 32 takes all of green to red, 16 half of it to blue, -32 takes red from blue.
    factors = plain_image([0xFF000000 | (256 - 32) << 16 | 16 << 8 | 32], False)
    got = pixels(2, 1, [(1, 1), (1, 2), (0, 3)], factors, [(0, 1)], plain_image([0xFF640A05, 0xFF00C800], True))
    # Second pixel: green is -56, so red is -56 and blue is -28 + 56.
    assert got == [[0xFF000000 | 110 << 16 | 10 << 8 | (5 + 5 - 110) & 255, 0xFF000000 | 200 << 16 | 200 << 8 | 28]]
    got = pixels(1, 1, [(1, 1), (2, 2), (0, 1)], plain_image([0xFF010AFA], True))
    assert got == [[0xFF0B0A04]]


def test_palette_with_several_pixels_in_one():
    table = plain_image([0xFF000001, 0x00000100, 0x00010000], False)  # each colour as its difference from the one before
    # Four colours or fewer: four pixels in a green byte, the first lowest; an index without a colour is transparent.
    got = pixels(6, 1, [(1, 1), (3, 2), (2, 8)], table, [(0, 1)], plain_image([0xFF000000 | 0b11_10_01_00 << 8, 0xFF000000 | 0b0001 << 8], True))
    assert got == [[0xFF000001, 0xFF000101, 0xFF010101, 0, 0xFF000101, 0xFF000001]]


def test_early_ends_and_bad_copies_are_told():
    whole = media(3, 1, [(0, 1)], plain_image([1, 2, 3], True))
    with pytest.raises(webp.BadImage):
        webp.decode(whole[:20] + whole[20:-8])
    copy = [(0, 1), *NO_CACHE, (0, 1), (0, 1), (0, 4)]
    with pytest.raises(webp.BadImage):
        webp.decode(media(3, 1, copy))


def payloads():
    r = random.Random(1)
    yield from (b"", b"a", b"ab" * 40, bytes(range(256)) * 3, bytes(300), r.randbytes(5000), b"x" * 70_000, b"abc" * 9000, "é한 \n".encode() * 500)
    for n in range(600):
        yield bytes(r.choice(b"abcd \n" if n % 2 else bytes(range(256))) for _ in range(r.randint(0, 900)))
    words = [f"w{r.randint(0, 999)}".encode() for _ in range(400)]
    yield b" ".join(r.choice(words) for _ in range(30_000))


def test_every_kind_of_file_comes_back():
    kinds = set()
    for payload in map(webp.padded, payloads()):
        file = webp.encode(payload)
        kinds.add((min(webp.zlib.crc32(payload) & 127, 2), len(set(payload)) > 16))
        assert webp.samples(webp.decode(file), webp.is_grey(file))[: len(payload)] == payload
    assert {k for k, _ in kinds} == {0, 1, 2} and (2, True) in kinds and (2, False) in kinds
    text = webp.padded(b" ".join(f"the words of line {k}".encode() for k in range(300)))
    assert len(webp.encode(text)) < 0.6 * len(text)


def test_code_lengths_fill_their_code():
    r = random.Random(2)
    for _ in range(60):
        counts = np.array([r.choice([0, 0, 1, 5, 4**r.randint(0, 14)]) for _ in range(r.choice([19, 40, 280]))])
        lengths = webp.code_lengths(counts)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= webp.LONGEST_CODE
        if (counts > 0).sum() > 1:
            assert (1 / 2.0 ** lengths[lengths > 0]).sum() == 1
