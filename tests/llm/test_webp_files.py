"""What the encoder of lossless WebP writes: each file goes through all transforms, and the quick ways of the reader give what the plain ones do."""

import random

import numpy as np
import pytest

from cuelake.llm import webp


def texts():
    r = random.Random(8)
    words = [f"w{r.randint(0, 400)}" for _ in range(90)] + ["café", "한글"]
    return [webp.padded(" ".join(r.choice(words) for _ in range(n)).encode()) for n in range(20, 900, 11)]


def test_each_file_has_all_transforms_and_a_cache(monkeypatch):
    seen = []
    inner = {name: getattr(webp, name) for name in ("unpredict", "uncross", "colours", "told_by_runs", "told_one_by_one")}
    monkeypatch.setattr(webp, "unpredict", lambda image, modes, shift: seen.append(("modes", set((modes >> 8 & 15).ravel().tolist()))) or inner["unpredict"](image, modes, shift))
    monkeypatch.setattr(webp, "uncross", lambda image, factors, shift: seen.append(("factors", set((factors & 0xFFFF).ravel().tolist()))) or inner["uncross"](image, factors, shift))
    monkeypatch.setattr(webp, "colours", lambda steps: seen.append(("palette", {len(steps) // 4})) or inner["colours"](steps))
    for name in ("told_by_runs", "told_one_by_one"):
        monkeypatch.setattr(webp, name, lambda *args, f=inner[name]: seen.append(("told", set(np.frombuffer(out := f(*args), np.uint16).tolist()))) or out)
    for payload in texts():
        seen.clear()
        image = webp.decode(webp.encode(payload))
        found = {}
        for kind, values in seen:
            found.setdefault(kind, set()).update(values)
        assert found["modes"] <= {1, 2, 3, 4, 8, 9} and found["modes"]
        assert found["factors"] == {32 << 8 | 32} and found["palette"] == {256}
        assert any(s < 256 for s in found["told"]) and any(s >= 280 for s in found["told"])
        grey = image.view(np.uint8).reshape(-1, 4)
        assert (grey[:, :3] == grey[:, 1:2]).all() and (grey[:, 3] == 255).all() and grey[: len(payload), 1].tobytes() == payload


def test_colour_images_come_back():
    r = random.Random(9)
    for payload in [*texts()[::6], *(webp.padded(r.randbytes(n)) for n in (1, 300, 5000))]:
        file = webp.encode(payload, most_grey=0)
        assert not webp.is_grey(file) and webp.samples(webp.decode(file), False)[: len(payload)] == payload


def test_runs_give_what_single_symbols_do(monkeypatch):
    both = []

    def told(bits, group, width, count):
        start = bits.at
        want = webp.told_one_by_one(bits, group, width, count)
        end, bits.at = bits.at, start
        assert inner(bits, group, width, count) == want and bits.at == end
        both.append(count)
        return want

    inner = webp.told_by_runs
    monkeypatch.setattr(webp, "told_by_runs", told)
    for payload in texts() + [webp.padded(b"the same line of words\n" * 400), webp.padded(b"ab" * 40_000)]:
        webp.decode(webp.encode(payload))
    assert len(both) > 50


def test_images_that_end_with_a_copy_come_back():
    # Behind the last copy stand bits of no meaning, which may look like another one.
    r = random.Random(12)
    words = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(50)]
    for k in range(60):
        line = b" ".join(r.choice(words) for _ in range(r.randint(3, 40)))
        for payload in (webp.padded(line * r.randint(1, 30)), webp.padded(b" ".join(r.choice(words) for _ in range(15_000)) + line * 9)):
            assert webp.samples(webp.decode(webp.encode(payload)), True)[: len(payload)] == payload


def test_files_that_end_early_are_told():
    for payload in texts()[:30]:  # codes in use
        webp.decode(webp.encode(payload))
    file = webp.encode(texts()[40])
    size = int.from_bytes(file[16:20], "little")
    for cut in (1, 2, 5, 40, size // 2, size - 30):
        short = size - cut
        with pytest.raises(webp.BadImage):
            webp.decode(file[:16] + short.to_bytes(4, "little") + file[20 : 20 + short])


def test_a_cache_whose_places_change_hands_is_followed():
    # Six bits: 64 places for 256 greens, so the colour cache has to be kept pixel by pixel.
    r = random.Random(10)
    argb = np.array([0xFF000000 | r.randint(0, 255) << 8 for _ in range(3000)], np.uint32)
    fields = webp.Fields()
    fields.put((webp.SIGNATURE, 8), (59, 14), (49, 14), (1, 1), (0, 3), (0, 1))
    webp.put_image(fields, argb, 60, 6, True, 3)
    stream = fields.bytes()
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    assert (webp.decode(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk).ravel() == argb).all()


def test_tiles_done_at_once_give_what_rows_do():
    r = np.random.default_rng(11)
    for _ in range(20):
        rest = r.integers(0, 1 << 32, (21, 37), dtype=np.uint32)
        modes = r.choice([0, 1, 2, 4, 8, 14], (3, 5)).astype(np.uint32) << np.uint32(8)
        out = webp.as_channels(rest.copy())
        got = webp.as_channels(webp.unpredict(rest, modes, 3)).astype(int)
        want = np.zeros(out.shape, int)
        for y in range(21):
            for x in range(37):
                mode = int(modes[y >> 3, x >> 3] >> 8)
                if y and x:
                    left, top, corner = want[y, x - 1], want[y - 1, x], want[y - 1, x - 1]
                    guess = {1: left, 2: top, 4: corner, 8: (corner + top) // 2}.get(mode, np.array([0, 0, 0, 255]))
                else:
                    guess = want[y - 1, 0] if y else want[0, x - 1] if x else np.array([0, 0, 0, 255])
                want[y, x] = (out[y, x] + guess) & 255
        assert (got == want).all()


def test_files_made_together_are_those_made_alone_and_share_the_steps(monkeypatch):
    r = random.Random(13)
    few, long = [webp.padded(bytes(r.choice(b"ab") for _ in range(n))) for n in (1, 70, 900)], webp.padded(b" ".join(r.choice([b"one", b"two", b"three"]) for _ in range(15_000)))
    # Neighbours with the same words: nothing may be copied from one image into the next.
    payloads = [p for text in texts() for p in (text, text, text[:-64] or text)] + [*few, long, webp.padded(b""), webp.padded(r.randbytes(3000))]
    r.shuffle(payloads)
    alone = [webp.encode(p) for p in payloads]
    calls = []
    inner = webp.predicted
    monkeypatch.setattr(webp, "predicted", lambda *args: calls.append(1) or inner(*args))
    assert webp.encode_all(payloads) == alone
    assert len(calls) <= 7 < len(payloads)  # once for each width, and for a long text
    for payload, file in zip(payloads, alone):
        assert webp.samples(webp.decode(file), True)[: len(payload)] == payload
    assert webp.encode_all([]) == []
