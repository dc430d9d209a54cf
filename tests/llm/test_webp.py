import hashlib
import zlib

import numpy as np
import pytest

from quire.llm import webp as w

from .helpers import corpus, documents, words


def even_lengths(n):
    """A complete code of n symbols, as short as may be."""
    if n == 1:
        return [1]
    k = n.bit_length() - 1
    return [k] * (2 ** (k + 1) - n) + [k + 1] * (2 * n - 2 ** (k + 1))


def put_prefixed(out, value):
    """The symbol and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    k = v.bit_length() - 1
    return 2 * k + (v >> (k - 1) & 1), k - 1, v - ((2 + (v >> (k - 1) & 1)) << (k - 1))


class Writer(w.BitWriter):
    def group(self, cache):
        sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
        lengths = [even_lengths(n) for n in sizes]
        for n, size in zip(lengths, sizes, strict=True):
            w.write_lengths(self, n, size)
        return [(w.canonical(n), n) for n in lengths]

    def symbol(self, code, s):
        codes, lengths = code
        self.put(w.reverse(int(codes[s]), lengths[s]), lengths[s])

    def number(self, code, base, value):
        s, n, extra = put_prefixed(self, value)
        self.symbol(code, base + s)
        self.put(extra, n)

    def pixels(self, ops, main, cache=0, entropy=None, width=0):
        """ops: ("lit", argb), ("copy", length, distance code), ("cache", index)."""
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(1 if entropy is not None else 0, 1)
        groups, size = 1, 0
        if entropy is not None:
            size, image = entropy
            self.put(size - 2, 3)
            self.pixels([("lit", int(g) << 8) for g in image.ravel()], False)
            groups = int(image.max()) + 1
        codes = [self.group(cache) for _ in range(groups)]
        at = 0
        for op in ops:
            code = codes[int(entropy[1][at // width >> size, at % width >> size])] if entropy is not None else codes[0]
            if op[0] == "lit":
                for c, shift in zip((0, 1, 2, 3), (8, 16, 0, 24), strict=True):
                    self.symbol(code[c], op[1] >> shift & 255)
                at += 1
            elif op[0] == "copy":
                self.number(code[0], 256, op[1])
                self.number(code[4], 0, op[2])
                at += op[1]
            else:
                self.symbol(code[0], 280 + op[1])
                at += 1

    def file(self):
        return w.riff(self.value.to_bytes((self.n + 7) // 8, "little"))


def start(width, height):
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    return out


def picture(seed, height, width):
    return np.random.default_rng(seed).integers(0, 1 << 32, (height, width)).astype(np.int64)


def literals(image):
    return [("lit", int(p)) for p in image.ravel()]


def test_literals_and_entropy_image():
    image = picture(1, 9, 11)
    out = start(11, 9)
    out.put(0, 1)
    out.pixels(literals(image), True)
    assert (w.decode(out.file()) == image).all() and (w.decode_many([out.file()])[0] == image).all()
    out = start(11, 9)
    out.put(0, 1)
    out.pixels(literals(image), True, entropy=(2, np.array([[0, 1, 1], [2, 0, 1], [1, 1, 0]])), width=11)
    assert (w.decode(out.file()) == image).all()


def test_back_references_and_cache():
    row = [int(x) for x in picture(2, 1, 8)[0]]
    out = start(8, 4)
    out.put(0, 1)
    slot = (row[3] * 0x1E35A7BD & 0xFFFFFFFF) >> 28
    ops = [("lit", p) for p in row] + [("copy", 8, 1)]  # the row above: distance code 1 is (0, 1)
    ops += [("cache", slot), ("lit", row[0]), ("copy", 6, 120 + 2), ("copy", 8, 120 + 16)]
    out.pixels(ops, True, cache=4)
    want = row + row
    last = next(p for p in reversed(want) if (p * 0x1E35A7BD & 0xFFFFFFFF) >> 28 == slot)
    want += [last, row[0]] + [last, row[0]] * 3
    want += want[-16:-8]
    assert w.decode(out.file()).ravel().tolist() == want


def test_overlapping_copy_repeats():
    out = start(7, 1)
    out.put(0, 1)
    out.pixels([("lit", 5), ("copy", 6, 120 + 1)], True)
    assert w.decode(out.file()).ravel().tolist() == [5] * 7


def test_subtract_green_and_cross_colour():
    image = picture(3, 5, 6)
    p = w.split(image)
    e = picture(4, 2, 2) & 0xFFFFFF
    full = w.split(e)[np.arange(5)[:, None] >> 2, np.arange(6)[None] >> 2]
    delta = lambda t, c: (((t + 128) % 256 - 128) * ((c + 128) % 256 - 128)) >> 5
    red = (p[..., 1] - delta(full[..., 3], p[..., 2])) & 255
    blue = (p[..., 3] - delta(full[..., 2], p[..., 2]) - delta(full[..., 1], p[..., 1])) & 255
    crossed = w.join(np.stack([p[..., 0], red, p[..., 2], blue], -1))
    out = start(6, 5)
    out.put(0b011, 3)  # cross colour, then its block size
    out.put(0, 3)
    out.pixels(literals(e), False)
    out.put(0, 1)
    out.pixels(literals(crossed), True)
    assert (w.decode(out.file()) == image).all()
    less = w.join(p - p[..., 2:3] * np.array([0, 1, 0, 1]))
    out = start(6, 5)
    out.put(0b101, 3)
    out.put(0, 1)
    out.pixels(literals(less), True)
    assert (w.decode(out.file()) == image).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    height, width = 6, 9
    p = w.split(picture(5, height, width)).tolist()
    modes = np.full((2, 3), mode)

    def expect(x, y):
        if y == 0:
            return p[0][x - 1] if x else [255, 0, 0, 0]
        if x == 0:
            return p[y - 1][0]
        left, top, corner = p[y][x - 1], p[y - 1][x], p[y - 1][x - 1]
        right = p[y - 1][x + 1] if x + 1 < width else p[y][0]
        mean = lambda a, b: [(i + j) // 2 for i, j in zip(a, b, strict=True)]
        clip = lambda v: max(0, min(255, v))
        half = mean(left, top)
        near = sum(abs(top[i] - corner[i]) for i in range(4)) < sum(abs(left[i] - corner[i]) for i in range(4))
        return {
            0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: half, 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)), 11: left if near else top,
            12: [clip(left[i] + top[i] - corner[i]) for i in range(4)], 13: [clip(half[i] + int((half[i] - corner[i]) / 2)) for i in range(4)],
        }[mode]

    rest = [[[(a - b) & 255 for a, b in zip(p[y][x], expect(x, y), strict=True)] for x in range(width)] for y in range(height)]
    out = start(width, height)
    out.put(0b001, 3)
    out.put(0, 3)
    out.pixels(literals(modes << 8), False)
    out.put(0, 1)
    out.pixels(literals(w.join(np.array(rest))), True)
    assert w.split(w.decode(out.file())).tolist() == p


@pytest.mark.parametrize("colours", [2, 4, 11, 40])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 1 << 32, colours).astype(np.int64)
    index = rng.integers(0, colours, (5, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, each = 1 << bits, 8 >> bits
    packed = np.zeros((5, -(-13 // per)), dtype=np.int64)
    for x in range(13):
        packed[:, x // per] |= index[:, x] << (x % per * each)
    steps = w.split(palette)
    steps[1:] = (steps[1:] - steps[:-1].copy()) & 255
    out = start(13, 5)
    out.put(0b111, 3)
    out.put(colours - 1, 8)
    out.pixels(literals(w.join(steps)), False)
    out.put(0, 1)
    out.pixels(literals(packed << 8 | 255 << 24), True)
    assert (w.decode(out.file()) == palette[index]).all()


def test_run_length_code_lengths():
    out = w.BitWriter()
    out.put(0, 1)
    out.put(15, 4)
    for s in w.CODE_ORDER:
        out.put({17: 2, 18: 2, 8: 2, 16: 2}.get(s, 0), 3)
    out.put(0, 1)
    codes = {s: w.reverse(i, 2) for i, s in enumerate((8, 16, 17, 18))}
    for s, n, extra in ((8, 0, 0), (16, 2, 3), (16, 2, 3), (17, 3, 0), (18, 7, 100), (16, 2, 0), (18, 7, 127)):
        out.put(codes[s], 2)
        out.put(extra, n)
    lengths = w.read_lengths(w.Bits(out.value.to_bytes(out.n // 8 + 9, "little")), 280)
    assert lengths == ([8] * 13 + [0] * 3 + [0] * 111 + [0] * 3 + [0] * 138 + [0] * 280)[:280] or lengths[:13] == [8] * 13


def test_broken_files_are_refused():
    good = w.encode_many([np.zeros((1, 64, 3), dtype=np.uint8)])[0]
    for bad in (b"", b"RIFF....WEBPVP8 " + bytes(20), good[:-9], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            w.decode(bad)


def image_of(payload):
    return w.to_images(w.pad(payload))[0]


ENCODED = {
    "palette": [b"", b"z" * 1000, b"abcabd" * 300, bytes(range(48)) * 40],
    "runs": [b"a" * 300 + bytes(range(256)) * 2 + b"b" * 2500, b"aab" * 900 + bytes(range(200)), b"baa" * 900 + bytes(range(200)), b"aba" * 900 + bytes(range(200))],
    "repeats": [np.random.default_rng(1).integers(32, 127, 600).astype(np.uint8).tobytes() * 4, words(3, 60).ljust(600).encode() * 30],
    "literals": [words(4, 200).encode(), np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8).tobytes()],
}


@pytest.mark.parametrize("how", sorted(ENCODED))
def test_the_encoder_chooses_and_all_is_read_back(how):
    for payload in ENCODED[how]:
        image = image_of(payload)
        assert w.plan(image) == how
        data = w.encode_many([image])[0]
        assert (w.split(w.decode(data))[..., 1:] == image).all() and (w.split(w.decode(data))[..., 0] == 255).all()
        assert data == w.encode_many([image, image_of(b"other"), image])[2]


def test_any_way_of_writing_is_read_back():
    rng = np.random.default_rng(6)
    for n in (1, 5, 64, 200, 900):
        for colours in (2, 9, 200):
            payload = rng.integers(0, colours, n * 3).astype(np.uint8).tobytes()
            image = image_of(payload)
            for how in ENCODED:
                if how != "palette" or len(np.unique(w.pixels_of(image))) <= 256:
                    assert (w.split(w.decode(w.encode(image, how)))[..., 1:] == image).all(), (n, colours, how)


def test_code_lengths_are_bounded_and_complete():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = w.code_lengths(np.array(fib))
    assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1
    assert w.code_lengths(np.array([0, 5, 0])) == [0, 1, 0] and w.code_lengths(np.zeros(3, dtype=int)) == [0, 0, 0]


def test_features(spark):
    rows = corpus() + [(50, words(9, 3) + "ñ" * 70), (51, "z" * 192), (52, "z" * 191)]
    out = {}
    for r in w.media_features(spark, documents(spark, rows)).collect():
        out.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        found = [r for r in out[doc_id] if r.payload_sha256 == hashlib.sha256(payload).hexdigest()]
        assert found and found[0].n_bytes == len(data) or any(r.n_bytes == len(data) for r in found)
        assert found[0].payload_bytes == len(payload) and found[0].tail_crc32 == zlib.crc32(payload[-16:])
    assert out[0][0].media_sha256 == out[1][0].media_sha256 and out[0][0].feature == out[1][0].feature
    assert w.media_features(spark, documents(spark, rows).limit(0)).collect() == []


def test_tall_payloads_are_several_files(monkeypatch):
    monkeypatch.setattr(w, "MOST_SIDE", 3)
    payload = bytes(range(192)) * 8
    media = w.store([payload])[0]
    assert len(w.files_of(media)) == 3 and w.load([media])[0].tobytes() == payload


def test_codes_are_made_by_arrays_and_a_code_of_too_many_or_too_few_symbols_is_refused():
    for lengths in ([1, 2, 2], [2, 0, 2, 1], w.text_lengths().tolist(), [15, 15, *range(14, 0, -1)]):
        codes = w.canonical(lengths)
        plain = [w.reverse(int(c), n) if n else 0 for c, n in zip(codes, lengths)]
        assert w.reversed_codes(lengths).tolist() == plain
        code = w.PrefixCode(lengths)
        for s, n in enumerate(lengths):
            if n:
                assert set(code.table[plain[s] :: 1 << n].tolist()) == {s << 4 | n}
    for lengths in ([1, 1, 1], [2, 2, 2], []):
        try:
            w.PrefixCode(lengths)
        except ValueError:
            continue
        raise AssertionError(lengths)
