"""Lossless WebP: a VP8L decoder, an encoder, and media columns made of text payloads.

``decode`` reads any lossless file: prefix codes (one group or an entropy image of groups), back-references, the
colour cache, and the predictor, cross-colour, subtract-green and palette transforms.  ``decode_many`` decodes
images of one prefix group that hold literals only in step, a pixel of each image at a time by NumPy, and hands
others to ``decode``.  The encoder looks at an image and chooses, by fixed rules: a palette, for few colours;
subtract-green or cross-colour, where channels are equal; the left predictor, where neighbours are; back-references and
the colour cache, where stretches of pixels come again; and else literals under one fixed set of prefix codes, which
are cheap to write and read.  Equal pixels give equal bytes.

Payloads become rows of 8-bit RGB pixels.  Defined results.  A null text is empty; a payload is its UTF-8 bytes
and spaces up to a positive multiple of UNIT bytes.  Payloads beyond the largest image are several files, one after the
other, so a text may be of any length.  Repeated rows each get their row; an empty table gives none.  Only doc_id and
text are read; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.shared import Tables

UNIT, WIDTH, MOST_SIDE = 192, 64, 16384
#: Bytes of text that are coded together.
BATCH_BYTES = 8 << 20
#: Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
#: (dx, dy) that the first 120 distance codes stand for.
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads a byte string from each byte's least bit on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the image data ends early")
        out = self.peek(n)
        self.at += n
        return out


def canonical(lengths: Sequence[int]) -> np.ndarray:
    """Codes for code lengths, in the order of lengths then symbols."""
    lengths = np.asarray(lengths, dtype=np.int64)
    counts = np.bincount(lengths, minlength=16)
    order = np.argsort(lengths, kind="stable")[counts[0] :]
    codes, first, code = np.zeros(len(lengths), dtype=np.int64), np.zeros(16, dtype=np.int64), 0
    for n in range(1, 16):
        first[n] = code = code << 1
        code += int(counts[n])
    ends = np.cumsum(counts) - counts[0]
    codes[order] = first[lengths[order]] + np.arange(len(order)) - (ends - counts)[lengths[order]]
    return codes


def reverse(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


#: The numbers of 16 bits, turned around.
REVERSED = np.array([reverse(x, 16) for x in range(1 << 16)], dtype=np.int64)


def reversed_codes(lengths: Sequence[int]) -> np.ndarray:
    """The canonical codes of a complete prefix code, turned around; 0 for symbols without one."""
    return REVERSED[canonical(lengths)] >> (16 - np.asarray(lengths))


class PrefixCode:
    """A table of 2**bits entries, each symbol << 4 | length."""

    def __init__(self, lengths: Sequence[int]):
        lengths = np.asarray(lengths, dtype=np.int64)
        used = np.flatnonzero(lengths)
        if len(used) == 1:  # the only symbol takes no bits
            self.bits, self.table = 0, np.array([used[0] << 4], dtype=np.int64)
        else:
            self.bits = int(lengths.max(initial=0))
            used = used[np.argsort(lengths[used], kind="stable")]
            table = np.repeat(used << 4 | lengths[used], 1 << (self.bits - lengths[used]))
            if len(table) != 1 << self.bits:
                raise ValueError("a prefix code is not complete")
            self.table = table[REVERSED[: len(table)] >> (16 - self.bits)]
        self.cells, self.mask = memoryview(self.table), (1 << self.bits) - 1

    def read(self, bits: Bits) -> int:
        at = bits.at
        i = at >> 3
        x = self.cells[int.from_bytes(bits.data[i : i + 8], "little") >> (at & 7) & self.mask]
        bits.at = at + (x & 15)
        return x >> 4


def read_lengths(bits: Bits, symbols: int) -> list[int]:
    lengths = [0] * symbols
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        chosen = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in chosen:
            lengths[s] = 1
        return lengths
    code = [0] * 19
    for i in range(4 + bits.read(4)):
        code[CODE_ORDER[i]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    reader, at, before = PrefixCode(code), 0, 8
    while at < symbols and most:
        most -= 1
        s = reader.read(bits)
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
            continue
        run, value = _run_value(s, bits, before)
        if at + run > symbols:
            raise ValueError("a run of code lengths is too long")
        lengths[at : at + run] = [value] * run
        at += run
    return lengths


def _run_value(s: int, bits: Bits, before: int) -> tuple[int, int]:
    if s == 16:
        return 3 + bits.read(2), before
    return (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)


def prefixed(bits: Bits, s: int) -> int:
    """A length or distance: a prefix symbol and its extra bits."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def read_group(bits: Bits, cache: int) -> list[PrefixCode]:
    return [PrefixCode(read_lengths(bits, n)) for n in (256 + 24 + (1 << cache if cache else 0), 256, 256, 256, 40)]


def read_cache_bits(bits: Bits) -> int:
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("the colour cache is too large")
    return cache


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, one 32-bit ARGB value a pixel."""
    cache_bits = read_cache_bits(bits)
    size, entropy, groups = 0, None, 1
    if main and bits.read(1):
        size = bits.read(3) + 2
        entropy = (read_pixels(bits, (width + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False) >> 8) & 0xFFFF
        groups = int(entropy.max()) + 1
    codes = [read_group(bits, cache_bits) for _ in range(groups)]
    out = [0] * (width * height)
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    at, total, cached = 0, width * height, 0

    def fill(upto: int) -> None:
        for p in out[cached:upto] if cache_bits else ():
            cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = p

    while at < total:
        group = codes[int(entropy[at // width >> size, at % width >> size])] if entropy is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = prefixed(bits, s - 256)
            d = prefixed(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = DISTANCES[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - d]
            at += length
        else:
            fill(at)
            cached = at
            out[at] = cache[s - 280]
            at += 1
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image data ends early")
    return np.array(out, dtype=np.int64).reshape(height, width)


def split(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of alpha, red, green, blue."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def join(parts: np.ndarray) -> np.ndarray:
    p = parts.astype(np.int64) & 255
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def predict(mode: int, left, top, topright, topleft):
    """The predicted pixel of one of the 14 modes; pixels are sequences of four channel values."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clip = lambda v: min(255, max(0, v))
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, topright, topleft)[mode - 1]
    if mode == 5:
        return mean(mean(left, topright), top)
    if mode <= 9:
        return mean(*((left, topleft), (left, top), (topleft, top), (top, topright))[mode - 6])
    if mode == 10:
        return mean(mean(left, topleft), mean(top, topright))
    if mode == 11:  # the neighbour nearer to left + top - topleft
        to_left = sum(abs(t - c) for t, c in zip(top, topleft, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(left, topleft, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(a + t - c) for a, t, c in zip(left, top, topleft, strict=True)]
    half = mean(left, top)
    return [clip(h + int((h - c) / 2)) for h, c in zip(half, topleft, strict=True)]


def unpredict(argb: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    height, width = argb.shape
    rest = split(argb).tolist()
    for y in range(height):
        row, above = rest[y], rest[y - 1]
        for x in range(width):
            if y == 0:
                p = row[x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                p = above[0]
            else:
                # right of the last column stands the row's own first pixel
                right = above[x + 1] if x + 1 < width else row[0]
                p = predict(int(modes[y >> size, x >> size]) & 15, row[x - 1], above[x], right, above[x - 1])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p, strict=True)]
    return join(np.array(rest, dtype=np.int64).reshape(height, width, 4))


def signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) & 255 ^ 128) - 128


def colour_delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return signed(t) * signed(c) >> 5


def uncross(argb: np.ndarray, elements: np.ndarray, size: int) -> np.ndarray:
    height, width = argb.shape
    e = split(elements)[np.arange(height)[:, None] >> size, np.arange(width)[None, :] >> size]
    p = split(argb)
    red = (p[..., 1] + colour_delta(e[..., 3], p[..., 2])) & 255
    blue = (p[..., 3] + colour_delta(e[..., 2], p[..., 2]) + colour_delta(e[..., 1], red)) & 255
    return join(np.stack([p[..., 0], red, p[..., 2], blue], axis=-1))


def read_palette(bits: Bits) -> np.ndarray:
    n = bits.read(8) + 1
    steps = split(read_pixels(bits, n, 1, False)[0])
    return join(np.cumsum(steps, axis=0) & 255)


def packing(colours: int) -> int:
    """log2 of the pixels that one index byte holds."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unindex(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = packing(len(palette))
    per, each = 1 << bits, 8 >> bits
    x = np.arange(width)
    index = (argb >> 8 & 255)[:, x >> bits] >> ((x & (per - 1)) * each) & ((1 << each) - 1)
    table = np.zeros(256, dtype=np.int64)
    table[: len(palette)] = palette
    return table[index]


def image_data(data: bytes) -> bytes:
    """The VP8L bitstream of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("the file has no lossless image")


def read_size(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("the lossless signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file's pixels, (height, width) of 32-bit ARGB."""
    bits = Bits(image_data(data))
    width, height = read_size(bits)
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            size = bits.read(3) + 2
            blocks = read_pixels(bits, (wide + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            undo.append((lambda p, b=blocks, s=size: unpredict(p, b >> 8 & 255, s)) if kind == 0 else (lambda p, b=blocks, s=size: uncross(p, b, s)))
        elif kind == 2:
            undo.append(lambda p: join(split(p) + (p >> 8 & 255)[..., None] * np.array([0, 1, 0, 1])))
        else:
            palette = read_palette(bits)
            undo.append(lambda p, t=palette, w=wide: unindex(p, t, w))
            wide = (wide + (1 << packing(len(palette))) - 1) >> packing(len(palette))
    pixels = read_pixels(bits, wide, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels


class Groups:
    """Prefix-code groups by the bits that declare them, so that equal declarations are read once."""

    def __init__(self):
        self.known: list[tuple[int, int, list[PrefixCode]]] = []

    def at(self, body: bytes, at: int) -> tuple[list[PrefixCode], int]:
        head = int.from_bytes(body[:4096], "little") >> at
        for n, value, group in self.known:
            if head & ((1 << n) - 1) == value and at + n <= 8 * len(body):
                return group, at + n
        bits = Bits(body, at)
        group = read_group(bits, 0)
        n = bits.at - at
        if len(self.known) < 64 and bits.at < 8 * 4096:
            self.known.append((n, head & ((1 << n) - 1), group))
        return group, bits.at


def decode_many(files: Sequence[bytes]) -> list[np.ndarray]:
    """``decode`` of each file, in step where images have one group and literals only."""
    out: list[np.ndarray | None] = [None] * len(files)
    same: dict[int, tuple[list[PrefixCode], list]] = {}
    groups = Groups()
    for i, data in enumerate(files):
        body = image_data(data)
        bits = Bits(body)
        width, height = read_size(bits)
        if bits.read(3) == 0:  # no transform, no cache, one group
            group, at = groups.at(body, bits.at)
            same.setdefault(id(group), (group, []))[1].append((i, body, width, height, at))
    for group, images in same.values():
        _in_step(group, images, out)
    return [decode(files[i]) if p is None else p for i, p in enumerate(out)]


def _in_step(group: list[PrefixCode], images: list, out: list) -> None:
    images.sort(key=lambda x: -x[2] * x[3])
    n = np.array([w * h for _, _, w, h, _ in images])
    offsets = np.concatenate([[0], np.cumsum([len(b) for _, b, *_ in images])])
    data = np.frombuffer(b"".join(b for _, b, *_ in images) + bytes(8), dtype=np.uint8)
    # the 64 bits from each byte on would take too much memory; 32 from each byte on serve codes of 15 bits
    words = np.zeros(len(data) - 7, dtype=np.uint32)
    for k in range(4):
        words |= data[k : k + len(words)].astype(np.uint32) << np.uint32(8 * k)
    at = np.array([a for *_, a in images]) + 8 * offsets[:-1]
    ends = 8 * offsets[1:]
    pixels = np.zeros(int(n.sum()), dtype=np.int64)
    place = np.cumsum(n) - n
    alive = np.ones(len(images), dtype=bool)
    tables = [(g.table.astype(np.uint32), np.uint32(g.mask), g.bits) for g in group[:4]]
    refers = bool((group[0].table >> 4 > 255).any())
    for step in range(int(n[0])):
        live = int(np.searchsorted(-n, -step, "left"))  # the images that have a pixel here come first
        here, value, room = at[:live], np.zeros(live, dtype=np.int64), 0
        for (table, mask, bits), shift in zip(tables, (8, 16, 0, 24), strict=True):
            if not mask:
                value |= int(table[0] >> 4) << shift
                continue
            if room < bits:  # a word serves as many codes as surely fit its 25 bits
                word, room = words.take(here >> 3, mode="clip") >> (here & 7).astype(np.uint32), 25
            x = table.take(word & mask)
            used, s = x & np.uint32(15), x >> np.uint32(4)
            here += used
            word, room = word >> used, room - bits
            if shift == 8 and refers:
                alive[:live] &= s < 256
            value |= s.astype(np.int64) << shift
        pixels[place[:live] + step] = value
    alive &= at <= ends
    for k, (i, _, width, height, _) in enumerate(images):
        if alive[k]:
            out[i] = pixels[place[k] : place[k] + n[k]].reshape(height, width)


def text_lengths() -> np.ndarray:
    """Code lengths of byte values, by rule: space, frequent letters, letters, other text, the rest."""
    lengths = np.full(256, 12)
    lengths[0x20:0x7F] = 10
    lengths[0x80:0xC0] = 10
    lengths[0x61:0x7B] = 7
    lengths[[0x0A, 0x2C, 0x2E]] = 7
    lengths[list(b"eanthiors")] = 4
    lengths[0x20] = 3
    room = (1 << 12) - int((1 << (12 - lengths)).sum())
    for v in np.flatnonzero(lengths == 12)[::-1][:room]:  # fills the code space
        lengths[v] = 11
    return lengths


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def write_lengths(w: BitWriter, lengths: Sequence[int], symbols: int) -> None:
    """A prefix code's lengths, each as a symbol of 4 bits."""
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    digits = ["084c2a6e195d3b7f"[n] for n in lengths]  # 4 bits each, turned around
    w.put(int("".join(reversed(digits)), 16), 4 * symbols)


def write_one(w: BitWriter, symbol: int) -> None:
    w.put(0b101, 3)  # simple, one symbol of 8 bits
    w.put(symbol, 8)


@lru_cache(1)
def fixed_codes() -> tuple[np.ndarray, np.ndarray, int, int]:
    """Reversed codes and lengths of byte values, and the bits that declare them."""
    lengths = text_lengths()
    codes = reversed_codes(lengths)
    w = BitWriter()
    w.put(0, 3)  # no transform, no cache, one group
    for symbols in (280, 256, 256):
        write_lengths(w, lengths.tolist(), symbols)
    write_one(w, 255)
    write_one(w, 0)
    return codes, lengths, w.value, w.n


def riff(body: bytes) -> bytes:
    odd = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + odd) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(odd)


def pack(value: np.ndarray, n: np.ndarray, starts: np.ndarray, ends: np.ndarray, shifts: np.ndarray) -> list[bytes]:
    """Fields of up to 24 bits, put from the least bit on; of each stretch of fields the bytes, after ``shifts`` free bits."""
    run = np.cumsum(n)
    begin = run - n
    bits = run[ends - 1] - begin[starts] + shifts
    sizes = (bits + 7) // 8
    words = (sizes + 11) // 8  # 8-byte words, and room to spill
    base = np.cumsum(words) - words
    at = np.repeat(64 * base + shifts - begin[starts], ends - starts) + begin
    value, word, shift = value.astype(np.uint64), at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, dtype=np.uint64)
    edges = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[edges]] |= np.bitwise_or.reduceat(value << shift, edges)
    over = np.flatnonzero((at & 63) + n > 64)
    np.bitwise_or.at(out, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
    raw = out.view(np.uint8)
    return [raw[8 * b : 8 * b + size].tobytes() for b, size in zip(base.tolist(), sizes.tolist(), strict=True)]


def file_of(head: BitWriter, packed: bytes) -> bytes:
    """The file whose bits are those of ``head`` and then those of ``packed``, which left room for them."""
    body = bytearray(packed)
    front = head.value.to_bytes((head.n + 7) // 8, "little")
    last = body[len(front) - 1] if len(body) >= len(front) else 0
    body[: len(front)] = front
    if head.n & 7:
        body[len(front) - 1] |= last
    return riff(bytes(body))


def start(width: int, height: int) -> BitWriter:
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    return w


def encode_literals(images: Sequence[np.ndarray]) -> list[bytes]:
    """Files of (height, width, 3) RGB byte arrays, opaque, under the fixed codes."""
    codes, lengths, declared, n_declared = fixed_codes()
    flat = np.concatenate([x.reshape(-1, 3)[:, [1, 0, 2]].reshape(-1) for x in images])
    heads = [start(x.shape[1], x.shape[0]) for x in images]
    for w in heads:
        w.put(declared, n_declared)
    ends = np.cumsum([x.size for x in images])
    packed = pack(codes[flat], lengths[flat], ends - [x.size for x in images], ends, np.array([w.n for w in heads]))
    return [file_of(w, b) for w, b in zip(heads, packed, strict=True)]


#: Colours of a palette; pixels of the least stretch that is copied; the longest copy; bits of the colour cache.
FEW_COLOURS, STRETCH, LONGEST, CACHE_BITS = 16, 4, 4096, 6
#: One in so many places must begin a stretch that has come before, for references to be written.
REPEATED = 8
#: The transforms' numbers in the format, and the factor that takes a whole channel from another.
PREDICTOR, CROSS, GREEN, PALETTE, WHOLE = 0, 1, 2, 3, 32
BLOCK_BITS = 9


def earlier(key: np.ndarray) -> np.ndarray:
    """For each place the last place before it with the same key, or -1."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.full(len(key), -1, dtype=np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def stretch_before(pixels: np.ndarray) -> np.ndarray:
    """For each place where STRETCH pixels begin, where they last began before (by their hash), or -1."""
    if len(pixels) < STRETCH:
        return np.zeros(0, dtype=np.int64)
    key = np.zeros(len(pixels) - STRETCH + 1, dtype=np.uint64)
    for i in range(STRETCH):
        key = (key ^ pixels[i : i + len(key)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return earlier(key)


def copies(pixels: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of the references, taken greedily from the left."""
    out, at = [], 0
    for i in np.flatnonzero(before >= 0).tolist():
        if i < at:
            continue
        j = int(before[i])
        most = min(LONGEST, len(pixels) - i)
        differ = np.flatnonzero(pixels[i : i + most] != pixels[j : j + most])
        n = int(differ[0]) if len(differ) else most
        if n >= STRETCH:
            out.append((i, n, i - j))
            at = i + n
    return out


def code_lengths(counts: np.ndarray) -> list[int]:
    """Lengths of a prefix code, 15 at most, by Huffman's rule; of equal weights the earlier made go first."""
    counts = counts.astype(np.int64)
    while True:
        heap = [(int(c), i, (s,)) for i, (s, c) in enumerate((s, counts[s]) for s in np.flatnonzero(counts).tolist())]
        lengths = [0] * len(counts)
        if len(heap) == 1:
            lengths[heap[0][2][0]] = 1
        heapify(heap)
        made = len(heap)
        while len(heap) > 1:
            a, b = heappop(heap), heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heappush(heap, (a[0] + b[0], made, a[2] + b[2]))
            made += 1
        if max(lengths) <= 15:
            return lengths
        counts = np.where(counts > 0, np.maximum(1, counts >> 2), 0)


def prefix_parts(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of lengths or distances, how many extra bits each has, and these."""
    v = value.astype(np.int64) - 1
    k = np.maximum(np.int64(1), np.floor(np.log2(np.maximum(v, 2))).astype(np.int64))
    second = v >> (k - 1) & 1
    symbol = np.where(v < 2, v, 2 * k + second)
    extra = np.where(v < 4, 0, k - 1)
    return symbol, extra, np.where(v < 4, 0, v - ((2 + second) << (k - 1)))


def put_pixels(w: BitWriter, pixels: np.ndarray, width: int, main: bool, refer: bool = False) -> None:
    """An entropy-coded image, with references and the colour cache if ``refer``."""
    pixels = pixels.ravel()
    refs = copies(pixels, stretch_before(pixels)) if refer else []
    cache = CACHE_BITS if refs else 0
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(0, 1)  # one group
    place, length, distance = (np.array(c, dtype=np.int64) for c in zip(*refs, strict=True)) if refs else (np.zeros(0, dtype=np.int64),) * 3
    covered = np.zeros(len(pixels) + 1, dtype=np.int64)
    covered[place] += 1
    covered[place + length] -= 1
    single = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    slot = (pixels * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache) if cache else np.zeros(len(pixels), dtype=np.int64)
    held = earlier(slot)[single] if cache else np.full(len(single), -1)
    hit = (held >= 0) & (pixels[held] == pixels[single])
    near = {max(1, dx + dy * width): i + 1 for i, (dx, dy) in reversed(list(enumerate(DISTANCES)))}
    code = np.array([near.get(d, d + 120) for d in distance.tolist()], dtype=np.int64)
    # a row a token: its symbols in the five alphabets, -1 for none, and extra bits behind the first and the last
    p = pixels[single]
    channel = lambda shift: np.where(hit, -1, p >> shift & 255)
    none = np.full(len(single), -1)
    lit = np.stack([np.where(hit, 280 + slot[single], p >> 8 & 255), channel(16), channel(0), channel(24), none], axis=1)
    (ls, ln, lx), (ds, dn, dx) = prefix_parts(length), prefix_parts(code)
    void = np.full(len(place), -1)
    copied = np.stack([256 + ls, void, void, void, ds], axis=1)
    order = np.argsort(np.concatenate([single, place]), kind="stable")
    rows = np.concatenate([lit, copied])[order]
    zeros = np.zeros((len(single), 4), dtype=np.int64)
    extra = np.concatenate([zeros, np.stack([lx, ln, dx, dn], axis=1)])[order]
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    value, n = np.zeros((len(rows), 7), dtype=np.int64), np.zeros((len(rows), 7), dtype=np.int64)
    for k, size in enumerate(sizes):
        s = rows[:, k]
        counts = np.bincount(s[s >= 0], minlength=size)
        lengths = code_lengths(counts)
        used = np.flatnonzero(counts)
        if len(used) <= 1 and (not len(used) or used[0] < 256):
            write_one(w, int(used[0]) if len(used) else 0)
            continue
        write_lengths(w, lengths, size)
        if len(used) == 1:
            continue  # the only symbol takes no bits
        codes = reversed_codes(lengths)
        at = (0, 2, 3, 4, 5)[k]
        value[:, at], n[:, at] = np.where(s >= 0, codes[s], 0), np.where(s >= 0, np.array(lengths)[s], 0)
    value[:, 1], n[:, 1], value[:, 6], n[:, 6] = extra.T
    total = int(n.sum())
    if total:
        keep = n.ravel() > 0
        [packed] = pack(value.ravel()[keep], n.ravel()[keep], np.array([0]), np.array([int(keep.sum())]), np.array([0]))
        w.put(int.from_bytes(packed, "little"), total)


def equal_channels(p: np.ndarray) -> list[tuple[int, int]]:
    """(transform, element) where a channel equals another in half of the pixels: all three, or a pair of them."""
    half = lambda a, b: 2 * int((p[:, a] == p[:, b]).sum()) >= len(p)
    if 2 * int(((p[:, 0] == p[:, 1]) & (p[:, 2] == p[:, 1])).sum()) >= len(p):
        return [(GREEN, 0)]
    # elements: what of green goes to red, of green to blue, of red to blue
    found = WHOLE if half(0, 1) else WHOLE << 8 if half(2, 1) else WHOLE << 16 if half(2, 0) else 0
    return [(CROSS, found)] if found else []


def plan(image: np.ndarray) -> str:
    """How an image is written: palette, runs, repeats or literals."""
    argb = pixels_of(image)
    some = argb[: 8 * FEW_COLOURS]
    if len(np.unique(some)) <= FEW_COLOURS and len(np.unique(argb)) <= FEW_COLOURS:
        return "palette"
    same = argb.reshape(image.shape[:2])
    if 2 * int((same[:, 1:] == same[:, :-1]).sum()) >= len(argb):
        return "runs"
    return "repeats" if REPEATED * int((stretch_before(argb) >= 0).sum()) >= len(argb) else "literals"


def pixels_of(image: np.ndarray) -> np.ndarray:
    p = image.reshape(-1, 3).astype(np.int64)
    return 255 << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]


def encode(image: np.ndarray, how: str) -> bytes:
    """One (height, width, 3) RGB byte array, as ``plan`` says."""
    if how == "literals":
        return encode_literals([image])[0]
    height, width = image.shape[:2]
    w, argb = start(width, height), pixels_of(image)
    blocks = ((width - 1) >> BLOCK_BITS) + 1, ((height - 1) >> BLOCK_BITS) + 1

    def transform(kind: int, element: int | None = None) -> None:
        w.put(1 | kind << 1, 3)
        if element is not None:  # the same in all blocks
            w.put(BLOCK_BITS - 2, 3)
            put_pixels(w, np.full(blocks[0] * blocks[1], 255 << 24 | element), blocks[0], False)

    if how == "palette":
        colours, index = np.unique(argb, return_inverse=True)
        transform(PALETTE)
        w.put(len(colours) - 1, 8)
        steps = split(colours)
        steps[1:] = (steps[1:] - steps[:-1].copy()) & 255
        put_pixels(w, join(steps), len(colours), False)
        bits = packing(len(colours))
        per, each = 1 << bits, 8 >> bits
        index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % per))).reshape(height, -1, per)
        width = index.shape[1]
        argb = (255 << 24 | (index << (np.arange(per) * each)).sum(axis=2) << 8).ravel()
    elif how == "runs":
        p = split(argb)
        for kind, element in equal_channels(p[:, 1:]):
            transform(kind, None if kind == GREEN else element)
            red, green = p[:, 1].copy(), p[:, 2]
            if kind == GREEN:
                p = p - green[:, None] * np.array([0, 1, 0, 1])
            else:
                p[:, 1] -= colour_delta(np.array(element & 255), green)
                p[:, 3] -= colour_delta(np.array(element >> 8 & 255), green) + colour_delta(np.array(element >> 16 & 255), red)
            p &= 255
        transform(PREDICTOR, 1 << 8)  # the left neighbour, above it in the first column
        grid = p.reshape(height, width, 4)
        before = np.concatenate([np.concatenate([[[[255, 0, 0, 0]]], grid[:-1, :1]]), grid[:, :-1]], axis=1)
        argb = join((grid - before) & 255).ravel()
    w.put(0, 1)
    put_pixels(w, argb, width, True, refer=True)
    return riff(w.value.to_bytes((w.n + 7) // 8, "little"))


def encode_many(images: Sequence[np.ndarray]) -> list[bytes]:
    """Files of (height, width, 3) RGB byte arrays, opaque; those of literals are written together."""
    how = [plan(x) for x in images]
    plain = [x for x, h in zip(images, how, strict=True) if h == "literals"]
    written = iter(encode_literals(plain)) if plain else iter(())
    return [next(written) if h == "literals" else encode(x, h) for x, h in zip(images, how, strict=True)]


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def to_images(payload: bytes) -> list[np.ndarray]:
    """The payload's pixels in rows of WIDTH; a payload above the largest height is several images."""
    pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH, 3)
    return [pixels[i : i + MOST_SIDE] for i in range(0, len(pixels), MOST_SIDE)]


def files_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(media[at : at + size])
        at += size
    return out


def store(payloads: Sequence[bytes]) -> list[bytes]:
    """The media value of each payload."""
    images = [to_images(p) for p in payloads]
    files = iter(encode_many([x for each in images for x in each])) if payloads else iter(())
    return [b"".join(next(files) for _ in each) for each in images]


def load(media: Sequence[bytes]) -> list[np.ndarray]:
    """Each media value's pixels, (rows, WIDTH, 3) of RGB bytes."""
    files = [files_of(m) for m in media]
    decoded = iter(decode_many([f for each in files for f in each]))
    return [np.concatenate([split(next(decoded))[..., 1:].astype(np.uint8) for _ in each]) for each in files]


def feature(pixels: np.ndarray) -> str:
    """Width, height, the channels' means in thousandths, and the share of pixels equal to their left neighbour."""
    means = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (pixels.size // 3)
    same = (pixels[:, 1:] == pixels[:, :-1]).all(axis=-1).sum() * 1000 // max(1, pixels[:, 1:].size // 3)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{':'.join(map(str, means))}:{same}"


MEDIA = "doc_id bigint, n_bytes bigint, media binary"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _in_groups(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES each."""
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)])
    group, at = np.cumsum(sizes) // BATCH_BYTES, 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = pa.record_batch([batch.column(0), batch.column(1).cast(pa.binary())], names=["doc_id", "text"])
        for part in _in_groups(batch, 1):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(store([pad(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for batch in batches:
        for part in _in_groups(batch, 2):
            media = part.column(2).to_pylist()
            rows = []
            for m, pixels in zip(media, load(media), strict=True):
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([part.column(0), part.column(1), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=names)


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text stored as lossless WebP."""
    return docs.select("doc_id", "text").mapInArrow(_store, MEDIA)


def media_features(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores the documents as media, reads them back and computes their features."""
    stored = Tables(spark).cut(media_columns(docs), "media")
    return stored.mapInArrow(_features, FEATURES)
