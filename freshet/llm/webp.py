"""Lossless WebP (VP8L) images as bit streams: a decoder of single images, and an encoder of all that it reads.

The decoder reads prefix codes (simple and by code lengths, with repeats), groups of them chosen
by an entropy image, back-references with the plane distance codes, the colour cache, and undoes
the predictor, cross-colour, subtract-green and palette transforms, all as the public format
specification has them.  ``encode_pixels`` writes any of the format's features, for small images.
``webp_batch`` does the same for many images at a time.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

# Fixed values of the format: order of code length codes, and the plane offsets (x, y) of distance codes 1 to 120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PLANE = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_HASH = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


class Broken(ValueError):
    """The stream isn't a lossless WebP image."""


class Reader:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def bits(self, n: int) -> int:
        a = self.at
        if a + n > self.end:
            raise Broken("the stream ends early")
        self.at = a + n
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


class Code:
    """A canonical prefix code."""

    def __init__(self, lengths):
        self.lengths = lengths
        counts = Counter(lengths)
        del counts[0]
        used = sum(counts.values())
        self.only = next((s for s, x in enumerate(lengths) if x), 0) if used < 2 else None
        if used > 1 and sum(n << 15 - x for x, n in counts.items()) != 1 << 15:
            raise Broken("a prefix code isn't complete")
        self._table: dict[tuple[int, int], int] | None = None

    @property
    def table(self) -> dict[tuple[int, int], int]:
        """(length, code) to symbol, made when it is first needed."""
        if self._table is None:
            self._table, code, last = {}, 0, 0
            for s in sorted((s for s, x in enumerate(self.lengths) if x), key=lambda s: (self.lengths[s], s)):
                code <<= self.lengths[s] - last
                last = self.lengths[s]
                self._table[last, code] = s
                code += 1
        return self._table

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for size in range(1, 16):
            code = code << 1 | r.bits(1)
            s = self.table.get((size, code))
            if s is not None:
                return s
        raise Broken("no such prefix code")


def _read_code(r: Reader, size: int) -> Code:
    lengths = [0] * size
    if r.bits(1):
        n = r.bits(1) + 1
        lengths[r.bits(8 if r.bits(1) else 1)] = 1
        if n == 2:
            lengths[r.bits(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + r.bits(4)]:
        own[k] = r.bits(3)
    code = Code(own)
    most = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    s, last = 0, 8
    while s < size and most:
        most -= 1
        x = code.read(r)
        if x < 16:
            lengths[s] = x
            s += 1
            last = x or last
        else:
            times, value = (3 + r.bits(2), last) if x == 16 else (3 + r.bits(3), 0) if x == 17 else (11 + r.bits(7), 0)
            if s + times > size:
                raise Broken("code lengths run over")
            lengths[s : s + times] = [value] * times
            s += times
    return Code(lengths)


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def _pixels(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as rows of (red, green, blue, alpha)."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise Broken("the colour cache is too large")
    group_of, prefix_bits, groups = None, 0, 1
    if top and r.bits(1):
        prefix_bits = r.bits(3) + 2
        m = _pixels(r, -(-width >> prefix_bits), -(-height >> prefix_bits), False)
        group_of = (m[..., 0].astype(int) << 8 | m[..., 1]).tolist()
        groups = max(map(max, group_of)) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [[_read_code(r, s) for s in sizes] for _ in range(groups)]
    n = width * height
    argb: list[int] = []
    cache = [0] * cache_size

    def keep(p: int) -> None:
        if cache_size:
            cache[(CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(argb) < n:
        y, x = divmod(len(argb), width)
        green, red, blue, alpha, far = codes[group_of[y >> prefix_bits][x >> prefix_bits] if group_of else 0]
        s = green.read(r)
        if s < LITERALS:
            p = s << 8 | red.read(r) << 16
            p |= blue.read(r)
            p |= alpha.read(r) << 24
            argb.append(p)
            keep(p)
        elif s < LITERALS + LENGTHS:
            length = _value(r, s - LITERALS)
            d = _value(r, far.read(r))
            if d > len(PLANE):
                d -= len(PLANE)
            else:
                dx, dy = PLANE[d - 1]
                d = max(1, dx + dy * width)
            if d > len(argb) or len(argb) + length > n:
                raise Broken("a back-reference leaves the image")
            for _ in range(length):
                argb.append(argb[-d])
                keep(argb[-1])
        else:
            p = cache[s - LITERALS - LENGTHS]
            argb.append(p)
            keep(p)
    a = np.array(argb, np.uint32)
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255, a >> 24], -1).astype(np.uint8).reshape(height, width, 4)


def _mean(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, top_left, top_right) -> list[int]:
    """The predictor's value of a pixel from its neighbours, channel by channel."""
    z = list(zip(left, top, top_left, top_right))
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return list((left, top, top_right, top_left)[mode - 1])
    if mode == 5:
        return [_mean(_mean(a, d), b) for a, b, _, d in z]
    if mode in (6, 7, 8, 9):
        return [_mean(*((a, c) if mode == 6 else (a, b) if mode == 7 else (c, b) if mode == 8 else (b, d))) for a, b, c, d in z]
    if mode == 10:
        return [_mean(_mean(a, c), _mean(b, d)) for a, b, c, d in z]
    if mode == 11:
        to_left, to_top = sum(abs(b - c) for _, b, c, _ in z), sum(abs(a - c) for a, _, c, _ in z)
        return list(left if to_left < to_top else top)
    if mode == 12:
        return [clip(a + b - c) for a, b, c, _ in z]
    half = lambda v: v // 2 if v >= 0 else -(-v // 2)
    return [clip(_mean(a, b) + half(_mean(a, b) - c)) for a, b, c, _ in z]


def _with_predictor(image: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Add the predictions of the pixels decoded so far, or subtract those of the image itself."""
    height, width, _ = image.shape
    source = image.astype(int).tolist()
    out = [[None] * width for _ in range(height)]
    seen = source if forward else out
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = [0, 0, 0, 255] if x == 0 else seen[0][x - 1]
            elif x == 0:
                p = seen[y - 1][0]
            else:
                right = seen[y - 1][x + 1] if x + 1 < width else seen[y][0]
                p = predicted(int(modes[y >> bits][x >> bits]), seen[y][x - 1], seen[y - 1][x], seen[y - 1][x - 1], right)
            out[y][x] = [(v - q if forward else v + q) & 255 for v, q in zip(source[y][x], p)]
    return np.array(out, np.uint8).reshape(height, width, 4)


def _with_colour(image: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Elements: red-to-blue, green-to-blue, green-to-red in red, green, blue of the transform's image."""
    height, width, _ = image.shape
    e = elements.repeat(1 << bits, 0).repeat(1 << bits, 1)[:height, :width].view(np.int8).astype(int)
    out = image.astype(int)
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda t, c: t * signed(c) >> 5
    red, green, blue = out[..., 0].copy(), out[..., 1], out[..., 2].copy()
    if forward:
        blue = blue - delta(e[..., 1], green) - delta(e[..., 0], red)
        red = red - delta(e[..., 2], green)
    else:
        red = red + delta(e[..., 2], green) & 255
        blue = blue + delta(e[..., 1], green) + delta(e[..., 0], red)
    return np.stack([red & 255, green, blue & 255, out[..., 3]], -1).astype(np.uint8)


def _bundle_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _from_palette(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(table))
    each = 8 >> bits
    x = np.arange(width)
    index = image[..., 1][:, x >> bits] >> (x & ((1 << bits) - 1)) * each & ((1 << each) - 1)
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def _stream(data: bytes) -> np.ndarray:
    r = Reader(data)
    if r.bits(8) != 0x2F:
        raise Broken("no lossless signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise Broken("unknown version")
    transforms, now = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in [t[0] for t in transforms]:
            raise Broken("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            transforms.append((kind, now, bits, _pixels(r, -(-now >> bits), -(-height >> bits), False)))
        elif kind == PALETTE:
            table = np.cumsum(_pixels(r, r.bits(8) + 1, 1, False)[0], 0, dtype=np.uint8)
            transforms.append((kind, now, table))
            now = -(-now >> _bundle_bits(len(table)))
        else:
            transforms.append((kind, now))
    image = _pixels(r, now, height, True)
    for kind, was, *rest in reversed(transforms):
        if kind == PREDICTOR:
            image = _with_predictor(image, rest[1][..., 1], rest[0], False)
        elif kind == CROSS_COLOUR:
            image = _with_colour(image, rest[1], rest[0], False)
        elif kind == PALETTE:
            image = _from_palette(image, rest[0], was)
        else:
            image = image.copy()
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
    return image


def decode(media: bytes) -> list[np.ndarray]:
    """The images of one or more WebP files end to end, as arrays of rows of (red, green, blue, alpha)."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise Broken("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        if end > len(media):
            raise Broken("the file ends early")
        k, image = at + 12, None
        while k + 8 <= end:
            size = struct.unpack_from("<I", media, k + 4)[0]
            if k + 8 + size > end:
                raise Broken("a chunk leaves its file")
            if media[k : k + 4] == b"VP8L" and image is None:
                image = _stream(media[k + 8 : k + 8 + size])
            k += 8 + size + (size & 1)
        if image is None:
            raise Broken("no lossless image")
        out.append(image)
        at = end + (end - at & 1)
    return out


class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _file(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _header(w: Writer, width: int, height: int) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.bits(value, n)


def _huffman(counts: Counter, alphabet: int, most: int = 15) -> list[int]:
    """Code lengths of at most ``most``; counts are flattened until they fit."""
    lengths = [0] * alphabet
    live = {s: c for s, c in counts.items() if c}
    if len(live) <= 1:
        for s in live or (0,):
            lengths[s] = 1
        return lengths
    while True:
        heap = [(c, s, (s,)) for s, c in live.items()]
        heapq.heapify(heap)
        lengths = [0] * alphabet
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= most:
            return lengths
        live = {s: (c + 1) // 2 for s, c in live.items()}


class _Encoder:
    def __init__(self, w: Writer, lengths: list[int]):
        self.w, code, last = w, 0, 0
        self.of: dict[int, tuple[int, int]] = {}
        used = [s for s, x in enumerate(lengths) if x]
        for s in sorted(used, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - last
            last = lengths[s]
            self.of[s] = (int(f"{code:0{last}b}"[::-1], 2), last) if len(used) > 1 else (0, 0)
            code += 1

    def put(self, s: int) -> None:
        self.w.bits(*self.of[s])


def _write_code(w: Writer, lengths: list[int]) -> _Encoder:
    used = [s for s, x in enumerate(lengths) if x]
    if len(used) <= 2 and max(used) < 256:
        w.bits(1, 1), w.bits(len(used) - 1, 1), w.bits(1, 1)
        for s in used:
            w.bits(s, 8)
        return _Encoder(w, [int(s in used) for s in range(len(lengths))])
    runs: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    s = 0
    while s < len(lengths):
        e = s
        while e < len(lengths) and lengths[e] == lengths[s]:
            e += 1
        n = e - s
        if lengths[s] == 0:
            while n >= 3:
                k = min(n, 138)
                runs.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
                n -= k
        else:
            runs.append((lengths[s], 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                runs.append((16, k - 3, 2))
                n -= k
        runs += [(lengths[s], 0, 0)] * n
        s = e
    own = _huffman(Counter(x for x, _, _ in runs), 19, 7)
    w.bits(0, 1), w.bits(15, 4)
    for k in LENGTH_ORDER:
        w.bits(own[k], 3)
    w.bits(0, 1)
    code = _Encoder(w, own)
    for x, extra, n in runs:
        code.put(x)
        w.bits(extra, n)
    return _Encoder(w, lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> high - 1 & 1
    return 2 * high + second, v & (1 << high - 1) - 1, high - 1


def _write_pixels(w: Writer, image: np.ndarray, top: bool, cache_bits: int = 0, group_of: np.ndarray | None = None, group_bits: int = 2, references: bool = False) -> None:
    height, width, _ = image.shape
    a = image.astype(np.uint32)
    argb = (a[..., 3] << 24 | a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]).ravel().tolist()
    cache = [None] * (1 << cache_bits)
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(PLANE)))}
    ops, seen, i = [], {}, 0
    while i < len(argb):
        length, d = 0, 0
        if references and i and tuple(argb[i : i + 3]) in seen:
            d = i - seen[tuple(argb[i : i + 3])]
            while i + length < len(argb) and length < 4096 and argb[i + length] == argb[i + length - d]:
                length += 1
        slot = lambda p: (CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)
        if length >= 3:
            ops.append((i, "copy", length, near.get(d, d + len(PLANE))))
        elif cache_bits and cache[slot(argb[i])] == argb[i]:
            ops.append((i, "cache", slot(argb[i]), 0))
        else:
            ops.append((i, "pixel", argb[i], 0))
        for _ in range(max(1, length if length >= 3 else 1)):
            if cache_bits:
                cache[slot(argb[i])] = argb[i]
            seen[tuple(argb[i : i + 3])] = i
            i += 1
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    groups = 1
    if top:
        w.bits(int(group_of is not None), 1)
        if group_of is not None:
            w.bits(group_bits - 2, 3)
            m = np.zeros((*group_of.shape, 4), np.uint8)
            m[..., 0], m[..., 1], m[..., 3] = group_of >> 8, group_of & 255, 255
            _write_pixels(w, m, False)
            groups = int(group_of.max()) + 1
    of = lambda i: int(group_of[i // width >> group_bits][i % width >> group_bits]) if group_of is not None else 0
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]

    def each(put):
        for i, kind, x, d in ops:
            g = of(i)
            if kind == "pixel":
                for c, s in enumerate((x >> 8 & 255, x >> 16 & 255, x & 255, x >> 24)):
                    put(g, c, s, 0, 0)
            elif kind == "cache":
                put(g, 0, LITERALS + LENGTHS + x, 0, 0)
            else:
                s, extra, n = _prefix(x)
                put(g, 0, LITERALS + s, extra, n)
                put(g, 4, *_prefix(d))

    def count(g, c, s, extra, n):
        counts[g][c][s] += 1

    each(count)
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [[_write_code(w, _huffman(c, s)) for c, s in zip(own, sizes)] for own in counts]

    def write(g, c, s, extra, n):
        codes[g][c].put(s)
        w.bits(extra, n)

    each(write)


def encode_pixels(image: np.ndarray, transforms: tuple = (), cache_bits: int = 0, group_of: np.ndarray | None = None, group_bits: int = 2, references: bool = True) -> bytes:
    """One WebP file of a small image of (red, green, blue, alpha).

    ``transforms``, applied in order: ("predictor", bits, modes), ("cross", bits, elements),
    ("green",) or ("palette",), the last only for 256 colours at most.
    """
    height, width, _ = image.shape
    w = Writer()
    _header(w, width, height)
    for kind, *rest in transforms:
        w.bits(1, 1)
        if kind == "predictor":
            w.bits(PREDICTOR, 2), w.bits(rest[0] - 2, 3)
            m = np.zeros((*rest[1].shape, 4), np.uint8)
            m[..., 1], m[..., 3] = rest[1], 255
            _write_pixels(w, m, False)
            image = _with_predictor(image, rest[1], rest[0], True)
        elif kind == "cross":
            w.bits(CROSS_COLOUR, 2), w.bits(rest[0] - 2, 3)
            m = np.full((*rest[1].shape[:2], 4), 255, np.uint8)
            m[..., :3] = rest[1]
            _write_pixels(w, m, False)
            image = _with_colour(image, m, rest[0], True)
        elif kind == "green":
            w.bits(SUBTRACT_GREEN, 2)
            image = image.copy()
            image[..., 0] -= image[..., 1]
            image[..., 2] -= image[..., 1]
        else:
            table, index = np.unique(image.reshape(-1, 4), axis=0, return_inverse=True)
            index = index.reshape(image.shape[:2])
            w.bits(PALETTE, 2), w.bits(len(table) - 1, 8)
            _write_pixels(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)[None], False)
            bits = _bundle_bits(len(table))
            packed = np.zeros((height, -(-image.shape[1] >> bits), 4), np.uint8)
            packed[..., 3] = 255
            for x in range(image.shape[1]):
                packed[:, x >> bits, 1] |= (index[:, x] << (x & (1 << bits) - 1) * (8 >> bits)).astype(np.uint8)
            image = packed
    w.bits(0, 1)
    _write_pixels(w, image, True, cache_bits, group_of, group_bits, references)
    return _file(w.bytes())
