"""Many lossless WebP images at a time: numpy takes one step of each image's stream together.

``encode_many`` writes blocks of 8-bit samples, four to a pixel, as images WIDTH pixels wide.  Each
image has a palette, if it is estimated to be shorter with it, or else a predictor transform and a
cross-colour transform, whose mode and factor are chosen by the entropy of what they leave of the
pixels of some rows.  Pixels are then written by prefix codes, with back-references and, where it
is hit, a colour cache; the codes' lengths have codes of their own.

``decode_many`` reads any lossless image.  In each step every image that isn't done reads its next
literal, back-reference or cached colour; predictors are undone pixel by pixel in the same way.
Streams with an entropy image are left to the decoder of single images, as are whole streams
in other respects out of the ordinary (and errors, which that decoder names).
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import cached_property

import numpy as np

from .common import words_at
from .webp import CACHE_HASH, CROSS_COLOUR, DISTANCES, LENGTH_ORDER, LENGTHS, LITERALS, PALETTE, PLANE, PREDICTOR, SUBTRACT_GREEN, Broken, Writer, _bundle_bits, _file, _from_palette, _header, _huffman, _prefix, _with_colour, _write_pixels, decode

WIDTH = 16
#: Samples of one image at most: more images in step with each other, and prefix codes of less than 15 bits.
BLOCK = 4096
#: Tiles of the transforms are 2**TILE pixels wide and high; predictor modes and cross-colour factors (of green) that are tried.
TILE, MODES, FACTORS = 4, (0, 1, 2, 11, 12), (0, 16, 32)
#: Of images with more rows than this, one row in so many is looked at to choose the mode and the factor.
ALL_ROWS, EVERY = 15, 4
#: The colour cache holds 2**CACHE colours; shortest back-reference, in pixels.
CACHE, SHORTEST = 6, 3

_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.uint16)
_NEAR: dict[int, np.ndarray] = {}


# Predictions ------------------------------------------------------------------------------------


def predictions(mode: int, left, top, top_left, top_right):
    """Values that a mode predicts, for arrays of neighbours with the channels last."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], left.dtype), left.shape)
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode <= 9:
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1), np.abs(left - top_left).sum(-1)
        return np.where((to_left < to_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    half = mean(left, top)
    off = half - top_left
    return np.clip(half + (off + (off < 0) >> 1), 0, 255)


def undo_predictors(residuals: list[np.ndarray], modes: list[np.ndarray], bits: list[int]) -> list[np.ndarray]:
    """Pixels of images from what their predictors left; all images take the same step."""
    size = np.array([x.shape[0] * x.shape[1] for x in residuals])
    width = np.array([x.shape[1] for x in residuals])
    order = np.argsort(-size, kind="stable")
    n, most = len(order), int(size.max())
    pad = int(width.max()) + 1
    out = np.zeros((most + pad, n, 4), np.int16)
    mode_of = np.zeros((most, n), np.int8)
    for k, i in enumerate(order.tolist()):
        r, w, b = residuals[i], int(width[i]), bits[i]
        out[pad : pad + size[i], k] = r.reshape(-1, 4)
        m = modes[i].repeat(1 << b, 0).repeat(1 << b, 1)[: r.shape[0], :w].astype(np.int8)
        m[0], m[:, 0] = 1, 2
        m[0, 0] = 0
        mode_of[: size[i], k] = m.ravel()
    live, width = np.searchsorted(-size[order], -np.arange(most), "left"), width[order]
    columns = np.arange(n)
    for p in range(most):
        k = int(live[p])
        now = mode_of[p, :k]
        at, w, c = pad + p, width[:k], columns[:k]
        left, top = out[at - 1, :k], out[at - w, c]
        kinds = np.flatnonzero(np.bincount(now))
        if kinds[-1] <= 2:
            guess = np.where((now == 1)[:, None], left, np.where((now == 2)[:, None], top, np.array([0, 0, 0, 255], np.int16)))
        else:
            top_left, top_right = out[at - w - 1, c], out[at - w + 1, c]
            guess = np.zeros((k, 4), np.int16)
            for m in kinds.tolist():
                s = np.flatnonzero(now == m)
                guess[s] = predictions(m, left[s], top[s], top_left[s], top_right[s])
        out[at, :k] = (out[at, :k] + guess) & 255
    found: list = [None] * n
    for k, i in enumerate(order.tolist()):
        found[i] = out[pad : pad + size[i], k].astype(np.uint8).reshape(residuals[i].shape)
    return found


# Writing ----------------------------------------------------------------------------------------


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of the rows of a table of counts, by two queues; all rows take the same step.

    Rows that add up to a few thousand can't have codes that are too long.
    """
    n, size = counts.shape
    big = np.int64(1) << 40
    # Counts are below 1 << 16, as rows are small, and numbers of 16 bits are sorted by digits.
    order = np.argsort(np.where(counts > 0, counts, 0xFFFF).astype(np.uint16), axis=1, kind="stable")
    leaves = np.append(np.take_along_axis(np.where(counts > 0, counts, big), order, 1), np.full((n, 1), big), 1)
    live = (counts > 0).sum(1)
    inner = np.full((n, size + 1), big)
    next_leaf, next_inner = np.zeros(n, np.int64), np.zeros(n, np.int64)
    parent_leaf, parent_inner = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
    steps = int(live.max()) - 1
    by_live = np.argsort(-live, kind="stable")
    rows_of = np.searchsorted(-live[by_live], -np.arange(1, steps + 2), "left")
    for step in range(steps):
        r = by_live[: rows_of[step]]  # those with more leaves than step + 1
        total = np.zeros(len(r), np.int64)
        for _ in range(2):
            a, b = leaves[r, next_leaf[r]], inner[r, next_inner[r]]
            leaf = a <= b
            x, y = r[leaf], r[~leaf]
            parent_leaf[x, next_leaf[x]] = step
            parent_inner[y, next_inner[y]] = step
            next_leaf[x] += 1
            next_inner[y] += 1
            total += np.where(leaf, a, b)
        inner[r, step] = total
    depth = np.zeros((n, size + 1), np.int64)
    for step in range(steps - 2, -1, -1):
        r = by_live[: rows_of[step + 1]]  # those for which this isn't the root
        depth[r, step] = depth[r, parent_inner[r, step]] + 1
    found = np.where(np.arange(size) < live[:, None], np.take_along_axis(depth, parent_leaf[:, :size], 1) + 1, 0)
    out = np.zeros((n, size), np.int64)
    np.put_along_axis(out, order, found, 1)
    out[np.flatnonzero(live == 0), 0] = 1
    return out


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of the rows' lengths, first bit lowest; of a single symbol none."""
    code = _Codes(lengths)
    place = np.empty(lengths.shape, np.int64)
    np.put_along_axis(place, code.symbols.astype(np.int64), np.broadcast_to(np.arange(lengths.shape[1]), lengths.shape), 1)
    value = place - np.take_along_axis(code.shift, lengths, 1)
    return np.where((lengths > 0) & ~code.only[:, None], _REVERSED[np.where(lengths > 0, value << 15 - lengths, 0) & 0x7FFF], 0)


def _text(value: int, n: int) -> str:
    """Bits in the order in which they are written."""
    return f"{value:0{n}b}"[::-1] if n else ""


def _texts(lengths: list[int]) -> list[str]:
    """The codes of some lengths; of a single symbol none."""
    texts, code, last = [""] * len(lengths), 0, 0
    used = sorted((x, k) for k, x in enumerate(lengths) if x)
    for x, k in used if len(used) > 1 else ():
        code <<= x - last
        texts[k], last = f"{code:0{x}b}", x
        code += 1
    return texts


#: Symbols of the code for code lengths: a gap of zeros of each size as (zeros one by one, times 17, times 18), and extra bits.
_ZEROS = LITERALS + LENGTHS + (1 << CACHE) + 1
_GAPS = np.array([(r if r < 3 else 0, 3 <= r <= 10, g // 138 + (r > 10)) for g in range(_ZEROS) for r in [g % 138]], np.int64)
_FULL, _THREE = _text(138 - 11, 7), [_text(k, 3) for k in range(8)]
#: For each size what follows the full repeats: its symbol and extra bits, or how many zeros.
_REST = [(0, r) if r < 3 else (17, _text(r - 3, 3)) if r <= 10 else (18, _text(r - 11, 7)) for r in range(138)]


def _gap(g: int, own: list[str]) -> str:
    """Bits of a gap of zeros, where ``own`` has the codes of the symbols of code lengths."""
    symbol, rest = _REST[g % 138]
    text = own[symbol] + rest if symbol else rest * own[0]
    return (own[18] + _FULL) * (g // 138) + text if g >= 138 else text


def _bounded_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of at most ``most`` bits: where they would be longer, rare symbols count for more."""
    lengths, floor = _code_lengths(counts), np.ones(len(counts), np.int64)
    while len(late := np.flatnonzero(lengths.max(1) > most)):
        floor[late] *= 2
        lengths[late] = _code_lengths(np.where(counts[late] > 0, np.maximum(counts[late], floor[late, None]), 0))
    return lengths


def _descriptions(lengths: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Descriptions of the prefix codes whose lengths are the rows; those end at ``sizes``."""
    n = len(lengths)
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=n)
    ends = np.cumsum(used)
    before = np.append(-1, symbol[:-1])
    before[(ends - used)[used > 0]] = -1
    gap, last = symbol - before - 1, sizes - symbol[ends - 1] - 1
    counts = np.zeros((n, 19), np.int64)
    np.add.at(counts, (row, lengths[row, symbol]), 1)
    for k, s in enumerate((0, 17, 18)):
        counts[:, s] += np.bincount(row, _GAPS[gap, k], minlength=n).astype(np.int64) + _GAPS[last, k]
    own = _bounded_lengths(counts, 7)
    out, at = [], 0
    for k, (end, size, l) in enumerate(zip(ends.tolist(), own.tolist(), last.tolist())):
        syms = symbol[at:end].tolist()
        if len(syms) <= 2 and syms[-1] < 256:
            out.append("1" + _text(len(syms) - 1, 1) + "1" + "".join(_text(s, 8) for s in syms))
            at = end
            continue
        order = [size[x] for x in LENGTH_ORDER]
        while len(order) > 4 and not order[-1]:
            order.pop()
        codes = _texts(size)
        gaps = gap[at:end].tolist()
        known = {g: _gap(g, codes) for g in {*gaps, l}}
        body = "".join([known[g] + codes[x] for g, x in zip(gaps, lengths[k, syms].tolist())])
        out.append("0" + _text(len(order) - 4, 4) + "".join([_THREE[x] for x in order]) + "0" + body + known[l])
        at = end
    return out


_X_LOG_X = np.append(0, np.arange(1, BLOCK + 1) * np.log2(np.arange(1, BLOCK + 1)))


def _entropy(image: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of each image's symbols (0 to 255) by their frequencies in it."""
    count = np.bincount(image << 8 | symbol, minlength=len(size) << 8)
    return _X_LOG_X[size] - _X_LOG_X[count].reshape(-1, 256).sum(1)


def _transformed(pixels: np.ndarray, image: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What predictors and cross-colour leave of the pixels, and the mode and the factor of each image."""
    at, p = np.arange(len(pixels)), pixels.astype(np.int16)
    # The first row and column are predicted in one way whatever the mode is.
    edge = (row == 0) | (at % WIDTH == 0)
    inner = np.flatnonzero(~edge)
    left = np.empty_like(pixels)
    e = np.flatnonzero(edge)
    up, beside = row[e] > 0, at[e] % WIDTH > 0
    guess = np.where(up[:, None], p[np.maximum(e - WIDTH, 0)], np.where(beside[:, None], p[np.maximum(e - 1, 0)], np.array([0, 0, 0, 255], np.int16)))
    left[e] = (p[e] - guess).astype(np.uint8)
    near = lambda k: [p[k - d] for d in (1, WIDTH, WIDTH + 1, WIDTH - 1)]
    seen = inner[(row[inner] % EVERY == 1) | (size[image[inner]] <= ALL_ROWS * WIDTH)]
    own, around = image[seen], near(seen)
    many = np.bincount(own, minlength=len(size))
    best, mode = None, np.zeros(len(size), np.int64)
    for m in MODES:
        rest = (p[seen] - predictions(m, *around)).astype(np.uint8)
        cost = sum(_entropy(own, rest[:, c], many) for c in range(4))
        if best is not None:
            mode[cost < best] = m
        best = cost if best is None else np.minimum(cost, best)
    mode_of = mode[image[inner]]
    for m in np.unique(mode).tolist():
        k = inner[mode_of == m]
        left[k] = (p[k] - predictions(m, *near(k))).astype(np.uint8)
    factor, best = np.zeros(len(size), np.int64), None
    green = (left[:, 1].astype(np.int16) ^ 128) - 128
    for f in FACTORS:
        part = (f * green[seen] >> 5).astype(np.uint8)
        cost = sum(_entropy(own, left[seen, c] - part, many) for c in (0, 2))
        if best is not None:
            factor[cost < best] = f
        best = cost if best is None else np.minimum(cost, best)
    part = (factor[image].astype(np.int16) * green >> 5).astype(np.uint8)
    left[:, 0] -= part
    left[:, 2] -= part
    return left, mode, factor


_sub_images: dict = {}


def _sub_image(kind: int, value: int, tiles: int) -> str:
    """Bits of a transform with one value in all tiles, one beside the other."""
    if (kind, value, tiles) not in _sub_images:
        w, m = Writer(), np.zeros((tiles, 1, 4), np.uint8)
        m[..., 3] = 255
        m[:, 0, 1] = value  # a mode, or the factor of green for blue ...
        if kind == CROSS_COLOUR:
            m[:, 0, 2] = value  # ... and for red
        w.bits(1, 1), w.bits(kind, 2), w.bits(TILE - 2, 3)
        _write_pixels(w, m, False)
        _sub_images[kind, value, tiles] = _text(w.value, w.n)
    return _sub_images[kind, value, tiles]


def _literals(images: list[np.ndarray]) -> list[str]:
    """Entropy-coded images of literals only; their codes are described together."""
    sizes = np.array([LITERALS + LENGTHS, LITERALS, LITERALS, LITERALS, DISTANCES])
    lengths = np.zeros((5 * len(images), int(sizes.max())), np.int64)
    lengths[4::5, 0] = 1
    for i, pixels in enumerate(images):
        for k, c in enumerate((1, 0, 2, 3)):
            lengths[5 * i + k, :LITERALS] = _huffman(Counter(pixels[:, c].tolist()), LITERALS)
    described, out = _descriptions(lengths, np.tile(sizes, len(images))), []
    for i, pixels in enumerate(images):
        green, red, blue, alpha = (_texts(x[:LITERALS]) for x in lengths[5 * i : 5 * i + 4].tolist())
        text = ["0", *described[5 * i : 5 * i + 5]]  # no cache
        for r, g, b, a in pixels.tolist():
            text += (green[g], red[r], blue[b], alpha[a])
        out.append("".join(text))
    return out


def _near(width: int) -> np.ndarray:
    """Distance codes of the distances up to 8 rows and 8 pixels."""
    if width not in _NEAR:
        code = np.arange(9 * width + 9) + len(PLANE)
        for k, (x, y) in reversed(list(enumerate(PLANE))):
            code[max(1, x + y * width)] = k + 1
        _NEAR[width] = code
    return _NEAR[width]


def _ordered(image: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their images, 32-bit keys and places; and image and key as one number, in that order.

    All are sorted as numbers that hold the three, which is faster than a stable sort of places.
    """
    bits = BLOCK.bit_length() - 3  # of a place in its image
    word = image << 32 + bits | key << bits | np.arange(len(image)) - start[image]
    word.sort()
    return start[word >> 32 + bits] + (word & (1 << bits) - 1), word >> bits


def _references(argb: np.ndarray, image: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every pixel the length and distance of a back-reference that could stand there (0: none)."""
    n = len(argb)
    key = argb.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHORTEST):
            h = (h ^ np.append(key[k:], np.zeros(k, np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    room = (start + size)[image] - np.arange(n)
    order, code = _ordered(image, (h >> np.uint64(32)).astype(np.int64), start)
    before = np.full(n, -1)
    same = code[1:] == code[:-1]
    before[order[1:][same]] = order[:-1][same]
    ok = (before >= 0) & (room >= SHORTEST)
    for k in range(SHORTEST):  # hashes may be equal by chance
        at = np.flatnonzero(ok)
        ok[at] = (argb[at + k] == argb[before[at] + k]) & (image[at] == image[before[at]])
    distance = np.where(ok, np.arange(n) - before, 0)
    # Along places with one distance each match goes on to the last one's end.
    last = np.flatnonzero(np.append((distance[1:] != distance[:-1]) | (image[1:] != image[:-1]), True))
    length = np.where(ok, last[np.searchsorted(last, np.arange(n))] - np.arange(n) + SHORTEST, 0)
    return length, distance


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distances."""
    table = [_prefix(v) for v in range(1, int(value.max(initial=1)) + 1)]
    return tuple(np.array(x, np.int64)[value - 1] for x in zip(*table))


def encode_many(blocks: list[bytes]) -> list[bytes]:
    """WebP files of blocks of samples, each a positive multiple of 64 of them and BLOCK at most."""
    if not blocks:
        return []
    n_images = len(blocks)
    pixels = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 4)
    size = np.array([len(b) // 4 for b in blocks])
    start = np.cumsum(size) - size
    image = np.repeat(np.arange(n_images), size)
    row = (np.arange(len(pixels)) - start[image]) // WIDTH
    left, modes, factors = _transformed(pixels, image, row, size)
    # Palette: the bits of the numbers of the colours and about 26 of each colour, against those of the channels.
    ordered, code = _ordered(image, pixels.view("<u4").ravel().astype(np.int64), start)
    new = np.append(True, code[1:] != code[:-1])
    colour = ordered[new]  # a pixel of each colour of each image
    colours = np.bincount(image[colour], minlength=n_images)
    first_colour = np.cumsum(colours) - colours
    index = np.empty(len(code), np.int64)
    index[ordered] = np.cumsum(new) - 1
    index -= first_colour[image]
    plain = sum(_entropy(image, left[:, c], size) for c in range(4))
    small = colours <= 256
    by_number = _entropy(image, np.where(small[image], index, 0) & 255, size)
    palette = small & (by_number + 26 * colours < plain)
    # The image of each stream: its width, size and pixels.
    width = np.full(n_images, WIDTH)
    argb = left.astype(np.int64)
    argb = argb[:, 3] << 24 | argb[:, 0] << 16 | argb[:, 1] << 8 | argb[:, 2]
    if palette.any():
        bits = np.array([_bundle_bits(int(c)) for c in colours])
        each = np.where(palette, 1 << bits, 1)
        width = np.where(palette, WIDTH >> bits, WIDTH)
        x = np.arange(len(pixels))
        in_palette = palette[image]
        argb = np.where(in_palette, index << 8 + (x % each[image]) * (8 // each[image]), argb)
        firsts = np.flatnonzero(x % each[image] == 0)  # rows are whole multiples of what is bundled
        argb = np.add.reduceat(argb, firsts) + np.where(in_palette[firsts], 255 << 24, 0)
        image = image[firsts]
        size = size // each
        start = np.cumsum(size) - size
    n = len(argb)
    length, distance = _references(argb, image, start, size)
    step = np.maximum(length, 1)
    taken = np.zeros(n, bool)
    now, end = start.copy(), start + size
    while len(now):
        taken[now] = True
        now = now + step[now]
        live = now < end
        now, end = now[live], end[live]
    token = np.flatnonzero(taken)
    # The cache: the last pixel before with the same place has the same colour.
    place = (argb * CACHE_HASH & 0xFFFFFFFF) >> 32 - CACHE
    by_place, _ = _ordered(image, place, start)
    cached = np.zeros(n, bool)
    a, b = by_place[:-1], by_place[1:]
    cached[b] = (image[a] == image[b]) & (argb[a] == argb[b])
    refers = length[token] > 0
    cached = cached[token] & ~refers
    of = image[token]
    caches = np.bincount(of, cached, minlength=n_images) > 0
    literal = ~refers & ~cached
    value = argb[token]
    far = distance[token]
    near = np.stack([np.append(c := _near(w), np.zeros(9 * WIDTH + 9 - len(c), np.int64)) for w in range(1, WIDTH + 1)])
    far = np.where(far < 9 * width[of], near[width[of] - 1, np.minimum(far, 9 * WIDTH)], far + len(PLANE))
    length_symbol, length_extra, length_bits = _prefixes(np.where(refers, length[token], 1))
    far_symbol, far_extra, far_bits = _prefixes(np.where(refers, far, 1))
    green = np.where(literal, value >> 8 & 255, np.where(refers, LITERALS + length_symbol, LITERALS + LENGTHS + place[token]))
    alphabets = (LITERALS + LENGTHS + (1 << CACHE), LITERALS, LITERALS, LITERALS, DISTANCES)
    symbols = (green, value >> 16 & 255, value & 255, value >> 24 & 255, far_symbol)
    used = (np.ones(len(token), bool), literal, literal, literal, refers)
    counts = [np.bincount(of[u] * a + s[u], minlength=n_images * a).reshape(n_images, a) for a, s, u in zip(alphabets, symbols, used)]
    bits_of = [_code_lengths(c) for c in counts]
    code = [_canonical(x) for x in bits_of]
    ends_at = [np.where(caches, alphabets[0], LITERALS + LENGTHS), *[np.full(n_images, a) for a in alphabets[1:]]]
    described = [_descriptions(x, e) for x, e in zip(bits_of, ends_at)]
    tables = [pixels[colour[first_colour[i] : first_colour[i] + colours[i]]] for i in np.flatnonzero(palette).tolist()]
    tables = iter(_literals([np.diff(x, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8) for x in tables]) if tables else ())
    heads = []
    for i in range(n_images):
        w = Writer()
        _header(w, WIDTH, len(blocks[i]) // 64)
        text = [_text(w.value, w.n)]
        if palette[i]:
            text += ["1", _text(PALETTE, 2), _text(int(colours[i]) - 1, 8), next(tables)]
        else:
            tiles = -(-len(blocks[i]) // (4 * WIDTH) >> TILE)
            text += [_sub_image(PREDICTOR, int(modes[i]), tiles), _sub_image(CROSS_COLOUR, int(factors[i]), tiles)]
        # No more transforms; the cache; one group of codes.
        text += ["0", "1" + _text(CACHE, 4) if caches[i] else "0", "0"]
        text += [x[i] for x in described]
        heads.append("".join(text))
    for x in bits_of:  # a single symbol has no bits
        x[(x > 0).sum(1) < 2] = 0
    # Every token's bits as one number: literals have four codes, references two with extra bits.
    value, n_bits = code[0][of, green].astype(np.int64), bits_of[0][of, green]
    lit, ref = np.flatnonzero(literal), np.flatnonzero(refers)
    coded = lambda k, u: (x := of[u] * alphabets[k] + symbols[k][u], code[k].take(x).astype(np.int64), bits_of[k].take(x))[1:]
    for u, parts in (
        (lit, (coded(1, lit), coded(2, lit), coded(3, lit))),
        (ref, ((length_extra[ref], length_bits[ref]), coded(4, ref), (far_extra[ref], far_bits[ref]))),
    ):
        v, n = value[u], n_bits[u]
        for c, b in parts:
            v |= c << n
            n += b
        value[u], n_bits[u] = v, n
    head_bits = np.array([len(h) for h in heads])
    ends = np.cumsum(n_bits)
    first = np.searchsorted(of, np.arange(n_images))
    base = (ends - n_bits)[first]
    total = head_bits + np.bincount(of, n_bits, minlength=n_images).astype(np.int64)
    words = -(-total // 64) + 1
    origin = 64 * (np.cumsum(words) - words)
    at = (ends - n_bits) - base[of] + (head_bits + origin)[of]
    stream = np.zeros(int(words.sum()), np.uint64)
    value, word, shift = value.astype(np.uint64), at >> 6, (at & 63).astype(np.uint64)
    group = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    stream[word[group]] |= np.bitwise_or.reduceat(value << shift, group)
    high = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    stream[word[group] + 1] |= np.bitwise_or.reduceat(high, group)
    out = []
    for h, o, bits in zip(heads, (origin >> 6).tolist(), total.tolist()):
        head = np.frombuffer(int(h[::-1], 2).to_bytes(-(-len(h) // 64) * 8, "little"), "<u8")
        stream[o : o + len(head)] |= head
        out.append(_file(stream[o : o + (bits + 63) // 64].astype("<u8").tobytes()[: (bits + 7) // 8]))
    return out


# Reading ----------------------------------------------------------------------------------------


class _Bits:
    """Bit streams end to end, each with its place."""

    def __init__(self, streams: list[bytes]):
        size = np.array([len(s) for s in streams])
        self.words = words_at(np.frombuffer(b"".join(streams) + bytes(16), np.uint8))
        self.at = 8 * (np.cumsum(size) - size)
        self.end = self.at + 8 * size

    def peek(self, i: np.ndarray) -> np.ndarray:
        """57 bits of each stream at least."""
        at = self.at[i]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (at & 7).astype(np.uint64)

    def take(self, i: np.ndarray, n) -> np.ndarray:
        got = self.peek(i) & ((np.uint64(1) << np.asarray(n, np.uint64)) - np.uint64(1))
        self.at[i] += n
        return got.astype(np.int64)


#: Bits by which codes are looked up at once, and the length that stands for a code without bits.
SHORT, NO_BITS = 8, 15
_TIMES = np.array([1 << SHORT - x if 0 < x <= SHORT else 0 for x in range(16)], np.int32)


class _Codes:
    """Canonical prefix codes of many streams: limits by length, and symbols in order of length."""

    def __init__(self, lengths: np.ndarray):
        lengths = lengths.astype(np.uint8)
        n = len(lengths)
        count = np.stack([(lengths == x).sum(1) for x in range(16)], 1).astype(np.int32)
        count[:, 0] = 0
        used = count.sum(1)
        self.only = used < 2
        if ((count << 15 - np.arange(16)).sum(1)[~self.only] != 1 << 15).any():
            raise Broken("a prefix code isn't complete")
        self.symbols = np.argsort(np.where(lengths == 0, 16, lengths), axis=1, kind="stable").astype(np.int16)
        self.symbols[used == 0, 0] = 0
        first, last = np.zeros((n, 16), np.int32), np.zeros(n, np.int32)
        for x in range(1, 16):
            last = (last + count[:, x - 1]) << 1
            first[:, x] = last
        longest = int(np.flatnonzero(count.sum(0)).max(initial=1))
        limit = ((first + count) << 15 - np.arange(16))[:, 1 : longest + 1].astype(np.uint16)
        limit[self.only] = 0
        self.limit = np.ascontiguousarray(limit.T)
        self.shift = np.cumsum(count, 1) - count - first  # from a code to its symbol's place
        self.lengths = lengths

    @cached_property
    def short(self) -> np.ndarray:
        """For each code and its first SHORT bits the length and the symbol: 0 where it is longer, NO_BITS for a single symbol."""
        symbols = self.symbols[:, : int((self.lengths > 0).sum(1).max(initial=1))].astype(np.uint16)
        size = np.take_along_axis(self.lengths, symbols.astype(np.int64), 1)
        times = _TIMES[size]
        times[self.only] = 0
        rest = (1 << SHORT) - times.sum(1, dtype=np.int64)
        alone = np.where(self.only, symbols[:, 0] | np.uint16(NO_BITS << 12), np.uint16(0))
        entry = np.append(size.astype(np.uint16) << 12 | symbols, alone[:, None], 1)
        return np.repeat(entry.ravel(), np.append(times, rest[:, None], 1).ravel())

    def read(self, bits: _Bits, stream: np.ndarray, code: np.ndarray) -> np.ndarray:
        v = _REVERSED[(bits.peek(stream) & np.uint64(0x7FFF)).astype(np.int32)]
        found = self.short[(code << SHORT) + (v >> 15 - SHORT)].astype(np.int64)
        size, symbol = found >> 12, found & 0xFFF
        size[size == NO_BITS] = 0
        long = np.flatnonzero(found == 0)
        if len(long):
            v, code = v[long], code[long]
            more = (v >= self.limit.take(code, 1)).view(np.int8).sum(0, dtype=np.int8).astype(np.int64) + 1
            size[long] = more
            symbol[long] = self.symbols[code, self.shift[code, np.minimum(more, 15)] + (v.astype(np.int64) >> np.maximum(15 - more, 0))]
        bits.at[stream] += size
        return symbol


def _read_codes(bits: _Bits, i: np.ndarray, sizes: np.ndarray) -> _Codes:
    """The next prefix code of each stream, of alphabets of some sizes."""
    n = len(i)
    lengths = np.zeros((n, int(sizes.max())), np.uint8)
    simple = bits.take(i, 1) == 1
    s = np.flatnonzero(simple)
    if len(s):
        two = bits.take(i[s], 1)
        wide = bits.take(i[s], 1)
        lengths[s, bits.take(i[s], np.where(wide, 8, 1))] = 1
        t = s[two == 1]
        lengths[t, bits.take(i[t], 8)] = 1
    c = np.flatnonzero(~simple)
    if len(c):
        own, given = np.zeros((len(c), 19), np.uint8), 4 + bits.take(i[c], 4)
        for k, symbol in enumerate(LENGTH_ORDER):
            more = np.flatnonzero(given > k)
            own[more, symbol] = bits.take(i[c[more]], 3)
        code = _Codes(own)
        bounded = bits.take(i[c], 1) == 1
        most = sizes[c].copy()
        b = np.flatnonzero(bounded)
        if len(b):
            most[b] = 2 + bits.take(i[c[b]], 2 + 2 * bits.take(i[c[b]], 3))
        at, last, end = np.zeros(len(c), np.int64), np.full(len(c), 8), sizes[c]
        live = np.arange(len(c))
        while len(live):
            x = code.read(bits, i[c[live]], live)
            most[live] -= 1
            plain = x < 16
            p = live[plain]
            lengths[c[p], at[p]] = x[plain]
            at[p] += 1
            last[p] = np.where(x[plain] > 0, x[plain], last[p])
            r, kind = live[~plain], x[~plain]
            if len(r):
                times = bits.take(i[c[r]], np.where(kind == 16, 2, np.where(kind == 17, 3, 7))) + np.where(kind == 18, 11, 3)
                if (at[r] + times > end[r]).any():
                    raise Broken("code lengths run over")
                same = np.flatnonzero(kind == 16)
                if len(same):
                    to = np.repeat(at[r[same]] - np.cumsum(times[same]) + times[same], times[same]) + np.arange(times[same].sum())
                    lengths[np.repeat(c[r[same]], times[same]), to] = np.repeat(last[r[same]], times[same])
                at[r] += times
            live = live[(at[live] < end[live]) & (most[live] > 0)]
    return _Codes(lengths)


def _values(bits: _Bits, i: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    extra = np.maximum((prefix - 2) >> 1, 0)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + bits.take(i, np.where(prefix < 4, 0, extra)) + 1)


_PLANE = np.array(PLANE)


def _read_pixels(bits: _Bits, i: np.ndarray, width: np.ndarray, height: np.ndarray, top: bool) -> tuple[list, np.ndarray]:
    """Pixels of the next entropy-coded image of each stream, and which streams have one without an entropy image."""
    cache_bits = np.zeros(len(i), np.int64)
    has = np.flatnonzero(bits.take(i, 1))
    cache_bits[has] = bits.take(i[has], 4)
    if (cache_bits > 11).any():
        raise Broken("the colour cache is too large")
    out: list = [None] * len(i)
    ok = bits.take(i, 1) == 0 if top else np.ones(len(i), bool)
    places = np.flatnonzero(ok)
    if not len(places):
        return out, ok
    i, width, height, cache_bits = i[places], width[places], height[places], cache_bits[places]
    cache_size = np.where(cache_bits > 0, 1 << cache_bits, 0)
    n, same = len(i), lambda x: np.full(len(i), x)
    codes = [_read_codes(bits, i, s) for s in (LITERALS + LENGTHS + cache_size, same(LITERALS), same(LITERALS), same(LITERALS), same(DISTANCES))]
    size = width * height
    base = np.cumsum(size) - size
    argb = np.zeros(int(size.sum()), np.int64)
    cache = np.zeros((n, int(cache_size.max())), np.int64)
    at = np.zeros(n, np.int64)

    def keep(k, p):
        if cache.shape[1]:
            k, p = (x[cache_bits[k] > 0] for x in (k, p))
            cache[k, (p * CACHE_HASH & 0xFFFFFFFF) >> 32 - cache_bits[k]] = p

    live = np.arange(n)
    while len(live):
        if (bits.at[i[live]] > bits.end[i[live]]).any():
            raise Broken("the stream ends early")
        s = codes[0].read(bits, i[live], live)
        literal, refers = s < LITERALS, (s >= LITERALS) & (s < LITERALS + LENGTHS)
        k = live[literal]
        if len(k):
            red, blue, alpha = (codes[c].read(bits, i[k], k) for c in (1, 2, 3))
            p = alpha << 24 | red << 16 | s[literal] << 8 | blue
            argb[base[k] + at[k]] = p
            keep(k, p)
        k = live[s >= LITERALS + LENGTHS]
        if len(k):
            p = cache[k, s[s >= LITERALS + LENGTHS] - LITERALS - LENGTHS]
            argb[base[k] + at[k]] = p
            keep(k, p)
        at[live] += ~refers
        k = live[refers]
        if len(k):
            length = _values(bits, i[k], s[refers] - LITERALS)
            d = _values(bits, i[k], codes[4].read(bits, i[k], k))
            plane = _PLANE[np.minimum(d, len(PLANE)) - 1]
            d = np.where(d > len(PLANE), d - len(PLANE), np.maximum(1, plane[:, 0] + plane[:, 1] * width[k]))
            if ((d > at[k]) | (at[k] + length > size[k])).any():
                raise Broken("a back-reference leaves the image")
            owner = np.repeat(np.arange(len(k)), length)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            to = (base[k] + at[k])[owner]
            p = argb[to - d[owner] + step % d[owner]]
            argb[to + step] = p
            keep(k[owner], p)
            at[k] += length
        live = live[at[live] < size[live]]
    if (bits.at[i] > bits.end[i]).any():
        raise Broken("the stream ends early")
    channels = np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], -1).astype(np.uint8)
    for k, (place, b, s) in enumerate(zip(places.tolist(), base.tolist(), size.tolist())):
        out[place] = channels[b : b + s].reshape(int(height[k]), int(width[k]), 4)
    return out, ok


def _images(streams: list[bytes]) -> list[np.ndarray | None]:
    """Images of lossless streams; None for those with an entropy image."""
    bits, n = _Bits(streams), len(streams)
    i = np.arange(n)
    if (bits.take(i, 8) != 0x2F).any():
        raise Broken("no lossless signature")
    width, height = bits.take(i, 14) + 1, bits.take(i, 14) + 1
    bits.take(i, 1)
    if bits.take(i, 3).any():
        raise Broken("unknown version")
    transforms: list[list] = [[] for _ in range(n)]
    now, live = width.copy(), i
    while len(live):
        live = live[bits.take(live, 1) == 1]
        kinds = bits.take(live, 2)
        for kind in np.unique(kinds).tolist():
            own = live[kinds == kind]
            if any(kind == t[0] for k in own.tolist() for t in transforms[k]):
                raise Broken("a transform occurs twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                b = bits.take(own, 3) + 2
                subs, _ = _read_pixels(bits, own, -(-now[own] >> b), -(-height[own] >> b), False)
                for k, x, y in zip(own.tolist(), b.tolist(), subs):
                    transforms[k].append((kind, int(now[k]), x, y))
            elif kind == PALETTE:
                subs, _ = _read_pixels(bits, own, bits.take(own, 8) + 1, np.ones(len(own), np.int64), False)
                for k, y in zip(own.tolist(), subs):
                    table = np.cumsum(y[0], 0, dtype=np.uint8)
                    transforms[k].append((kind, int(now[k]), table))
                    now[k] = -(-int(now[k]) >> _bundle_bits(len(table)))
            else:
                for k in own.tolist():
                    transforms[k].append((kind, int(now[k])))
    images, ok = _read_pixels(bits, i, now, height, True)
    while True:  # the last transforms of all images are undone together
        left = [k for k in range(n) if ok[k] and transforms[k]]
        if not left:
            return images
        guessed = []
        for k in left:
            kind, was, *rest = transforms[k].pop()
            if kind == PREDICTOR:
                guessed.append((k, rest[1][..., 1], rest[0]))
            elif kind == CROSS_COLOUR:
                images[k] = _with_colour(images[k], rest[1], rest[0], False) if rest[1][..., :3].any() else images[k]
            elif kind == PALETTE:
                images[k] = _from_palette(images[k], rest[0], was)
            else:
                images[k][..., 0] += images[k][..., 1]
                images[k][..., 2] += images[k][..., 1]
        if guessed:
            for (k, _, _), x in zip(guessed, undo_predictors([images[k] for k, _, _ in guessed], [m for _, m, _ in guessed], [b for _, _, b in guessed])):
                images[k] = x


def _stream_of(file: bytes) -> bytes | None:
    """The stream of a file that has nothing else."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or len(file) < 20:
        return None
    size = struct.unpack_from("<I", file, 16)[0]
    return file[20 : 20 + size] if 20 + size + (size & 1) == len(file) == 8 + struct.unpack_from("<I", file, 4)[0] else None


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The image of each of some WebP files, as rows of (red, green, blue, alpha)."""
    streams = [_stream_of(f) for f in files]
    plain = [k for k, s in enumerate(streams) if s is not None]
    out: list = [None] * len(files)
    if plain:
        for k, x in zip(plain, _images([streams[k] for k in plain])):
            out[k] = x
    return [decode(f)[0] if x is None else x for f, x in zip(files, out)]


def split_files(media: bytes) -> list[bytes]:
    """WebP files that lie end to end."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF":
            raise Broken("not a WebP file")
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        size += size & 1
        if at + size > len(media):
            raise Broken("the file ends early")
        out.append(media[at : at + size])
        at += size
    return out
