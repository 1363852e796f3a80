"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers."""

from __future__ import annotations

import numpy as np

from .common import distinct, text_buffer

WORDS = 5
#: Bytes whose words are hashed at a time.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_SYMBOL = np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64)[_LOWER]
_STEP = 0x9FB21C651E98DF25
_BACK = pow(_STEP, -1, 1 << 64)
_PLACE = np.random.default_rng(20240602).integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have)
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (ASCII letters in lower case) and the row that it is in."""
    hashes, rows = [], []
    is_word = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    # A word ends before a space or the start of another row.
    start = is_word & np.append(True, ~is_word[:-1]) if len(data) else is_word
    if len(data):
        start |= is_word & begins[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = ~is_word | begins[:-1]
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, "right")]
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_SYMBOL[data[a:b]] * _power(_STEP, b - a), out=total[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            hashes.append(mix((total[e] - total[s]) * _power(_BACK, b - a)[s] + (e - s).astype(np.uint64)))
            i = j
    hashes = np.concatenate(hashes)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows


def shingle_sets(column) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted.

    Fewer than WORDS words make one shingle of the whole sequence; none (or a null) none.
    """
    data, offsets = text_buffer(column)
    words, rows = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            h = np.full(n, WORDS, np.uint64)
            for i in range(WORDS):
                h = h + words[i : i + n] * _PLACE[i]
            h = mix(h)
        else:
            h = np.zeros(0, np.uint64)
        out = []
        for f, c in zip(first.tolist(), count.tolist()):
            if c >= WORDS:
                out.append(distinct(h[f : f + c - WORDS + 1]))
            elif c:
                out.append(mix(np.array([c + int((words[f : f + c] * _PLACE[:c]).sum(dtype=np.uint64)) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
