"""Operator 9: BPE encoding and decoding over a minimal acyclic transducer of frequent words.

Text is cut at white space; nothing that the vocabulary's rules do reaches across it, so what
lies between can be encoded alone, and so can the words into which the rules cut that.  Words are
counted over all texts; the LEXICON_WORDS most frequent ones are encoded once and compiled into an
acyclic automaton whose equal suffixes are shared (incremental construction from sorted words).
Each edge carries the number of words that are passed over, so a path adds up to the word's
number, which points at its ids.  The automaton is a file in the shared folder that Spark hands to
each executor once; its workers map that one copy into memory.  Words that it lacks are merged
exactly by rank.

What a worker holds is bounded: texts come in slices of SLICE_BYTES, and of strings met before the
last ones are remembered, if they are short.  Within a slice everything is a step over an Arrow
column: texts are cut at white space, equal strings are coded once, and their ids are taken to
their places; Python touches only strings that are not remembered.

Defined cases: a null text is the empty text, which has no ids and decodes to ""; strings of
special tokens in a text become their ids, as the library does; a text longer than a slice is a
slice of its own; repeated rows, and rows with equal or null ids, get equal results for equal
texts; columns besides the id and the text are left out, whatever they are called; an empty table
gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, slices, text_buffer, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
#: Words that the automaton holds at most, and their longest form in bytes.
LEXICON_WORDS, LEXICON_BYTES = 65_536, 64
#: Texts without white space, and words, that a worker goes on with when it forgets; of twice as many, some 50 bytes each.
MEMORY_TEXTS, MEMORY_WORDS = 120_000, 70_000
#: Bytes and rows of texts that are encoded together, so that their new words are found together.
SLICE_BYTES, SLICE_ROWS = 3 << 20, 2500
#: Bytes and rows of texts whose words are counted before they are passed on.
COUNT_BYTES, COUNT_ROWS = 12 << 20, 10_000
#: Symbols of a word from which on merges are found by a heap.
LONG_WORD = 256
END = "</w>"

#: A space ends a text, the rest are its words.
_PIECES = regex.compile(r"\x20|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What the vocabulary's rules take for white space; str.split() also takes U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The same as bytes: single ones, and the longer ones by their first.
_WIDE = [x.encode() for x in map(chr, range(0x80, 0x3001)) if _SPACE.match(x)]
_IS_SPACE, _LEADS = np.zeros(256, bool), np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LEADS[[x[0] for x in _WIDE]] = True
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 byte values: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of() of a column of texts end to end, and each row's first (with their number at the end)."""
    data, rows = text_buffer(texts)
    space = _IS_SPACE[data]
    lead = np.flatnonzero(_LEADS[data])
    for x in _WIDE:
        at = lead[lead <= len(data) - len(x)]
        for k, b in enumerate(x):
            at = at[data[at + k] == b]
        for k in range(len(x)):
            space[at + k] = True
    there = ~space
    opens = np.append(True, space[:-1]) if len(data) else space
    opens[rows[:-1][rows[:-1] < len(data)]] = True
    start = np.flatnonzero(opens & there)
    ends = np.append(np.cumsum(there)[start] - 1, np.count_nonzero(there)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[there])])
    return words, np.searchsorted(start, rows)


def words_of(text: str) -> list[str]:
    """The pieces between white space."""
    if any(c in text for c in _CONTROL):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


class Lexicon:
    """A minimal acyclic automaton of byte strings with id outputs, in one flat file.

    Layout: magic, five counts, then unsigned 32-bit arrays: each state's first edge, each edge's
    byte and target and number of words passed over, final flags, output offsets, outputs.
    """

    MAGIC = b"FRSHLEX1"

    @classmethod
    def compile(cls, entries: dict[str, list[int]]) -> bytes:
        items = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items())
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        # Along the current word: [final, {byte: state number}] per depth, the last edge still open.
        path = [[False, {}]]

        def close(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(sorted(edges.items())))
                number = register.get(key)
                if number is None:
                    number = register[key] = len(states)
                    states.append(key)
                path[-1][1][word[len(path) - 1]] = number

        last = b""
        for word, _ in items:
            common = len(os.path.commonprefix([last, word]))
            close(common, last)
            path.extend([False, {}] for _ in word[common:])
            path[-1][0] = True
            last = word
        close(0, last)
        final, edges = path[0]
        states.append((final, tuple(sorted(edges.items()))))
        # States are numbered after all that they lead to, so their sizes are known in order.
        size = []
        for final, edges in states:
            size.append(int(final) + sum(size[t] for _, t in edges))
        first, byte, target, skip, finals = [0], [], [], [], []
        for final, edges in states:
            passed = int(final)
            for b, t in edges:
                byte.append(b), target.append(t), skip.append(passed)
                passed += size[t]
            first.append(len(byte))
            finals.append(int(final))
        offsets, outputs = [0], []
        for _, ids in items:
            outputs += ids
            offsets.append(len(outputs))
        arrays = (first, byte, target, skip, finals, offsets, outputs)
        return cls.MAGIC + struct.pack("<7I", *map(len, arrays)) + b"".join(struct.pack(f"<{len(a)}I", *a) for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __init__(self, image: bytes | mmap.mmap):
        self.map = image
        if self.map[:8] != self.MAGIC:
            raise ValueError("not a lexicon")
        counts, at, view = struct.unpack("<7I", self.map[8:36]), 36, memoryview(self.map)
        parts = []
        for n in counts:
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.byte, self.target, self.skip, self.final, self.offsets, self.outputs = parts
        self.root = counts[0] - 2
        # Edges by state and byte, in rising order as they lie in the file.
        first = np.frombuffer(self.first, "<u4").astype(np.int64)
        self.edges = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8 | np.frombuffer(self.byte, "<u4")

    def lookup_many(self, words: list[bytes]) -> list[list[int] | None]:
        """lookup() of many words, all of them one byte at a time."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        skip, target = np.frombuffer(self.skip, "<u4"), np.frombuffer(self.target, "<u4")
        live = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES)) if len(self.edges) else np.zeros(0, np.int64)
        done, at = [], 0
        while len(live):
            key = state[live] << 8 | flat[start[live] + at]
            e = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[e] == key
            live, e = live[ok], e[ok]
            number[live] += skip[e]
            state[live] = target[e]
            at += 1
            ends = size[live] == at
            done.append(live[ends])
            live = live[~ends]
        out: list[list[int] | None] = [None] * len(words)
        final = np.frombuffer(self.final, "<u4")
        for i in np.concatenate(done).tolist() if done else ():
            if final[state[i]]:
                n = int(number[i])
                out[i] = self.outputs[self.offsets[n] : self.offsets[n + 1]].tolist()
        return out

    def lookup(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None."""
        state, number = self.root, 0
        first, byte = self.first, self.byte
        for b in word:
            lo, hi = first[state], first[state + 1]
            while lo < hi:
                mid = (lo + hi) // 2
                if byte[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == first[state + 1] or byte[lo] != b:
                return None
            number += self.skip[lo]
            state = self.target[lo]
        if not self.final[state]:
            return None
        return self.outputs[self.offsets[number] : self.offsets[number + 1]].tolist()


def held(lists: list[list[int]]) -> pa.Array:
    """Lists of ids as strings of unsigned 32-bit numbers."""
    return blobs(np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))


def blobs(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """Ids end to end, of which each row has so many, as strings of unsigned 32-bit numbers."""
    ends = np.append(0, 4 * np.cumsum(size)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, np.uint32))])


def ids_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids in a column of such strings end to end, and where each row's end."""
    data, ends = text_buffer(column)
    return data.view(np.uint32), ends >> 2


class Memory:
    """The ids of short strings that were met, of 2 * ``size`` at most; then those met last stay, half of them.

    Strings of more than SHORT bytes aren't remembered, so what is held is bounded.
    """

    SHORT = 64

    def __init__(self, size: int):
        self.size, self.now = size, 0
        self.texts, self.ids, self.met = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def of(self, texts: pa.Array, make) -> tuple[pa.Array, np.ndarray]:
        """A column of ids, and the place in it of each of some distinct texts; ``make`` gives the ids of the unknown ones, all at once."""
        self.now += 1
        at = pc.index_in(texts, value_set=self.texts)
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        self.met[place[~unknown]] = self.now
        if not unknown.any():
            return self.ids, place
        place[unknown] = len(self.ids) + np.arange(int(unknown.sum()))
        new = texts.filter(pa.array(unknown))
        ids = make(new)
        both = pa.concat_arrays([self.ids, ids])
        short = pc.less_equal(pc.binary_length(new), self.SHORT)
        new, ids = new.filter(short), ids.filter(short)
        self.texts, self.ids, self.met = pa.concat_arrays([self.texts, new]), pa.concat_arrays([self.ids, ids]), np.append(self.met, np.full(len(new), self.now))
        if len(self.texts) > 2 * self.size:
            last = np.sort(np.argsort(-self.met, kind="stable")[: self.size])
            self.texts, self.ids, self.met = self.texts.take(pa.array(last)), self.ids.take(pa.array(last)), self.met[last]
        return both, place


class Codec:
    """Encoding and decoding of words by a vocabulary file."""

    NONE = 1 << 62

    def __init__(self, path: str | None = None, lexicon: Lexicon | None = None):
        with open(path or tokenizer_path(VOCABULARY), encoding="utf-8") as f:
            spec = json.load(f)
        self.id_of = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Two ids in one number to the merge's rank and id in another.
        self.pair = {self.id_of[a] << 20 | self.id_of[b]: rank << 20 | self.id_of[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.token_of = {i: t for t, i in self.id_of.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_of |= {i: t for t, i in self.special.items()}
        symbols = _byte_symbols()
        self.first, self.last = [self.id_of[x] for x in symbols], [self.id_of[x + END] for x in symbols]
        self.first_ids, self.last_ids = np.array(self.first, np.int64), np.array(self.last, np.int64)
        self.pair_keys = np.array(sorted(self.pair), np.int64)
        self.pair_values = np.array([self.pair[k] for k in self.pair_keys.tolist()], np.int64)
        self.words, self.texts = Memory(MEMORY_WORDS), Memory(MEMORY_TEXTS)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lexicon = lexicon

    def merged(self, word: str) -> list[int]:
        """Ids of one word by rank of merges, lowest and leftmost first."""
        body = word.encode("utf-8", "replace")
        ids = [self.first[b] for b in body]
        ids[-1] = self.last[body[-1]]
        if len(ids) > LONG_WORD:
            return self._merged_long(ids)
        pair, none = self.pair.get, self.NONE
        found = [pair(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            low = min(found)
            if low == none:
                break
            i, new = found.index(low), low & 0xFFFFF
            ids[i : i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = pair(ids[i - 1] << 20 | new, none)
            if i < len(found):
                found[i] = pair(new << 20 | ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked symbols, for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two is gone
            ids[i], ids[j] = r & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.pair.get(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> pa.Array:
        """merged() of many words: in each round every word makes its next merge."""
        size = np.array([len(w) for w in words], np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.first_ids[flat]
        end = np.cumsum(size)
        ids[end - 1] = self.last_ids[flat[end - 1]]
        word = np.repeat(np.arange(len(words)), size)

        def values(at):
            key = ids[at] << 20 | ids[at + 1]
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            return np.where(self.pair_keys[k] == key, self.pair_values[k], self.NONE)

        value = np.full(len(ids), self.NONE, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        value[inner] = values(inner)
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(starts, len(word)))
            low = np.minimum.reduceat(value, starts)
            over = low == self.NONE
            if over.any():
                stay = np.repeat(~over, count)
                done.append((word[~stay], ids[~stay]))
                ids, word, value = ids[stay], word[stay], value[stay]
                low, count = low[~over], count[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(value == np.repeat(low, count))
            at = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]  # the leftmost of each word
            ids[at] = value[at] & 0xFFFFF
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
            value = value[keep]
            at -= np.arange(len(at))  # one symbol went before each later place
            ends = np.append(word[1:] != word[:-1], True)
            value[at] = self.NONE
            right = at[~ends[at]]
            value[right] = values(right)
            left = at[at > 0] - 1
            left = left[~ends[left]]
            value[left] = values(left)
        word, ids = (np.concatenate(x) for x in zip(*done))
        return blobs(ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words)))

    def pieces(self, texts) -> list[str]:
        """The words of texts without white space, with a space after each text's."""
        joined = " ".join([*texts, ""])
        if not joined.isascii():
            # Lower case goes by character, so a final sigma is like any other.
            joined = unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3")
        return _PIECES.findall(joined.lower())

    def new_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words: from the automaton, else merged."""
        bodies = [w.encode("utf-8", "replace") for w in words.to_pylist()]
        out: list = [None] * len(bodies) if self.lexicon is None else self.lexicon.lookup_many(bodies)
        short = [i for i, (x, ids) in enumerate(zip(bodies, out)) if ids is None and len(x) <= LONG_WORD]
        long = [i for i, (x, ids) in enumerate(zip(bodies, out)) if ids is None and len(x) > LONG_WORD]
        known = [i for i, ids in enumerate(out) if ids is not None]
        parts = [held([out[i] for i in known]), held([self.merged(bodies[i].decode("utf-8")) for i in long])]
        if short:
            parts.append(self.merge_many([bodies[i] for i in short]))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.array(known + long + short, np.int64))))

    def text_ids(self, texts: pa.Array) -> pa.Array:
        """Ids of texts without white space."""
        pieces = pa.array(self.pieces(texts.to_pylist()), pa.string()).dictionary_encode()
        number, distinct = pieces.indices.to_numpy(), pieces.dictionary
        # A space ends a text; the rest are its words.
        words = pc.not_equal(distinct, " ")
        ends = ~words.to_numpy(zero_copy_only=False)[number]
        column, place = self.words.of(distinct.filter(words), self.new_words)
        of = np.cumsum(words.to_numpy(zero_copy_only=False)) - 1
        ids, at = ids_in(column.take(pa.array(place[of[number[~ends]]])))
        return blobs(ids, np.diff(at[np.flatnonzero(ends) - np.arange(len(texts))], prepend=0))

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts cut at special tokens: the parts, the row of each, and the id of the token after it (-1: none)."""
        rows, special = np.arange(len(texts)), np.full(len(texts), -1)
        hit = np.zeros(len(texts), bool)
        for s in self.special:
            hit |= pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        if not hit.any():
            return texts, rows, special
        parts: list[str] = []
        found_rows, found = [], []
        for i, text in enumerate(texts.to_pylist()):
            pieces = self.cut.split(text) if hit[i] else [text or ""]
            parts += pieces[::2]
            found_rows += [i] * len(pieces[::2])
            found += [*map(self.special.__getitem__, pieces[1::2]), -1]
        return pa.array(parts, pa.string()), np.array(found_rows), np.array(found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts end to end, and where each row's end (with a 0 before)."""
        parts, row, special = self.parts(texts)
        words, first = words_in(parts)
        coded = words.dictionary_encode()
        column, place = self.texts.of(coded.dictionary, self.text_ids)
        ids, at = ids_in(column.take(pa.array(place[coded.indices.to_numpy()])))
        ends = at[first[1:]]
        after = np.flatnonzero(special >= 0)
        ids = np.insert(ids, ends[after], special[after]) if len(after) else ids
        count = np.bincount(row, np.diff(ends, prepend=0) + (special >= 0), minlength=len(texts)).astype(np.int64)
        return ids, np.append(0, np.cumsum(count))

    def decode(self, ids) -> str:
        """The vocabulary has no decoder: its tokens are joined by one space."""
        return " ".join(self.token_of[i] for i in ids)


_codecs: dict = {}


def codec_of(path: str | None, lexicon: str | None = None) -> Codec:
    """A worker's codec; its tables are kept from task to task, what it remembers of texts is not.

    ``lexicon``: name of a file that ``shared_lexicon`` added to the job.
    """
    if (path, lexicon) not in _codecs:
        _codecs.clear()
        _codecs[path, lexicon] = Codec(path, Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None)
    codec = _codecs[path, lexicon]
    codec.texts = Memory(MEMORY_TEXTS)
    return codec


def _word_counts(path):
    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for part in slices(batch.column("text"), COUNT_ROWS, COUNT_BYTES):
                coded = words_in(part)[0].dictionary_encode()
                times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                pieces = pa.array(codec.pieces(coded.dictionary.to_pylist()), pa.string()).dictionary_encode()
                number, distinct = pieces.indices.to_numpy(), pieces.dictionary
                # A space ends a text; texts before a piece give the number of times that it is there.
                space = pc.equal(distinct, " ").to_numpy(zero_copy_only=False)
                ends = space[number]
                of = (np.cumsum(ends) - ends)[~ends]
                n = np.bincount(number[~ends], times[of], minlength=len(distinct)).astype(np.int64)
                short = ~space & (pc.binary_length(distinct).to_numpy() <= LEXICON_BYTES)
                yield pa.RecordBatch.from_arrays([distinct.filter(pa.array(short)), pa.array(n[short])], ["word", "n"])

    return run


def build_lexicon(docs: DataFrame, text_col: str = "text", path: str | None = None, size: int = LEXICON_WORDS) -> bytes:
    """Count the words of all texts and compile the most frequent ones, ``size`` at most.

    Classes of about equal numbers are taken whole, so the driver gets those words and no others.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_word_counts(path), "word string, n long")
    counts = materialise(rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.octet_length("word") <= LEXICON_BYTES), "words")
    # Words by classes of their number: a few hundred rows, from which the least number follows.
    classes = counts.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("c")).collect()
    least, held = None, 0
    for r in classes:
        held += r["words"]
        if held > size:
            break
        least = r["least"]
    top = counts.filter(F.col("n") >= F.lit(least)).select("word").toPandas()
    codec = Codec(path)
    return Lexicon.compile({w: codec.merged(w) for w in top["word"]})


def shared_lexicon(spark: SparkSession, image: bytes) -> str:
    """Write an automaton to the shared folder and have Spark hand it to the executors; its file's name."""
    folder = shared_dir(spark, "lexicon")
    name = folder.rsplit("/", 1)[-1] + ".bin"  # of its own, as a job takes a name once only
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(image)
    finally:
        out.close()
    spark.sparkContext.addFile(place.toString())
    return name


def encoded_slices(codec: Codec, column):
    """For each slice of a column of texts its ids end to end, and where each row's end (with a 0 before)."""
    gc.disable()  # nothing here makes cycles, and looking for them takes long
    try:
        for part in slices(column, SLICE_ROWS, SLICE_BYTES):
            yield codec.encode(part)
    finally:
        gc.enable()


def encoded(codec: Codec, column, make):
    """For each row of a column of texts a list of what ``make`` gives for its ids."""
    for ids, ends in encoded_slices(codec, column):
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield [make(ids[a:b].tolist())]


def _hashed(tokens: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """For each row the SHA-256 of its ids' texts, of which each has a space after it, without the last."""
    data, at = text_buffer(tokens.take(pa.array(ids)))
    at, data = at[ends].tolist(), memoryview(data)
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:])]


def _digests(lexicon, path):
    def run(batches):
        codec = codec_of(path, lexicon)
        ids = range(max(codec.token_of) + 1)
        numbers = pa.array([f"{i} " for i in ids], pa.large_string())
        tokens = pa.array([codec.token_of.get(i, "") + " " for i in ids], pa.large_string())
        for batch in batches:
            n, a, b = [], [], []
            for ids, ends in encoded_slices(codec, batch.column("text")):
                n += np.diff(ends).tolist()
                a += _hashed(numbers, ids, ends)
                b += _hashed(tokens, ids, ends)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256 and decoded_sha256."""
    lexicon = shared_lexicon(docs.sparkSession, build_lexicon(docs, text_col, path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(lexicon, path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _ids(lexicon, path):
    def run(batches):
        codec = codec_of(path, lexicon)
        for batch in batches:
            out = [[i for x in found for i in x] for found in encoded(codec, batch.column("text"), list)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in out], pa.string())], ["id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: the id, its token ids and what they decode to."""
    lexicon = shared_lexicon(docs.sparkSession, build_lexicon(docs, text_col, path))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_ids(lexicon, path), "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)
