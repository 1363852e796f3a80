"""Operator 6: packing of token sequences by bin completion.

Texts are encoded (each followed by a separator id) and cut into pieces of at most ``capacity``
tokens.  Only the number of pieces of each length matters to the packing, and there are at most
``capacity`` lengths, so the whole corpus is packed from that histogram: the plan is a list of
patterns (how often which length) with their multiplicities, bounded whatever the input.

The plan comes from a branch-and-bound over bins: around the largest length that is left, all
undominated fillings of the rest are enumerated, tightest first; a branch is cut when its waste
exceeds what the incumbent allows.  The first incumbent is best-fit decreasing.  Pieces then look up their place
from their rank within their length; ranks are counted per shard and added up, so a length that
a third of all pieces have is spread like any other.

Defined cases: a null text is the empty text, one piece of the separator alone; a very long text
is as many pieces as it needs; equal rows, and rows with equal ids, are packed separately (of
equal pieces any may have either place); a null id packs like any other; columns besides the id
and the text are left out, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec_of, encoded_slices
from .common import materialise, shard_count

CAPACITY = 2048
SEPARATOR = 0
#: Fillings that the search may look at in all, and nodes on its way that keep theirs open.
NODES, OPEN = 50_000, 64

Pattern = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram of lengths."""
    open_: dict[int, list[list]] = defaultdict(list)  # room: [pattern, bins]
    rooms: list[int] = []

    def put(pattern: Pattern, bins: int, room: int) -> None:
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append([pattern, bins])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                bins = left // each
                if bins:
                    put(((length, each),), bins, capacity - each * length)
                if left % each:
                    put(((length, left % each),), 1, capacity - left % each * length)
                break
            room = rooms[at]
            pattern, bins = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = min(room // length, left)
            used = min(bins, left // each)
            put((*pattern, (length, each)), used, room - each * length)
            if used < bins:
                put(pattern, bins - used, room)
            left -= used * each
    return [(p, b) for groups in open_.values() for p, b in groups]


def _reach(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each number of the first lengths the sums that their pieces can have, as bits."""
    found, mask = [1], (1 << room + 1) - 1
    for x in lengths:
        sums, n, step = found[-1], min(counts[x], room // x), 1
        while n > 0:
            sums |= sums << min(step, n) * x & mask
            n, step = n - step, 2 * step
        found.append(sums)
    return found


def _exact(lengths: list[int], counts: dict[int, int], reach: list[int], top: int, target: int):
    """Fillings of exactly ``target`` by the first ``top`` lengths, large pieces first."""
    if target == 0:
        yield ()
        return
    for i in range(bisect.bisect_right(lengths, target, 0, top), 0, -1):
        if not reach[i] >> target & 1:
            return
        x = lengths[i - 1]
        for k in range(min(counts[x], target // x), 0, -1):
            if reach[i - 1] >> target - k * x & 1:
                for rest in _exact(lengths, counts, reach, i - 1, target - k * x):
                    yield ((x, k), *rest)


def _smeared(bits: int, width: int) -> int:
    """Every bit also at the ``width`` places above it."""
    span = 1
    while span <= width:
        bits |= bits << min(span, width + 1 - span)
        span *= 2
    return bits


def dominated(filling: Pattern, others: int, waste: int) -> bool:
    """Whether a piece left out (a bit of ``others``) could take the place of some of the filling's, or of the waste."""
    one = two = 0  # sums of single pieces, and of two at least
    for x, k in filling:
        for _ in range(k):
            two |= (one | two) << x
            one |= 1 << x
    longer = _smeared(one << 1, waste - 1) | _smeared(2, waste - 1) if waste else 0
    return bool((longer | _smeared(two, waste)) & others)


def fillings(room: int, counts: dict[int, int], most: int):
    """All undominated fillings of a room that waste ``most`` at most, tightest first, one at a time."""
    lengths = [x for x in sorted(counts) if 0 < x <= room and counts[x] > 0]
    reach = _reach(lengths, counts, room)
    all_ = sum(1 << x for x in lengths)
    for waste in range(min(most, room) + 1):
        if reach[-1] >> room - waste & 1:
            for filling in _exact(lengths, counts, reach, len(lengths), room - waste):
                others = all_ & ~sum(1 << x for x, k in filling if counts[x] == k)
                yield None if dominated(filling, others, waste) else (filling, waste)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: for each threshold, pieces over half a bin need bins of their own, and what lies between must fit beside them."""
    n, total = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for x, k in counts.items():
        n[x], total[x] = k, x * k
    n, total, half = np.cumsum(n), np.cumsum(total), capacity // 2
    best = 0
    for a in range(half + 1):
        large, middle = int(n[capacity] - n[capacity - a]), int(n[capacity - a] - n[half])
        small = int(total[half] - (total[a - 1] if a else 0)) - (middle * capacity - int(total[capacity - a] - total[half]))
        best = max(best, large + middle + max(0, -(-small // capacity)))
    return best


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns with the numbers of their bins, as few bins as the search finds.

    At each node the largest piece left opens a bin, which each undominated filling completes in
    turn, used as often as there are pieces for it or else once.  A branch ends when its waste
    shows that it needs more bins than the incumbent, which is the best-fit solution at first; a
    solution of the search's own replaces that from an equal number of bins on.  ``nodes`` bounds
    the fillings that are looked at, not the pieces: the incumbent packs all of them.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    if not left:
        return []
    total, bound = sum(x * n for x, n in left.items()), least_bins(left, capacity)
    best = best_fit(left, capacity)
    best_bins, own = sum(b for _, b in best), False
    chosen: list[tuple[Pattern, int]] = []
    bins = lost = looked = 0
    spare = lambda: (best_bins - own) * capacity - total

    def options(most: int):
        top = max(left)
        rest = left | {top: left[top] - 1}
        for found in fillings(capacity - top, rest, most):
            if found is None:
                yield None
                continue
            parts = defaultdict(int, {top: 1})
            for x, k in found[0]:
                parts[x] += k
            pattern = tuple(sorted(parts.items(), reverse=True))
            for times in sorted({min((rest[x] + (x == top)) // k for x, k in parts.items()), 1}, reverse=True):
                yield pattern, times, found[1]

    # Frames: the options of a node, how many were taken, and what waste was allowed.  Only the last
    # ones keep their options open; those before are made again when the search comes back.
    frames = [[options(spare()), 0, spare()]]
    applied: list[tuple[Pattern, int, int]] = []
    while frames and looked <= nodes and not (own and best_bins <= bound):
        if len(applied) == len(frames):  # back from below
            pattern, times, waste = applied.pop()
            chosen.pop()
            for x, k in pattern:
                left[x] = left.get(x, 0) + k * times
            bins, lost = bins - times, lost - times * waste
        frame = frames[-1]
        if frame[0] is None:
            frame[0] = islice(options(frame[2]), frame[1], None)
        frame[1] += 1
        looked += 1
        try:
            option = next(frame[0])
        except StopIteration:
            frames.pop()
            continue
        if option is None:
            continue
        pattern, times, waste = option
        if lost + times * waste > spare():
            continue
        for x, k in pattern:
            left[x] -= k * times
            if not left[x]:
                del left[x]
        chosen.append((pattern, times))
        applied.append(option)
        bins, lost = bins + times, lost + times * waste
        if left:
            frames.append([options(spare() - lost), 0, spare() - lost])
            if len(frames) > OPEN:
                frames[-OPEN - 1][0] = None
        else:
            best, best_bins, own = list(chosen), bins, True
            frames.append([iter(()), 0, 0])
    return best


class Plan:
    """Places of pieces by length and rank."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        first: dict[int, int] = defaultdict(int)
        base = 0
        for pattern, bins in patterns:
            at = 0
            for length, each in pattern:
                rows[length].append((first[length], base, each, at))
                first[length] += bins * each
                at += length * each
            base += bins
        self.sequences = base
        self.rows = {x: np.array(r, np.int64) for x, r in rows.items()}

    def places(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rows[length]
        row = r[np.searchsorted(r[:, 0], rank, "right") - 1]
        local = rank - row[:, 0]
        return row[:, 1] + local // row[:, 2], row[:, 3] + local % row[:, 2] * length


def _pieces(lexicon, path, capacity: int):
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        codec = codec_of(path, lexicon)
        for batch in batches:
            out, rows = {n: [] for n in names}, iter(batch.column("id").to_pylist())
            for ids, ends in encoded_slices(codec, batch.column("text")):
                # Each text's ids and the separator, as little-endian numbers.
                body = memoryview(np.insert(ids, ends[1:], SEPARATOR).astype("<u4"))
                ends = (ends + np.arange(len(ends))).tolist()
                for a, b, i in zip(ends[:-1], ends[1:], rows):
                    for k, at in enumerate(range(a, b, capacity)):
                        part = body[at : min(at + capacity, b)]
                        for n, x in zip(names, (i, k, at - a, len(part), zlib.crc32(part))):
                            out[n].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int32() if n == "piece" else pa.int64()) for n in names], names)

    return run


def _placed(plan):
    def run(pieces: pa.Table, firsts: pa.Table) -> pa.Table:
        length = pieces.column("length").to_numpy()
        order = np.lexsort((pieces.column("ids_crc32").to_numpy(), pieces.column("piece").to_numpy(), pieces.column("id").fill_null(-1).to_numpy(), length))
        pieces = pieces.take(pa.array(order))
        length = length[order]
        first = dict(zip(firsts.column("size").to_pylist(), firsts.column("first").to_pylist()))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        cuts = np.flatnonzero(np.append(True, length[1:] != length[:-1])) if len(length) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(length)).tolist()):
            x = int(length[a])
            sequence[a:b], offset[a:b] = plan.value.places(x, first[x] + np.arange(b - a))
        return pieces.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, lexicon: str | None = None) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id and offset.

    ``lexicon``: an automaton of ``bpe.shared_lexicon``; without one all words are merged exactly.
    """
    spark = docs.sparkSession
    parts = shard_count(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = rows.mapInArrow(_pieces(lexicon, path, capacity), "id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialise(cut.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)).cast("int")), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` rows, whatever the input.
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(bin_completion(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("part").alias("of"), F.col("length").alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = pieces.groupBy("part").cogroup(firsts.groupBy("of")).applyInArrow(_placed(plan), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
