"""Operator 13: repair of damaged conversations by shortest paths.

A conversation's rows are the layers of a graph whose nodes are (rows taken, state of the role
pattern).  Keep, Rerole, Delete and Insert are arcs with costs of 0 to 3, so distances to the end
are found by Dial's bucket queue: nodes wait in a bucket per distance and no heap is needed.  From
the start the walk then takes, of the arcs that lie on a shortest path, the one with the least
letter, which gives the least audit.  Rows that must go (blank, duplicate) are no layers: each
adds one Delete where it stands.

Rows are range-partitioned by conversation and order, so a conversation of any size is spread over
tasks.  What lies inside a partition is repaired there.  Of those that cross its ends, or that
have more than SEGMENT_ROWS rows or SEGMENT_BYTES of text, every segment yields its costs between
pattern states; a backward fold over these small tables gives each segment its distances to the
end, and one stream in order walks them.  That stream is one task a conversation, since the digest
of the whole repaired text is, but it holds one segment at a time (and the audit).

Defined cases: nulls in role and text become one space, a null turn comes first and a null conv_id
is a conversation of its own.  Rows of equal turn go by role, then text.  Roles are read by their
first letter in lower case, others fit nowhere.  Equal rows are counted before they travel, all
after the first being duplicates.  Texts of any length are repaired whole, other columns are not
read, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shard_count

#: Bounds of what a task holds of one conversation.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Pattern states: nothing yet, after system, after user, after assistant.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
BEFORE = tuple(tuple(s for s in range(4) if NEXT[s] == t) for t in range(4))
NAMES = {2: "user", 3: "assistant"}
FAR = 1 << 60
END = (0, FAR, FAR, 0)
WHITE = " \t\n\x0b\x0c\r"
_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LISTS = {"roles": "array<string>", "texts": "array<string>", "turns": "array<bigint>", "firsts": "array<boolean>", "copies": "array<bigint>"}
_RESULT = ", ".join(["conv_id long", *[f"{x} long" for x in _SUMS], "audit string", "repaired_sha256 string"])
_TABLE = ", ".join([_RESULT, "part int, no int", *[f"{k} {v}" for k, v in _LISTS.items()], "matrix array<bigint>"])


def distances(layers: list[tuple[str, int]], ends) -> list[list[int]]:
    """Least cost from every node (layer, state) to the end, where state s costs ends[s] more; by Dial's buckets.

    ``layers`` has the role's initial of each row that may stay, and the cost of leaving it there.
    """
    n = len(layers)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    base = min(ends)
    buckets: list[list[tuple[int, int]]] = []

    def reach(i, s, d):
        if d < dist[i][s]:
            dist[i][s] = d
            while len(buckets) <= d - base:
                buckets.append([])
            buckets[d - base].append((i, s))

    for s in range(4):
        if ends[s] < FAR:
            reach(n, s, ends[s])
    at = 0
    while at < len(buckets):
        for i, s in buckets[at]:
            d = at + base
            if dist[i][s] != d:
                continue
            for p in BEFORE[s]:
                reach(i, p, d + INSERT)
            if i:
                initial, stay = layers[i - 1]
                reach(i - 1, s, d + DELETE)
                for p in BEFORE[s]:
                    reach(i - 1, p, d + REROLE + stay)
                for p in range(4):
                    if STEP[p].get(initial) == s:
                        reach(i - 1, p, d + KEEP + stay)
        buckets[at] = []
        at += 1
    return dist


class Segment:
    """Consecutive rows of a conversation, their faults and the layers that may stay."""

    def __init__(self, roles, texts, turns, firsts, copies):
        self.rows = (roles, texts, turns, firsts, copies)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.layers, self.held, self.forced = [], [], [0]
        self.start = self.last = None
        known = [t for t in turns if t is not None]
        self.turns = (known[0], known[-1], len(set(known))) if known else None
        for k, (role, text, first, n) in enumerate(zip(roles, texts, firsts, copies)):
            initial, body = role[:1], text.strip(WHITE)
            if self.start is None:
                self.start = initial
            elif self.last + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.illegal += n - 1
            self.last = initial
            if not body:
                self.blank += n
                self.forced[-1] += n
                continue
            again = n - 1 if first else n
            if first:
                cut = body[-1] not in ".!?"
                self.truncated += cut
                self.layers.append((initial, TRUNCATED if cut else 0))
                self.held.append(k)
                self.forced.append(0)
            self.duplicate += again
            self.forced[-1] += again

    def matrix(self) -> list[int]:
        """Costs from state s at its start to state t at its end, as 4 * s + t; what must go included."""
        must = DELETE * sum(self.forced)
        by_end = [distances(self.layers, tuple(0 if s == t else FAR for s in range(4)))[0] for t in range(4)]
        return [min(FAR, by_end[t][s] + must) for s in range(4) for t in range(4)]


class Walk:
    """The repair of one conversation, fed with its segments in order."""

    def __init__(self):
        self.state, self.cost, self.audit, self.digest, self.lines = 0, None, [], hashlib.sha256(), 0
        self.sums = dict.fromkeys(_SUMS, 0)
        self.last = self.low = self.high = None
        self.distinct = 0

    def _line(self, role, text):
        self.digest.update(("\n" * bool(self.lines) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def feed(self, seg: Segment, ends) -> None:
        """``ends``: the least cost of all that follows, by the state at this segment's end."""
        dist = distances(seg.layers, ends)
        if self.cost is None:
            self.cost = dist[0][0] + DELETE * sum(seg.forced)
        for k in ("blank", "duplicate", "truncated", "illegal"):
            self.sums[k] += getattr(seg, k)
        if self.last is not None and seg.start is not None and self.last + seg.start not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        if seg.last is not None:
            self.last = seg.last
        if seg.turns:
            a, b, n = seg.turns
            self.distinct += n - (self.high == a)
            self.low, self.high = a if self.low is None else self.low, b
        roles, texts = seg.rows[:2]
        i, s, n = 0, self.state, len(seg.layers)
        self.audit.append("D" * seg.forced[0])
        while True:
            left = dist[i][s]
            if i == n and left == ends[s]:
                break
            if i < n and left == DELETE + dist[i + 1][s]:
                edit, i = "D", i + 1
            elif left == INSERT + dist[i][NEXT[s]]:
                s, edit = NEXT[s], "I"
                self._line(NAMES[s], "")
                self.audit.append(edit)
                continue
            else:
                initial, stay = seg.layers[i]
                k, to, i = seg.held[i], STEP[s].get(initial), i + 1
                if to is not None and left == KEEP + stay + dist[i][to]:
                    s, edit = to, "K"
                    self._line(roles[k], texts[k])
                else:
                    s, edit = NEXT[s], "R"
                    self._line(NAMES[s], texts[k])
            self.audit.append(edit + "D" * seg.forced[i])
        self.state = s

    def result(self, conv) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": conv, **self.sums, "gaps": gaps, "cost": self.cost or 0, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _rows(batches, names):
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _tables(rows, schema: pa.Schema, size: int = 512):
    """The rows in batches of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 1 + len(row.get("texts") or ())
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_ARROW = pa.schema([("conv_id", pa.int64()), *[(x, pa.int64()) for x in _SUMS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_WIDE = pa.schema([*_ARROW, ("part", pa.int32()), ("no", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("firsts", pa.list_(pa.bool_())), ("copies", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64()))])


def _repair_partition(batches):
    """Of one ordered partition: results of the conversations inside it, segments of the others."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def built(held):
        return Segment(*map(list, zip(*held))) if held else Segment([], [], [], [], [])

    def segment(conv, no, held):
        seg = built(held)
        return {"conv_id": conv, "part": part, "no": no, "matrix": seg.matrix()} | dict(zip(_LISTS, seg.rows))

    def run():
        # no: the next segment's number in this partition; inside: nothing of the conversation was yielded or lies in another partition.
        conv, held, size, no, inside, begun = None, [], 0, 0, False, False
        for c, role, text, turn, first, copies in _rows(batches, ("c", "role", "text", "t", "first", "copies")):
            if begun and c != conv:
                if inside:
                    walk = Walk()
                    walk.feed(built(held), END)
                    yield walk.result(conv)
                else:
                    yield segment(conv, no, held)
                    no += 1
                held, size, inside = [], 0, True
            conv, begun = c, True
            if copies:
                held.append((role, text, turn, first, copies))
                size += len(text)
                if len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                    yield segment(conv, no, held)
                    held, size, no, inside = [], 0, no + 1, False
        if begun:
            yield segment(conv, no, held)

    yield from _tables(run(), _WIDE)


def _costs_to_end(batches):
    """Segments of a conversation, last first: the least cost of all that follows each."""
    schema = pa.schema([("c", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("ends", pa.list_(pa.int64()))])

    def run():
        conv, ends, begun = None, END, False
        for c, part, no, matrix in _rows(batches, ("c", "part", "no", "matrix")):
            if not begun or c != conv:
                conv, ends, begun = c, END, True
            yield {"c": c, "part": part, "no": no, "ends": list(ends)}
            ends = tuple(min(FAR, *(matrix[4 * s + t] + ends[t] for t in range(4))) for s in range(4))

    yield from _tables(run(), schema)


def _walk_segments(batches):
    def run():
        conv, walk = None, None
        for c, ends, *lists in _rows(batches, ("c", "ends", *_LISTS)):
            if walk is None or c != conv:
                if walk is not None:
                    yield walk.result(conv)
                conv, walk = c, Walk()
            walk.feed(Segment(*lists), tuple(ends))
        if walk is not None:
            yield walk.result(conv)

    yield from _tables(run(), _ARROW)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (c, t, role, text, copies) that the damage leaves; one with 0 copies for a conversation that lost some."""
    known = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    name = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("c", "t")]
    hit = known.withColumn("code", F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    left = hit.filter("code != 0").select("c", "t", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("n"))
    gone = hit.filter("code = 0").select("c").distinct().select("c", F.lit(None).cast("long").alias("t"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    return left.groupBy("c", "t", "role", "text").agg(F.sum("n").cast("long").alias("copies")).unionByName(gone)


def repair(rows: DataFrame, partitions: int) -> DataFrame:
    """One row per conversation of ``rows`` (c, t, role, text, copies): its faults, cost, audit and digest."""
    keyed = rows.withColumn("said", F.when(F.col("copies") > 0, F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    place = F.struct(F.col("t").isNotNull().alias("known"), F.col("t").alias("t"))
    again = keyed.filter("said is not null").groupBy("c", "said").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("c").alias("c2"), F.col("said").alias("said2"), "place")
    marked = keyed.join(again, F.col("c").eqNullSafe(F.col("c2")) & (F.col("said") == F.col("said2")), "left")
    marked = marked.select("c", "t", "role", "text", "copies", (F.col("place").isNull() | (F.col("place") == place)).alias("first"))
    order = ["c", "t", "role", "text"]
    # Partitions are cut by a text's first characters, as a sample of what cuts them goes to the driver.
    placed = marked.repartitionByRange(partitions, "c", "t", "role", F.substring("text", 1, 24)).sortWithinPartitions(*order)
    done = materialise(placed.mapInArrow(_repair_partition, _TABLE), "repairs")

    cut = done.filter("part is not null").withColumnRenamed("conv_id", "c")
    small = cut.select("c", "part", "no", "matrix").repartition("c").sortWithinPartitions(F.asc("c"), F.desc("part"), F.desc("no"))
    ends = small.mapInArrow(_costs_to_end, "c long, part int, no int, ends array<bigint>").drop("c")
    whole = cut.drop("matrix").join(ends, ["part", "no"])
    walked = whole.repartition("c").sortWithinPartitions("c", "part", "no").mapInArrow(_walk_segments, _RESULT)
    return done.filter("part is null").select(*walked.columns).unionByName(walked)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost (longs), audit and repaired_sha256 after the damage.

    See the module's docstring for null, empty, repeated and very long input.
    """
    return repair(damaged(conversations), shard_count(conversations))
