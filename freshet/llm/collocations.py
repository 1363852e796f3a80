"""Operator 12: collocations by contiguous pattern growth from projected occurrences.

Within a language a phrase is frequent only if its prefix is, so frequent phrases are grown to
the right, prefix by prefix, and every prefix needs nothing but the places where it occurs:

1. Texts are cut into pieces and words once.  A block of texts keeps its words as numbers of a
   dictionary of its own and counts them; the dictionaries' counts meet per word.
2. Words with a count of at least ``least`` get numbers from frequent to rare and each block is
   told those of its words.  All others end a phrase.
3. A block projects its occurrences: from every frequent word the next words of the piece, up to
   the longest phrase.  Equal ones travel as one with their number.  A prefix goes to one task;
   one that is too frequent for that (a share of HOT of a task) is cut by its next word, so that
   each of its phrases is a task's, and of a phrase there is one entry a block at most.
4. The task grows each of its prefixes depth-first: pointers to the occurrences are grouped by the
   next word, groups of ``least`` occurrences become phrases and are extended in their turn.

Scores, the removal of phrases inside longer ones and the ranks are joins of the phrases found.
Products are DECIMAL(38) and the division is exact.  Words are told apart by their text, never by
a hash.

Defined cases: a null text is empty, a null language is ``und``.  Repeated rows count each time.
Texts of any length are read whole; a very long one is a block of its own.  Other columns are not
read; an empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, numbered, text_buffer

#: Bytes of text in a block, and occurrences a task should grow.
BLOCK_BYTES, TASK_WORDS = 4 << 20, 1 << 20
#: From this share of a task's occurrences on a prefix is cut by its next word.
HOT = 0.125
LEAST, LONGEST, TOP, COVER = 10, 3, 2000, 50
NO_LANG = "und"
#: Parts of a language that are ranked apart before they are ranked together.
PARTS = 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a column of texts, each one's row, and whether it begins a piece."""
    data, offsets = text_buffer(column)
    kind = _CLASS[data]
    inside = kind == 0
    if not inside.any():
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, bool)
    # A text's first byte begins a piece and a word, whatever stands before it.
    begins_text = np.zeros(len(data) + 1, bool)
    begins_text[offsets[:-1]] = True
    first = inside & (np.append(True, ~inside[:-1]) | begins_text[:-1])
    start = np.flatnonzero(first)
    place = np.cumsum(inside)
    bounds = np.append(place[start] - 1, place[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[inside]]))
    pieces = np.cumsum((kind == 2) | begins_text[:-1])[start]
    # Empty texts begin nothing, so a row is the last one that starts at the byte or before.
    row = np.searchsorted(offsets[1:], start, "right")
    return words, row, np.append(True, (pieces[1:] != pieces[:-1]) | (row[1:] != row[:-1]))


def _blocks(batches):
    """Rows of texts as blocks of about BLOCK_BYTES: (block, words as numbers, dictionary and counts)."""
    from pyspark import TaskContext

    part, no = TaskContext.get().partitionId(), 0

    def block(tables):
        nonlocal no
        table = pa.Table.from_batches(tables)
        words, row, begins = words_of(table.column("text"))
        langs = table.column("lang").combine_chunks()
        langs = (pa.concat_arrays(langs.chunks) if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)[row]
        coded = words.dictionary_encode()
        known = max(1, len(coded.dictionary))
        both, code, count = np.unique(lang * known + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        # The top bit marks a word that begins a piece.
        stream = code.astype(np.uint32) | (begins.astype(np.uint32) << np.uint32(31))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + no], pa.int64()),
                pa.array([_planes(stream)], pa.binary()),
                *[pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), x) for x in (pc.take(langs.dictionary, pa.array(both // known)), pc.take(coded.dictionary, pa.array(both % known)).cast(pa.string()), pa.array(count, pa.int64()))],
            ],
            ["block", "stream", "langs", "words", "counts"],
        )
        no += 1
        return out

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, "right")))
            held.append(batch.slice(a, b - a))
            size += int(ends[b - 1]) - done
            if size >= BLOCK_BYTES or b < batch.num_rows:
                yield block(held)
                held, size = [], 0
            a = b
    if held:
        yield block(held)
    pa.default_memory_pool().release_unused()


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, which compress better."""
    return np.ascontiguousarray(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _spread(columns: list[np.ndarray], tasks: int) -> np.ndarray:
    """A task for every row of numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64)


def _merged(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one, with the sum of their weights."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.zeros(len(order), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.add.reduceat(weight[order], at) if len(at) else weight[:0]


def project(stream: np.ndarray, numbers: np.ndarray, hot: np.ndarray, longest: int):
    """A block's projected occurrences: (columns, cut, weight).

    ``numbers`` has the number of each word of the block's dictionary, 0 for those that aren't
    frequent.  ``columns`` are the numbers of an occurrence's words (0: none), ``cut`` is how many
    of them name the task: 1, or all where the first word is hot.  Phrases count from two words
    and from ``cut`` words on.
    """
    code = (stream & np.uint32(0x7FFFFFFF)).astype(np.int64)
    word, begins = numbers[code].astype(np.uint32), (stream >> np.uint32(31)).astype(bool)
    columns, alive = [word], word > 0
    for d in range(1, longest):
        following = np.zeros_like(word)
        if len(word) > d:
            alive[:-d] &= ~begins[d:] & (word[d:] > 0)
            following[:-d] = np.where(alive[:-d], word[d:], 0)
        alive[-d:] = False
        columns.append(following)
    keep = columns[min(1, longest - 1)] > 0
    warm, columns = hot[code][keep], [c[keep] for c in columns]
    parts = []
    for cut in range(1, longest + 1):
        own = ~warm if cut == 1 else warm & (columns[cut - 1] > 0)
        rows = [c[own] if cut == 1 or k < cut else np.zeros(int(own.sum()), np.uint32) for k, c in enumerate(columns)]
        rows, weight = _merged(rows, np.ones(int(own.sum()), np.int64))
        parts.append((rows, np.full(len(weight), cut, np.uint8), weight))
    return [np.concatenate([p[0][k] for p in parts]) for k in range(longest)], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _projected(tasks: int, longest: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                place, number, hot = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("places", "numbers", "hots"))
                stream = batch.column("stream")[i].as_buffer()
                numbers, hots = np.zeros(size, np.int64), np.zeros(size, bool)
                numbers[place], hots[place] = number, hot
                columns, cut, weight = project(_unplanes(stream), numbers, hots, longest)
                task = np.zeros(len(weight), np.int64)
                for n in np.unique(cut).tolist():
                    own = cut == n
                    task[own] = _spread([c[own] for c in columns[:n]], tasks)
                order = np.argsort(task, kind="stable")
                task, cut, weight, columns = task[order], cut[order], weight[order], [c[order] for c in columns]
                starts = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else np.zeros(0, np.int64)
                spans = list(zip(starts.tolist(), np.append(starts[1:], len(task)).tolist()))
                for at in range(0, len(spans), 256):
                    some = spans[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(task[a]) for a, _ in some], pa.int32()),
                            pa.array([b"".join(_planes(c[a:b]) for c in columns) for a, b in some], pa.binary()),
                            pa.array([cut[a:b].tobytes() for a, b in some], pa.binary()),
                            pa.array([_planes(weight[a:b]) for a, b in some], pa.binary()),
                        ],
                        ["task", "rows", "cuts", "weights"],
                    )
        pa.default_memory_pool().release_unused()

    return run


def grow(columns: list[np.ndarray], cut: np.ndarray, weight: np.ndarray, least: int):
    """Yields (phrase, number) of all frequent phrases, depth-first to the right.

    A prefix is its pointers: the places in ``columns`` of the occurrences that begin with it.
    """
    longest = len(columns)
    stack = [((), np.arange(len(weight)), 0)]
    while stack:
        prefix, pointers, depth = stack.pop()
        following = columns[depth][pointers]
        order = np.argsort(following, kind="stable")
        following, pointers = following[order], pointers[order]
        at = np.flatnonzero(np.append(True, following[1:] != following[:-1])) if len(following) else np.zeros(0, np.int64)
        if not len(at):
            continue
        here = weight[pointers] * (cut[pointers] <= depth + 1)
        total = np.add.reduceat(here, at)
        # An entry of a cut prefix counts at its full length only, but must be followed until there.
        reach = np.add.reduceat(weight[pointers], at)
        ends = np.append(at[1:], len(following))
        for g in np.flatnonzero((reach >= least) & (following[at] > 0)).tolist():
            phrase = prefix + (int(following[at[g]]),)
            if depth and total[g] >= least:
                yield phrase, int(total[g])
            if depth + 1 < longest:
                stack.append((phrase, pointers[at[g] : ends[g]], depth + 1))


def _grown(longest: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8)).reshape(longest, -1) for x in table.column("rows").to_pylist()]
        columns = [np.concatenate([_unplanes(p[k].tobytes()) for p in parts]) for k in range(longest)]
        cut = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("cuts").to_pylist()])
        weight = np.concatenate([_unplanes(x) for x in table.column("weights").to_pylist()]).astype(np.int64)
        found = list(grow(columns, cut, weight, least))
        return pa.table({"phrase": pa.array([p for p, _ in found], pa.list_(pa.int64())), "a": pa.array([n for _, n in found], pa.int64())})

    return run


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (phrase: numbers of its words, a), of one word too; the frequent words (number, lang, word, f); all words of each language (lang, n)."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    with arrow_batches(docs.sparkSession):
        blocks = materialise(rows.mapInArrow(_blocks, "block long, stream binary, langs array<string>, words array<string>, counts array<long>"), "blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "e")).select("block", "place", F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.counts").alias("count"))
    counted = materialise(entries.groupBy("lang", "word").agg(F.sum("count").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    all_words = counted.agg(F.sum("f")).first()[0] or 0
    tasks = max(64, -(-all_words // TASK_WORDS))
    words = numbered(counted.filter(F.col("f") >= least).orderBy(F.desc("f"), "lang", "word"), "frequent", "number").withColumn("number", F.col("number") + 1)
    words = words.withColumn("hot", F.col("f") >= F.lit(max(least, int(HOT * all_words / tasks))))
    told = entries.select("block", "lang", "word", "place").join(words.select("lang", "word", "number", "hot"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "number", "hot")).alias("told"))
    met = blocks.select("block", "stream", F.size("words").alias("size")).join(told, "block").select("stream", "size", F.col("told.place").alias("places"), F.col("told.number").alias("numbers"), F.col("told.hot").alias("hots"))
    projected = met.mapInArrow(_projected(tasks, longest), "task int, rows binary, cuts binary, weights binary")
    grown = projected.groupBy("task").applyInArrow(_grown(longest, least), "phrase array<long>, a long")
    single = words.select(F.array("number").alias("phrase"), F.col("f").alias("a"))
    with arrow_batches(docs.sparkSession):
        return materialise(grown.unionByName(single), "phrases"), words, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Per language the ``top`` phrases by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    See the module's docstring for the method and for null, empty and repeated input.
    """
    found, words, totals = phrases(docs, text_col, lang_col, least, longest)
    long = found.filter(F.size("phrase") > 1)

    size = F.size("phrase")
    pieces = long.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("right"))
    of_left, of_right = (found.select(F.col("phrase").alias(side), F.col("a").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    wide = "cast({} as decimal(38,0))"
    score = F.expr(f"({wide.format(1000000)} * {wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')})")
    cuts = pieces.join(of_left, "left").join(of_right, "right").withColumn("score", score)
    scored = cuts.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Every phrase inside a longer one, with the longer one's number.
    inner = long.filter(size > 2).select("a", "phrase", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).select("a", "phrase", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    held = inner.select(F.slice("phrase", F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    left = scored.join(held, "phrase", "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * cover)).drop("longer")

    named = left.select("phrase", "a", "cut", F.posexplode("phrase").alias("at", "number")).join(words.select("number", "lang", "word"), "number")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy("phrase", "a", "cut").agg(F.first("lang").alias("lang"), text.alias("said"))
    # The best of parts of a language first, so that the last step gets a bounded number of each.
    order = [F.desc("cut.score"), F.desc("a"), "said"]
    best = named.withColumn("part", F.pmod(F.xxhash64("said"), F.lit(PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("said").alias("phrase"), "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


#: DuckDB's form for phrases of two and three words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (
  SELECT lang, ws[i] AS p, 1 AS m FROM s
  UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1], 2 FROM s WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], 3 FROM s WHERE i + 2 <= len(ws)
),
f AS (SELECT lang, p, m, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, p, m, a, string_split(p, ' ') AS x FROM f WHERE m > 1 AND a >= 10),
k AS (
  SELECT lang, p, a, 1 AS k, x[1] AS lp, array_to_string(x[2:], ' ') AS rp FROM c
  UNION ALL SELECT lang, p, a, 2, x[1] || ' ' || x[2], x[3] FROM c WHERE m = 3
),
sc AS (
  SELECT k.lang, k.p, k.a, k.k, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.p = k.lp JOIN f r ON r.lang = k.lang AND r.p = k.rp
),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
h AS (
  SELECT lang, sub, max(a) AS longer
  FROM (SELECT lang, x[1] || ' ' || x[2] AS sub, a FROM c WHERE m = 3 UNION ALL SELECT lang, x[2] || ' ' || x[3], a FROM c WHERE m = 3) GROUP BY ALL
),
o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.sub = b.p WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, score FROM o)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n, t.score FROM t JOIN n ON n.lang = t.lang WHERE t.rank <= 2000
"""
