"""Operator 11: approximate nearest neighbours by shifted space-filling curves.

1. Every vector is projected CURVES times to DIMENSIONS numbers (random orthogonal directions,
   shifted by a random offset each time) and gets its place on a Hilbert curve through that space:
   a binary key that sorts as the curve runs.
2. (curve, key, vec_id) is range-partitioned and sorted by Spark, so every row has a rank; no key
   is too frequent for it, as the id is part of the order.
3. A query looks at the rows at most ``window`` ranks away on each curve.  Ranks are cut into
   tiles; a query is sent to the tiles that its window touches and a task streams the queries
   past one tile of vectors, so that only each tile's nearest travel on.  These lists merge to the
   nearest of all curves, ranked by exact inner products.
4. The window is fitted: for a bounded sample of queries (SAMPLE) the true neighbours come from
   one scan over all rows, and the window is the least that finds a share of RECALL of them on
   any curve, at least LEAST_WINDOW.  Every row is indexed, nothing else is sampled.

Of equal vectors only the k + 1 smallest ids can be near anything, so only these are candidates;
all of them remain queries.  Inner products are sums of double products from the first component
to the last.

Defined cases: vectors null, empty, zero or holding null or non-finite components take no part,
nor do null ids.  Shorter vectors count as padded with zeros.  Rows that share an id are one point
with several vectors: the largest product counts, and none is its own neighbour.  Other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered

CURVES, DIMENSIONS, BITS, SEED = 16, 8, 16, 11
#: Queries whose true neighbours fit the window, the share of them to find, and the smallest window.
SAMPLE, RECALL, LEAST_WINDOW = 128, 0.96, 1024
#: Ranks in a tile, and curve places in a range partition.
TILE, PART_ROWS = 4096, 32768
#: A product's error by the order of summation, as a share of the vectors' norms.
SLACK = 1e-12


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of cells (n, k), of so many bits a coordinate, on the Hilbert curve, as rows of bytes that sort alike.

    Gray-code form: the axes are turned and mirrored level by level, from the coarsest bit down.
    """
    x = cells.T.astype(np.uint32).copy()
    k, n = x.shape
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(k):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & below)
            x[i] ^= swap
            x[0] ^= np.where(high, below, swap)
    for i in range(1, k):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x[i] >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1) for i in range(k)], axis=1)
    return np.packbits(planes.astype(np.uint8), axis=1)


def projections(size: int, curves: int, dimensions: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per curve its orthogonal directions (size, dimensions) and its shift, as shares of the cube's side."""
    random = np.random.default_rng(SEED)
    out = []
    for _ in range(curves):
        directions = np.linalg.qr(random.normal(size=(max(size, dimensions), dimensions)))[0][:size]
        out.append((directions, random.random(dimensions) * 0.5))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.zeros(0)


def _matrix(column, size: int, dtype) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), size).astype(np.float64)


def _packed(size: int, dtype):
    """Vectors as bytes, padded to one length; those that take no part go."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            start = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(dtype)
            lengths = np.diff(start)
            out = np.zeros((len(lengths), size), dtype)
            row = np.repeat(np.arange(len(lengths)), lengths)
            out[row, np.arange(start[0], start[-1]) - start[row]] = values[start[0] : start[-1]]
            good = np.flatnonzero(np.isfinite(out).all(axis=1) & (out != 0).any(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array([x.tobytes() for x in out[good]], pa.binary())], ["id", "v"])

    return run


def _on_curves(size: int, dtype, curves: int, dimensions: int):
    """Each vector once per curve, with its key there; coordinates are clipped at norms' scale."""

    def run(batches):
        plans = projections(size, curves, dimensions)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), size, dtype)
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            for c, (directions, shift) in enumerate(plans):
                # Projections of unit vectors lie within a few spreads of 1 / sqrt(size) around zero.
                side = np.clip(unit @ directions * np.sqrt(size) / 6 + 0.5, 0, 1)
                cells = np.minimum(((side + shift) / 1.5) * (1 << BITS), (1 << BITS) - 1)
                keys = hilbert_keys(cells.astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), c, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), batch.column("id"), batch.column("candidate"), batch.column("v")], ["curve", "key", "id", "candidate", "v"]
                )

    return run


def _nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, allowed=None):
    """(query's place, row's place, product) of each query's k largest products and all that may tie with the last."""
    score = queries @ rows.T
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    if allowed is not None:
        score[~allowed] = -np.inf
    error = SLACK * np.sqrt((queries * queries).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1))[None, :]
    least = np.partition(score - error, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
    q, r = np.nonzero((score + error >= least[:, None]) & (score > -np.inf))
    return q, r, products(queries[q], rows[r])


def _scan(sample, size: int, dtype, k: int):
    """Nearest rows of the sampled queries within each batch."""

    def run(batches):
        ids, queries = sample.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, own = _matrix(batch.column("v"), size, dtype), batch.column("id").to_numpy()
            q, r, score = _nearest(queries, ids, rows, own, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[r]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _past_tiles(size: int, dtype, k: int, window: int):
    """Streams tiles: the rows of one are held, the queries sent to it are compared batch by batch."""

    def run(batches):
        tile, held, built = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, is_query = batch.column("tile").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.append(True, (tiles[1:] != tiles[:-1]) | (is_query[1:] != is_query[:-1])))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(tiles)).tolist()):
                part = batch.slice(a, b - a)
                if tiles[a] != tile:
                    tile, held, built = tiles[a], [], None
                curve, rank, own = (part.column(n).to_numpy() for n in ("curve", "rank", "id"))
                v = _matrix(part.column("v"), size, dtype)
                if not is_query[a]:
                    held.append((curve, rank, own, v))
                    continue
                if not held:
                    continue
                if built is None:
                    built = [np.concatenate(x) for x in zip(*held)]
                there, places, ids, rows = built
                for i in range(0, len(own), 512):
                    s = slice(i, i + 512)
                    allowed = (curve[s][:, None] == there[None, :]) & (np.abs(rank[s][:, None] - places[None, :]) <= window)
                    q, r, score = _nearest(v[s], own[s], rows, ids, k, allowed)
                    yield pa.RecordBatch.from_arrays([pa.array(own[s][q]), pa.array(ids[r]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_FOUND = "query_id long, vec_id long, score double"


def fitted_window(places: DataFrame, sample: DataFrame, truth: DataFrame, recall: float = RECALL, least: int = LEAST_WINDOW) -> int:
    """The least window that finds so large a share of the sampled queries' true neighbours.

    ``places`` has (id, curve, rank) of all rows, ``sample`` the queries' ids, ``truth`` pairs of
    query and neighbour; both are bounded by the sample, and so is what reaches the driver.
    """
    of_query = places.join(F.broadcast(sample.select("id").distinct()), "id").select(F.col("id").alias("query_id"), "curve", F.col("rank").alias("at"))
    near = truth.select("query_id", "vec_id").join(F.broadcast(of_query), "query_id")
    gaps = places.withColumnRenamed("id", "vec_id").join(F.broadcast(near), ["vec_id", "curve"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("gap"))
    found = np.sort(gaps.toArrow().column("gap").to_numpy())
    return max(least, int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))])) if len(found) else least


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, dimensions: int = DIMENSIONS, sample_rows: int = SAMPLE, recall: float = RECALL, least_window: int = LEAST_WINDOW, tile: int = TILE) -> DataFrame:
    """The ``k`` nearest found of every vector whose id is divisible by ``every``: query_id, rank, vec_id and score.

    See the module's docstring for null, zero, repeated and empty input.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype, name = (np.float32, "float") if kind == "float" else (np.float64, "double")
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{name}>").alias("v")).filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    size = raw.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Of equal vectors the k + 1 smallest ids are candidates; Spark keeps no more of each before it shuffles.
    equal = Window.partitionBy("v").orderBy("id")
    packed = raw.mapInArrow(_packed(size, dtype), "id long, v binary").dropDuplicates()
    firsts = packed.withColumn("at", F.row_number().over(equal)).filter(F.col("at") <= k + 1).select("id", "v", F.lit(True).alias("candidate"))
    asked = packed.filter(F.col("id") % every == 0).join(firsts.select("id", "v"), ["id", "v"], "left_anti").select("id", "v", F.lit(False).alias("candidate"))
    points = materialise(firsts.unionByName(asked), "points")
    total = points.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    placed = points.mapInArrow(_on_curves(size, dtype, curves, dimensions), "curve int, key binary, id long, candidate boolean, v binary")
    parts = max(1, -(-total * curves // PART_ROWS))
    order = ["curve", "key", "id"]
    ranked = numbered(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("key"), "curves", "rank")

    chosen = points.filter(F.col("id") % every == 0).select("id", "v").orderBy(F.xxhash64("id"), "v").limit(sample_rows).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = spark.sparkContext.broadcast((chosen.column("id").to_numpy(), _matrix(chosen.column("v"), size, dtype)))
    truth = materialise(_ranked(points.filter("candidate").mapInArrow(_scan(sample, size, dtype, k), _FOUND), k), "truth")
    window = fitted_window(ranked.select("id", "curve", "rank"), truth.select(F.col("query_id").alias("id")), truth, recall, least_window)

    rows = ranked.filter("candidate").select(F.expr(f"rank div {tile}").alias("tile"), F.lit(False).alias("query"), "curve", "rank", "id", "v")
    sent = ranked.filter(F.col("id") % every == 0).select(F.explode(F.expr(f"sequence(greatest(0, rank - {window}) div {tile}, (rank + {window}) div {tile})")).alias("tile"), F.lit(True).alias("query"), "curve", "rank", "id", "v")
    met = rows.unionByName(sent).repartition(max(parts, 8), "tile").sortWithinPartitions("tile", "query", "id")
    return _ranked(met.mapInArrow(_past_tiles(size, dtype, k, window), _FOUND), k)


#: DuckDB's form: every query against all rows.  Equal to the search where the window holds the whole curve.
ORACLE = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
