"""Operator 8: toxicity by a linear classifier of character n-grams.

Features are the presence of hashed n-grams of characters (code points of the text in lower case)
in the whole text, scaled by their naive Bayes log-count ratios; a logistic regression with an L2
penalty is fitted on top.  n-grams are selected by the likelihood ratio statistic of their presence
against the label, so the selection asks for the same evidence at every number of rows.

Training takes labelled rows of a bounded sample (TRAIN_ROWS rows and TRAIN_BYTES bytes of whole
texts, by a hash of the id) whose crc32 of the id isn't 0 modulo 5; the rest is held out.  Scores
of each fold by a model of the other folds calibrate the scale and the point of decision.  Labels,
language, source and id are never features.

Defined cases: a null text is the empty text, scored by the intercept alone; repeated rows get
equal scores; texts of any length are read whole, block by block; a null id is held out by no rule
(its crc32 is null, so it is false) and never trained on; an id labelled twice has its higher
label; without labelled rows every score is a hair under 0.5 (predicted 0), with one class only
every score is near that class; columns besides the id and the text are left out by
``toxic_scores`` and kept by ``without_toxic``, whatever they are called; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct

#: Lengths of the n-grams in rising order, and the hash space of each.
LENGTHS = (4, 6, 8)
SPACE_BITS = 20
#: Bounds of the training sample.
TRAIN_ROWS, TRAIN_BYTES = 6_000, 16 << 20
#: n-grams in fewer training texts are left out, as are those with a smaller statistic; of the rest the strongest are taken.
LEAST_TEXTS, LEAST_STATISTIC, FEATURES = 3, 8.0, 12_000
SMOOTH, PENALTY = 0.5, 1.0
#: Folds of the calibration, and the share of false alarms up to which the point of decision is lowered.
FOLDS, FALSE_ALARMS = 3, 0.003
#: Characters that are hashed at a time.
BLOCK = 1 << 17


def _blocks(texts):
    """Characters of about BLOCK at a time with the rows and ends of the pieces that they are from."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for a in range(0, len(text), BLOCK):
            part = text[a : a + BLOCK + LENGTHS[-1] - 1]
            rows.append(i), parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def present(texts, feature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs of texts, sorted; the codes of each length have their own range.

    With ``feature`` codes are replaced by its numbers, and those with -1 left out at once.
    """
    found = []
    for rows, parts in _blocks(texts):
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(x) for x in parts])
        row, end = np.repeat(np.array(rows), sizes), np.repeat(np.cumsum(sizes), sizes)
        h = np.zeros(len(flat), np.uint64)
        done = 0
        with np.errstate(over="ignore"):
            for j, length in enumerate(LENGTHS):
                if len(flat) < length:
                    break
                for at in range(done, length):
                    h = (h[: len(flat) - at] ^ flat[at:]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                done = length
                code = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SPACE_BITS)).astype(np.int64) + (j << SPACE_BITS)
                at = np.arange(len(code))
                if feature is not None:
                    code = feature[code].astype(np.int64)
                    at = np.flatnonzero(code >= 0)
                    code = code[at]
                inside = at + length <= end[at]
                found.append(distinct(row[at[inside]] << 32 | code[inside]))
    code = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return code >> 32, code & 0xFFFFFFFF


class Model:
    """feature: code to number (-1: none); weight: of each number; bias."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, bias: float):
        self.feature, self.weight, self.bias = feature, weight, bias

    def logits(self, texts) -> np.ndarray:
        row, number = present(texts, self.feature)
        return self.bias + np.bincount(row, self.weight[number], minlength=len(texts))

    def score(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -60, 60)))


def _no_features() -> np.ndarray:
    return np.full(len(LENGTHS) << SPACE_BITS, -1, np.int32)


def fit(texts, labels) -> Model:
    """A model of all texts, with the scale and the point of decision that models of the folds' complements show."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(_no_features(), np.zeros(1), -1e-6 if not len(y) else (6.0 if y.min() else -6.0))
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):  # both classes are dealt out evenly
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % FOLDS
    model = _fit(texts, y)
    if min((y == 0).sum(), (y == 1).sum()) < 2 * FOLDS:
        return model
    z = np.empty(len(y))
    for k in range(FOLDS):
        part = _fit([t for t, f in zip(texts, fold) if f != k], y[fold != k])
        for i in np.array_split(np.flatnonzero(fold == k), max(1, len(y) // 1000)):
            z[i] = part.logits([texts[j] for j in i])
    scale, shift = _calibrated(z.clip(-30, 30), y)
    high = np.sort(z[y == 0])[::-1][int(FALSE_ALARMS * (y == 0).sum())]
    point = max(min(-shift / scale, float(high) + 1e-6), -15.0)
    return Model(model.feature, model.weight * scale, (model.bias - point) * scale)


def _calibrated(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic scaling, by damped Newton steps; a small penalty keeps it finite."""
    scale, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -40, 40)))
        s, d = np.maximum(p * (1 - p), 1e-6), p - target
        h = np.array([[(s * z * z).sum() + 0.5, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        move = np.linalg.solve(h, np.array([(d * z).sum() + 0.5 * (scale - 1), d.sum() + 0.1 * shift]))
        scale, shift = max(0.05, scale - 0.3 * move[0]), shift - 0.3 * move[1]
        if np.abs(move).max() < 1e-7:
            break
    return scale, shift


def _statistic(ones: np.ndarray, both: np.ndarray, positive: int, rows: int) -> np.ndarray:
    """Likelihood ratio statistic of each n-gram's presence against the label."""
    out = np.zeros(len(ones))
    for seen, n in ((ones, positive), (both - ones, rows - positive)):
        expected = both * (n / rows)
        at = np.flatnonzero(seen > 0)
        out[at] += 2 * seen[at] * np.log(seen[at] / expected[at])
    return out


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes))).astype(np.int32)


def _fit(texts, y: np.ndarray) -> Model:
    """Selection, log-count ratios and logistic regression (full-batch Newton by conjugate gradients)."""
    feature = _no_features()
    size, n, positive = len(feature), len(y), int(y.sum())
    parts = [(i, texts[i : i + 50]) for i in range(0, n, 50)]
    ones, both = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for i, part in parts:  # counted piece by piece: all pairs at once would be large
        row, code = present(part)
        for table, own in ((both, code), (ones, code[y[row + i] == 1])):
            own, times = _counted(own)
            table[own] += times
    chosen = np.flatnonzero(both >= LEAST_TEXTS)
    statistic = _statistic(ones[chosen], both[chosen], positive, n)
    chosen, statistic = chosen[statistic >= LEAST_STATISTIC], statistic[statistic >= LEAST_STATISTIC]
    chosen = np.sort(chosen[np.argsort(-statistic, kind="stable")[:FEATURES]])
    prior = float(np.log(positive / (n - positive)))
    if not len(chosen):
        return Model(feature, np.zeros(1), prior)
    feature[chosen] = np.arange(len(chosen))
    r = np.log((ones[chosen] + SMOOTH) / (positive + 2 * SMOOTH)) - np.log((both[chosen] - ones[chosen] + SMOOTH) / (n - positive + 2 * SMOOTH))
    hits = [(i, *present(part, feature)) for i, part in parts]
    row = np.concatenate([(x + i).astype(np.int32) for i, x, _ in hits])
    number = np.concatenate([x.astype(np.int32) for _, _, x in hits])
    value, k = r[number].astype(np.float32), len(chosen)
    del hits, ones, both
    w, bias = np.zeros(k), prior
    dot = lambda v: np.bincount(row, value * v[number], minlength=n)
    back = lambda v: np.bincount(number, value * v[row], minlength=k)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(dot(w) + bias, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-6)
        gw, gb = back(p - y) + PENALTY * w, float((p - y).sum())
        # Conjugate gradients on the Newton system of (w, bias).
        x, xb = np.zeros(k), 0.0
        rw, rb = -gw, -gb
        dw, db = rw.copy(), rb
        rr = float(rw @ rw + rb * rb)
        for _ in range(40):
            t = s * (dot(dw) + db)
            hw, hb = back(t) + PENALTY * dw, float(t.sum()) + 1e-6 * db
            step = rr / max(float(dw @ hw + db * hb), 1e-300)
            x, xb = x + step * dw, xb + step * db
            rw, rb = rw - step * hw, rb - step * hb
            new = float(rw @ rw + rb * rb)
            if new < 1e-10:
                break
            dw, db, rr = rw + new / rr * dw, rb + new / rr * db, new
        w, bias = w + x, bias + xb
        if max(np.abs(x).max(), abs(xb)) < 1e-5:
            break
    return Model(feature, w * r, bias)


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``train_rows`` labelled rows and ``train_bytes`` bytes of texts that aren't held out, in the order of a hash of the id."""
    pick = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~_held_out("id"))
    pick = pick.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The picked rows are bounded by train_rows, which is what makes broadcasting them safe.
    rows = texts.join(F.broadcast(pick), "id").select("id", F.xxhash64("id").alias("place"), F.xxhash64("text").alias("said"), "text", "y")
    # Ids may be repeated, so rows and bytes are bounded once more: by sizes alone, then the texts within the bounds are fetched.
    order = ["place", "id", "said", "size"]
    first = rows.select("id", "place", "said", F.octet_length("text").cast("long").alias("size")).orderBy(*order).limit(train_rows)
    held = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    within = first.withColumn("held", held).filter(F.col("held") <= train_bytes).groupBy("id", "said").agg(F.count(F.lit(1)).alias("times"))
    # Equal rows stand for each other: as many are learnt from as lay within the bounds.
    got = rows.join(F.broadcast(within), ["id", "said"]).groupBy("place", "id", "said", "text", "y").agg(F.first("times").alias("times")).select("place", "id", "said", F.explode(F.array_repeat(F.struct("text", "y"), F.col("times").cast("int"))).alias("r")).select("place", "id", "said", "r.*").toArrow()
    # Folds are dealt by place, so the order is that of the hash, whatever order the rows came in.
    got = got.sort_by([("place", "ascending"), ("id", "ascending"), ("said", "ascending")])
    return fit(got.column("text").to_pylist(), got.column("y").to_numpy())


def _score(model, wide: bool):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score = np.concatenate([model.value.score(batch.column("text").slice(i, 200).to_pylist()) for i in range(0, n, 200)]) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns) if wide or batch.schema.names[i] != "text"], pa.array(score, pa.float64())], [*[x for x in batch.schema.names if wide or x != "text"], "score"])

    return run


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: the id, held_out, score (0 to 1) and predicted (score >= 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, train_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model, False), "id long, score double")
    return scored.select(F.col("id").alias(id_col), _held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **options))
    inner = [f"_keep{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, inner)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = ", ".join([*[f"{a} {docs.schema[c].dataType.simpleString()}" for c, a in zip(docs.columns, inner)], "text string", "score double"])
    return rows.mapInArrow(_score(model, True), schema).filter("score < 0.5").select(*[F.col(a).alias(c) for c, a in zip(docs.columns, inner)])
