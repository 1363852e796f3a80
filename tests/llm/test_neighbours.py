"""Curve search against brute force."""

import numpy as np

from freshet.llm.neighbours import hilbert_keys, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, curve string"


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max((len(v) for _, v in good), default=0)
    good = [(i, np.append(v, np.zeros(size - len(v)))) for i, v in good]
    want = {}
    for q, v in good:
        if q % every == 0:
            best = {}
            for i, w in good:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.cumsum(v * w)[-1]))
            for i, s in best.items():
                want.setdefault(q, {})[i] = max(want.get(q, {}).get(i, -np.inf), s)
    return {q: sorted(((-s, i) for i, s in x.items()))[:k] for q, x in want.items()}


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    for q in out:
        assert sorted(out[q]) == list(range(1, len(out[q]) + 1))
    return {q: [x[k] for k in sorted(x)] for q, x in out.items()}


def test_keys_run_along_a_curve():
    for k, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.indices([1 << bits] * k).reshape(k, -1).T
        keys = [bytes(x) for x in hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(keys)
        path = grid[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(i, one) for i in range(300, 400)] + [(40, one), (41, one), (41, one), (60, rng.normal(size=8).tolist())]
    rows += [(500, None), (520, []), (540, [0.0] * 8), (560, [1.0, None] * 4), (580, [float("nan")] * 8), (None, one), (600, [1.0, 2.0]), (620, [float("inf")] * 8), (640, [1e30] * 8)]
    assert found(nearest_neighbours(table(spark, rows))) == brute(rows)


def test_fewer_candidates_than_asked_and_empty(spark):
    rows = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [-1.0, 0.0])]
    assert found(nearest_neighbours(table(spark, rows))) == brute(rows)
    assert nearest_neighbours(table(spark, [])).count() == 0
    assert nearest_neighbours(table(spark, [(20, [0.0])])).count() == 0
    assert nearest_neighbours(table(spark, [(21, [1.0])])).count() == 0
    assert nearest_neighbours(table(spark, [(20, [1.0])])).count() == 0


def test_recall_with_windows_smaller_than_the_curve(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=24)).tolist()) for i in range(4000)]
    got = found(nearest_neighbours(table(spark, rows), sample_rows=40, least_window=16, tile=256))
    want = brute(rows)
    assert set(got) == set(want)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)
