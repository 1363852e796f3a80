"""The pipeline from start to end, against its stages done one text at a time."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from freshet.llm import bpe, packing, secrets, toxicity
from freshet.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


def prose(rng, n):
    return " ".join(f"word{rng.randrange(900)}" for _ in range(n))


def made():
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80) + (" " + passage + " " if i % 5 == 0 else " ") + prose(rng, 30) + (" you utter nincompoop" if i % 4 == 1 else "")) for i in range(60)]
    rows += [(100 + i, rows[2 * i][1] + (" end" if i % 2 else "")) for i in range(6)]  # near and exact copies
    rows += [(200, None), (201, ""), (202, " \n"), (203, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and ' + prose(rng, 20)), (204, prose(rng, 3000)), (None, prose(rng, 50)), (2, rows[2][1])]
    labels = [(i, int(i % 4 == 1)) for i in range(60)]
    return rows, labels


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def by_hand(rows, model):
    last = lambda i: (i is None, i or 0)
    rows = [r for r in rows if model.score([r[1]])[0] < 0.5]
    rows.sort(key=lambda r: last(r[0]))
    sets, kept, root = [shingles(t) for _, t in rows], [], {}
    for k, s in enumerate(sets):  # links chain through all rows, so groups are closed first
        root[k] = k
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [rows[k] for k in range(len(rows)) if not sets[k] or find(k) == k]
    seen, cut = {}, []
    bodies = [(i, (t or "").encode()) for i, t in kept]
    for i, body in bodies:
        for k in range(len(body) - 49):
            w = body[k : k + 50]
            seen[w] = min(seen.get(w, (True, 1 << 62)), last(i))
    for i, body in bodies:
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - 49):
            if seen[body[k : k + 50]] < last(i):
                gone[k : k + 50] = True
        cut.append((i, bytes(b for b, g in zip(body, gone) if not g).decode()))
    net = secrets._network()
    import pyarrow as pa

    return [(i, secrets.masked(t, s) if s else t) for (i, t), s in zip(cut, secrets.scan(pa.array([t for _, t in cut], pa.string()), net))]


def test_all_stages_are_those_done_by_hand(spark, tmp_path):
    rows, labels = made()
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x") for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    want = by_hand(rows, toxicity.train(docs, lab))
    library = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    library.no_truncation(), library.no_padding()
    pieces = []
    for i, t in want:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[a : a + packing.CAPACITY]
            pieces.append((-1 if i is None else i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = sorted((-1 if i != i or i is None else int(i), *map(int, r)) for i, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert found == sorted(pieces)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= packing.CAPACITY and (g.offset.to_numpy() == (g.length.cumsum() - g.length).to_numpy()).all()
    assert len(want) < len(rows) - 5


def test_every_stage_but_the_last_keeps_the_columns(spark, tmp_path):
    rows, labels = made()
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x") for i, t in [*rows[:8], *rows[-7:]]], SCHEMA)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_a_stage_of_nothing(spark, tmp_path, stage):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
