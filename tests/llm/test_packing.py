"""Packing against brute force and the tokenizers library."""

import random
import zlib

import numpy as np

from freshet.llm import packing
from freshet.llm.bpe import VOCABULARY
from freshet.llm.common import tokenizer_path


def fewest(items, capacity):
    """The least number of bins by trying all places."""
    items, best = sorted(items, reverse=True), len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            rest = list(rooms)
            rest.remove(r)
            place(i + 1, [*rest, r - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_search_finds_the_fewest_bins():
    rng, beaten = random.Random(8), 0
    for _ in range(150):
        items = [rng.randint(12, 49) for _ in range(rng.randint(1, 10))]
        counts = {x: items.count(x) for x in items}
        plan, want = packing.bin_completion(counts, 100), fewest(items, 100)
        assert sum(b for _, b in plan) == want >= packing.least_bins(counts, 100)
        assert {x: sum(k * b for p, b in plan for y, k in p if y == x) for x in counts} == counts
        beaten += sum(b for _, b in packing.best_fit(counts, 100)) > want
    assert beaten  # best fit alone isn't enough


def subsets(counts):
    found = [()]
    for x, n in counts.items():
        found = [(*f, *([(x, k)] if k else [])) for f in found for k in range(n + 1)]
    return found


def test_fillings_are_all_undominated_ones():
    rng = random.Random(2)
    for _ in range(40):
        room = rng.randint(5, 30)
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(5)}
        size = lambda f: sum(x * k for x, k in f)

        def worse(f):
            """A piece that is left out fits in place of a part of it, the part being no longer than the piece."""
            used = dict(f)
            free = [x for x, n in counts.items() if n > used.get(x, 0)]
            return any(size(t) <= x <= size(t) + room - size(f) and t != ((x, 1),) for t in subsets(used) for x in free)  # noqa: B023

        want = {tuple(sorted(f)) for f in subsets(counts) if size(f) <= room and not worse(f)}
        got = [f for f in packing.fillings(room, counts, room) if f is not None]
        assert {tuple(sorted(f)) for f, _ in got} == want and len(got) == len(want)
        assert [w for _, w in got] == sorted(w for _, w in got)


def test_pieces_are_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    random.seed(4)
    texts = [None, "", "Hello, world", " ".join(f"w{random.randrange(500)}" for _ in range(3000)), "x" * 9000, "<|endoftext|> é", "Hello, world"]
    ids_of = [3, 4, 5, 6, None, 8, 5]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in zip(ids_of, texts)], "doc_id long, text string, length int, part int")
    got = packing.pack_documents(df).toPandas()
    want = []
    for i, x in zip(ids_of, texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    have = [(None if i != i else int(i), *map(int, r)) for i, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == (g.length.cumsum() - g.length).to_numpy()).all() and g.length.sum() <= 2048
