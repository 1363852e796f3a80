"""N-gram join where tokens are in many texts, against all pairs."""

import random
import re

import pytest

from freshet.llm import ngram_join
from freshet.llm.ngram_join import similar_groups


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for size, copies in ((60, 60), (200, 45), (16, 40), (30, 30)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                own[rng.randrange(size)] = word()
            texts.append(own)
        # Half of this text and half of something else: shared tokens, no links.
        texts += [base[: size // 2] + [word() for _ in range(size // 2)] for _ in range(20)]
    # A hub near to many that aren't near to each other: each lacks another tenth of it.
    hub = [word() for _ in range(300)]
    texts += [hub] + [hub[:k] + [word() for _ in range(28)] + hub[k + 28 :] for k in range(0, 270, 9)]
    # A passage that all others hold, too.
    line = [word() for _ in range(12)]
    texts += [line + [word() for _ in range(40)] for _ in range(60)]
    rng.shuffle(texts)
    return [(3 * i + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tokens_in_many_texts(spark, seed):
    rows = made(seed)
    counts: dict = {}
    for _, t in rows:
        for s in shingles(t):
            counts[s] = counts.get(s, 0) + 1
    assert sum(n > 2 * ngram_join.RARE_TEXTS for n in counts.values()) > 200
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, shard int")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(df).collect()) == brute(rows)
