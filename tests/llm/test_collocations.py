"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from freshet.llm import collocations as C


def brute(rows, least, longest, top, cover=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        if any(lang == l and len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l, q), b in cands.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    want = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        want += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(want)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "é", "ü-x", "a", "'b", "c", " z"] + [f"w{i}" for i in range(30)]
    marks = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "!?", ";", ":"]
    rows = [("".join(rng.choice(words[: 6 if rng.random() < 0.5 else 40]) + rng.choice(marks) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", "fr"), (" . ,", None), ("of the of the new york " * 40, "en")] * 2


def test_mining_is_brute_force(spark):
    rows = texts(1, 120)
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")
    for least, longest, top in ((10, 3, 2000), (4, 4, 25), (3, 2, 5)):
        got = sorted(tuple(r) for r in C.collocations(df, least=least, longest=longest, top=top).collect())
        assert got == brute(rows, least, longest, top)


def test_empty_and_rare(spark):
    schema = "text string, lang string"
    assert C.collocations(spark.createDataFrame([], schema)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("a b c", "en")], schema)).count() == 0


def test_numbers_past_64_bits(spark):
    big = 3_000_000_000
    found = spark.createDataFrame([([1], 3 * big), ([2], 2 * big), ([1, 2], big)], "phrase array<long>, a long")
    words = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], "number long, lang string, word string")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    real = C.phrases
    C.phrases = lambda *a, **k: (found, words, totals)
    try:
        (row,) = C.collocations(found).collect()
    finally:
        C.phrases = real
    assert row.score == 1000000 * big * big // (6 * big * big)


def test_very_long_text_is_read_whole(spark):
    text = "alpha beta gamma. " * 300_000
    rows = C.collocations(spark.createDataFrame([(text, "en"), ("alpha beta", "en")], "text string, lang string")).collect()
    assert [(r.phrase, r.a) for r in rows] == [("alpha beta gamma", 300_000)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_cut_and_whole_prefixes_count_alike(longest):
    rng = np.random.default_rng(longest)
    code = rng.integers(0, 6, 5000).astype(np.uint32)
    stream = code | (rng.random(5000) < 0.1).astype(np.uint32) << np.uint32(31)
    numbers = np.array([1, 2, 3, 4, 5, 0])
    plain = dict(C.grow(*C.project(stream, numbers, np.zeros(6, bool), longest), 3))
    cut = Counter()
    for part in [C.project(stream, numbers, np.arange(6) % 2 == 0, longest)]:
        for phrase, a in C.grow(*part, 3):
            cut[phrase] += a
    assert plain == cut and len(plain) > 20
