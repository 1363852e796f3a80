"""Conversation repair against an enumeration of all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from freshet.llm.conversations import END, FAR, Segment, Walk, damaged, repair, repair_conversations

NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
WHITE = " \t\n\x0b\x0c\r"
GOOD = re.compile("(s?(ua)+)?")


def rows_after_damage(rows):
    out, ids = [], {c for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(c, turn, role, text)] * (2 if code == 3 else 1)
    out.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    return {i: [r[1:] for r in out if r[0] == i] for i in ids}


def brute(rows):
    """The least (cost, audit) over all edits with two inserts at most in each place."""
    faults, seen, count = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        body = text.strip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            count[fault] += 1

    def fits(said):
        return re.fullmatch("s?(ua)*u?", said) is not None

    @cache
    def best(i, said, inserts):
        """What follows when ``said`` roles stand: the least (cost, audit, lines)."""
        options = [(0, "", ())] if i == len(rows) and GOOD.fullmatch(said) else []
        add = lambda cost, letter, line, rest: options.append((cost + rest[0], letter + rest[1], (() if line is None else (line,)) + rest[2])) if rest else None
        if inserts < 3:
            for role in ("user", "assistant"):
                if fits(said + role[0]):
                    add(2, "I", f"{role}:", best(i, said + role[0], inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(3, "D", None, best(i + 1, said, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 1 if faults[i] else 0
                if role and fits(said + role[0]):
                    add(more, "K", f"{role}:{text}", best(i + 1, said + role[0], 0))
                for to in ("user", "assistant"):
                    if fits(said + to[0]):
                        add(2 + more, "R", f"{to}:{text}", best(i + 1, said + to[0], 0))
        return min(options) if options else None

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n):
    rng = random.Random(seed)
    texts = ["Hi.", "Why?", "no end", "", " \t", "Hi.", "Yes!", None, "ü."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    return [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(n)] for _ in range(rng.randrange(0 if c else 1, 7))]


def test_repair_is_brute_force(spark):
    rows = made(3, 150)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, matrix string")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in repair_conversations(df).collect()}
    want = {c: brute(tuple(v)) for c, v in rows_after_damage(rows).items()}
    assert got == want


def test_segments_of_a_conversation_give_what_it_gives_whole():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c?", " "]) + "x" * rng.randrange(2), t, rng.random() < 0.8, rng.choice([1, 1, 1, 3])) for t in range(rng.randrange(1, 14))]
        whole = Walk()
        whole.feed(Segment(*map(list, zip(*rows))), END)
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(3))})
        parts = [Segment(*map(list, zip(*rows[a:b]))) for a, b in zip(cuts, cuts[1:])]
        ends, each = END, []
        for seg in reversed(parts):
            each.append(ends)
            m = seg.matrix()
            ends = tuple(min(FAR, *(m[4 * s + t] + ends[t] for t in range(4))) for s in range(4))
        walk = Walk()
        for seg, e in zip(parts, reversed(each)):
            walk.feed(seg, e)
        assert walk.result(1) == whole.result(1)


def test_one_long_conversation_over_many_partitions(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two", "Three?"]) + str(t // 3)) for t in range(9000)] + [(8, 1, "user", "Hi.")] * 500 + [(c, 1, "user", "Hi.") for c in range(20, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair(damaged(df), 6).collect()}
    whole = Walk()
    seen, lists = set(), []
    for turn, role, text in rows_after_damage([r for r in rows if r[0] == 7])[7]:
        lists.append((role, text, turn, (role, text) not in seen, 1))
        seen.add((role, text))
    whole.feed(Segment(*map(list, zip(*lists))), END)
    want = whole.result(7)
    assert {k: got[7][k] for k in want} == want
    assert got[8].duplicate == len(rows_after_damage([r for r in rows if r[0] == 8])[8]) - 1
    assert len(got) == 42


def test_empty_table_and_lost_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair_conversations(spark.createDataFrame([], schema)).count() == 0
    turn = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = repair_conversations(spark.createDataFrame([(5, turn, "user", "Hi.")], schema)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("text", ["x" * 5_000_000 + ".", "\n" * 100_000 + "a!"])
def test_very_long_texts(spark, text):
    (row,) = repair_conversations(spark.createDataFrame([(1, 2, "user", text)], "conv_id long, turn long, role string, text string")).collect()
    assert row.audit == "KI"
    assert row.repaired_sha256 == hashlib.sha256(f"user:{text}\nassistant:".encode()).hexdigest()
