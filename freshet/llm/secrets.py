"""Operator 4: secret scans of whole texts, by patterns and a character network.

Base patterns (leftmost, not overlapping, per kind): ``assign``, ``access`` and ``hex``.  Every run
of at least CANDIDATE token characters with a letter and a digit is a candidate, and so is every
base finding's value outside these, however short; the network of ``secret_cnn`` judges each with
its surrounding context, in overlapping windows along the whole of it.  Where the highest window is
over its calibrated, recall-constrained threshold, base spans that overlap it are confirmed, and
what no base span covers becomes spans of kind ``cnn``.

Bytes of a whole batch are searched at once for what any finding needs (a run of token
characters, a run of hexadecimal digits, ``AKIA``, a colon or equals sign and a keyword); only
texts that have it are looked at one by one.

Defined cases: a null text is the empty text; texts without findings have zero counts, an empty
list of spans and the digest of the empty string; positions are code points; texts and candidates
of any length are read whole; repeated rows, and rows with equal or null ids, get equal results
for equal texts; columns besides the id and the text are left out by ``find_secrets`` and kept by
``mask_secrets``, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffer
from .secret_cnn import AFTER, BEFORE, TAIL, Network, encode, trained, windows

KINDS = ("assign", "access", "hex", "cnn")
#: Shortest value of an assignment, access key, hexadecimal string and candidate.
VALUE, ACCESS, HEX, CANDIDATE = 6, 20, 24, 16
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CORE = re.compile(rb"[A-Za-z0-9](?:.*[A-Za-z0-9])?", re.DOTALL)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = True
    return t


_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TOKEN, _HEXA, _SIGN = _table(_DIGITS + _LETTERS + "+/_=.-"), _table(_DIGITS + "abcdef"), _table(":=")
_IS_DIGIT, _IS_LETTER = _table(_DIGITS), _table(_LETTERS)


def _runs(flags: np.ndarray, breaks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of set flags of some length, cut at the rows' starts."""
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    edge = np.unique(np.concatenate([[0], edge, breaks, [len(flags)]])) if len(flags) else np.zeros(1, np.int64)
    a, b = edge[:-1], edge[1:]
    ok = (b - a >= least) & flags[a] if len(a) else np.zeros(0, bool)
    return a[ok], b[ok]


def _uncovered(start: int, end: int, spans) -> list[tuple[int, int]]:
    """Parts of a range that no span covers."""
    out = []
    for a, b, _ in sorted(spans):
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def scan(column, net: Network, judged: dict[int, list[int]] | None = None) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind's number) of each row of a column of texts, sorted.

    ``judged`` gets for rows with candidates how many the network saw, and how many base spans
    overlap a candidate over its threshold.
    """
    data, offsets = text_buffer(column)
    raw = data.tobytes()
    n = len(offsets) - 1
    row_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    breaks = offsets[(offsets > 0) & (offsets < len(data))]
    points: dict[int, np.ndarray] = {}
    values: list[tuple[int, int]] = []  # bytes of the base findings' values

    def chars(row: int, at: int) -> int:
        """Code points of the row before a byte position of it."""
        if row not in points:
            body = data[offsets[row] : offsets[row + 1]]
            points[row] = np.append(0, np.cumsum((body & 0xC0) != 0x80))
        return int(points[row][at])

    def add(row: int, kind: int, span: tuple[int, int], value: tuple[int, int]) -> None:
        """A base finding, in code points."""
        found.setdefault(row, []).append((*span, kind))
        chars(row, 0)
        values.append(tuple(int(offsets[row] + np.searchsorted(points[row], k, "left")) for k in value))

    signs = set(np.unique(row_of(np.flatnonzero(_SIGN[data]))).tolist())
    words = set()
    for m in _KEYWORD.finditer(raw) if signs else ():
        words.add(int(row_of(m.start())))
    for r in signs & words:
        text = raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace")
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= VALUE:
                add(r, 0, m.span(), m.span(2))
    at = raw.find(b"AKIA")
    while at >= 0:
        r = int(row_of(at))
        text = raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace")
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS:
                add(r, 1, m.span(), m.span())
        at = raw.find(b"AKIA", int(offsets[r + 1]))
    for a, b in zip(*_runs(_HEXA[data], breaks, HEX)):
        r = int(row_of(a))
        span = chars(r, a - offsets[r]), chars(r, b - offsets[r])
        add(r, 2, span, span)
    starts, ends = _runs(_TOKEN[data], breaks, CANDIDATE)
    if len(starts):
        digits, letters = np.append(0, np.cumsum(_IS_DIGIT[data])), np.append(0, np.cumsum(_IS_LETTER[data]))
        ok = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
        starts, ends = starts[ok], ends[ok]
    if values:  # those that lie in no run
        a, b = np.array(sorted(set(values)), np.int64).T
        inside = np.searchsorted(starts, a, "right") - 1
        apart = (inside < 0) | (ends[inside] < b) if len(starts) else np.ones(len(a), bool)
        order = np.argsort(np.concatenate([starts, a[apart]]), kind="stable")
        starts, ends = np.concatenate([starts, a[apart]])[order], np.concatenate([ends, b[apart]])[order]
    if len(starts):
        owners = row_of(starts)
        owner, places = windows(ends - starts)
        places += starts[owner]
        highest = np.zeros(len(starts))
        for i in range(0, len(owner), 2048):
            part = zip(owners[owner[i : i + 2048]].tolist(), places[i : i + 2048].tolist(), ends[owner[i : i + 2048]].tolist())
            x = np.array([encode(raw[max(int(offsets[r]), a - BEFORE) : a], raw[a : min(int(offsets[r + 1]), a + AFTER, b + TAIL)]) for r, a, b in part])
            np.maximum.at(highest, owner[i : i + 2048], net.probability(x))
        over = np.flatnonzero(highest >= net.threshold)
        confirmed: dict[int, set] = {}
        for r, a, b in zip(owners[over].tolist(), starts[over].tolist(), ends[over].tolist()):
            s, e = chars(r, a - int(offsets[r])), chars(r, b - int(offsets[r]))
            base = {x for x in found.get(r, ()) if x[2] < 3 and s < x[1] and x[0] < e}
            if base:
                confirmed.setdefault(r, set()).update(base)
            text = raw[a:b]
            for x, y in _uncovered(s, e, base):
                # A candidate is ASCII, so its code points are its bytes.  Punctuation around base spans is no finding.
                part = text[x - s : y - s]
                if not base:
                    found.setdefault(r, []).append((x, y, 3))
                elif core := _CORE.search(part):
                    found.setdefault(r, []).append((x + core.start(), x + core.end(), 3))
        if judged is not None:
            for r, k in zip(*np.unique(owners, return_counts=True)):
                judged[int(r)] = [int(k), len(confirmed.get(int(r), ()))]
    return [sorted(found[r], key=lambda x: (x[0], x[2])) if r in found else [] for r in range(n)]


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_NONE = hashlib.sha256(b"").hexdigest()


def _report(net):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                judged: dict[int, list[int]] = {}
                spans = scan(part.column("text"), net.value, judged)
                seen = lambda k: pa.array([judged[r][k] if r in judged else 0 for r in range(len(spans))], pa.int64())  # noqa: B023, E731
                count = lambda kind: pa.array([sum(k == kind for _, _, k in x) for x in spans], pa.int64())  # noqa: B023, E731
                base = [hashlib.sha256(_listed([y for y in x if y[2] < 3]).encode()).hexdigest() if x else _NONE for x in spans]
                yield pa.RecordBatch.from_arrays([part.column("id"), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array([_listed(x) for x in spans], pa.string()), seen(0), seen(1)], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_judged", "n_confirmed"])

    return run


@cache
def _network() -> Network:
    """Trained once a process."""
    return trained()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """One row per input row: the id, n_assign, n_access, n_hex, base_sha256, spans, and the numbers of candidates judged and of base spans that the network confirms."""
    net = docs.sparkSession.sparkContext.broadcast(net or _network())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_report(net), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_judged long, n_confirmed long").withColumnRenamed("id", id_col)


def masked(text: str, spans) -> str:
    """The text with every span (united where they overlap) replaced by MASK."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(net):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column("text")
                new = [t if not s else masked(t, s) for t, s in zip(texts.to_pylist(), scan(texts, net.value))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(new, pa.string())], part.schema.names)

    return run


def mask_secrets(docs: DataFrame, text_col: str = "text", net: Network | None = None) -> DataFrame:
    """The rows of ``docs`` with all found secrets masked in the text column; other columns as they are."""
    net = docs.sparkSession.sparkContext.broadcast(net or _network())
    others = [c for c in docs.columns if c != text_col]
    inner = [f"_keep{i}" for i in range(len(others))]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(others, inner)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = ", ".join([*[f"{a} {docs.schema[c].dataType.simpleString()}" for c, a in zip(others, inner)], "text string"])
    out = rows.mapInArrow(_mask(net), schema)
    names = dict(zip(others, inner)) | {text_col: "text"}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])
