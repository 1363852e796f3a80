"""Operator 1: removal of repeated byte strings by depth-limited radix ordering of suffixes.

Suffixes are ordered only through ``depth`` bytes, most significant digit first, and equal
groups at that depth are exactly the repeated windows.  The first digit is the smallest hash
of the ``GRAM``-byte strings inside a window: equal windows have equal digits, so the digit
routes them to one task, and consecutive windows mostly share it, so a whole run of windows
travels as one context of bytes.

1. Every shard of documents sends the distinct first digits of its windows, and the digests of
   its texts; digits that occur in one document only end there, and a copy of a smaller
   document's whole text is known to be removed.
2. For the digits that are left, every shard sends the distinct contexts of its runs with the
   smallest document id that has each; further documents of the shard with the same context
   are settled on the spot.
3. Per digit the distinct contexts meet.  Windows of different contexts are ordered by 8-byte
   digits down to ``depth``; groups of one are dropped after each pass.
4. Removed intervals return to the shard of their document, where they are united.

Defined cases: null text is the empty text; texts shorter than ``depth`` bytes lose nothing;
rows with the same id never remove each other's bytes; a null id counts as larger than any
other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack, pass_through, shard_count, text_buffer, unpack, words_at

GRAM = 16
#: Windows of one run that travel together at most.
RUN_WINDOWS = 64
#: Bytes that are hashed at a time.
BLOCK = 1 << 19
NO_ID = np.iinfo(np.int64).max

_DIGITS = "bucket int, shard int, digits binary, texts binary, ids binary"
_WANTED = "shard int, digits binary, copies binary"
_CONTEXTS = "bucket int, shard int, ids binary, sizes binary, bytes binary, occ_context binary, occ_doc binary, occ_start binary, done_doc binary, done_start binary, done_end binary"
_INTERVALS = "shard int, docs binary, starts binary, ends binary"
TEXT = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def first_digits(data: np.ndarray, depth: int) -> np.ndarray:
    """For every window of ``depth`` bytes the smallest hash of the strings of GRAM bytes in it."""
    gram = min(GRAM, depth)
    if len(data) < depth:
        return np.zeros(0, np.uint64)
    w8, n = words_at(data), len(data) - gram + 1
    h = np.full(n, gram, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, gram, 8):
            size = min(8, gram - at)
            part = w8[at : at + n]
            if size < 8:
                part = part & np.uint64((1 << 8 * size) - 1)
            h = _mix((h ^ part) * np.uint64(0x9E3779B97F4A7C15 + 2 * at))
    width = depth - gram + 1
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    return h


def runs_of(data: np.ndarray, offsets: np.ndarray, depth: int):
    """Runs of windows with the same first digit, in documents laid end to end.

    Yields (document, start in the whole buffer, windows, digit) as arrays, block by block.
    """
    n_docs = len(offsets) - 1
    d = 0
    while d < n_docs:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + BLOCK, "right")) - 1)
        e = min(e, n_docs)
        lo, hi = int(offsets[d]), int(offsets[e])
        if e == d + 1 and hi - lo > 2 * BLOCK:  # one long text: in overlapping pieces
            pieces = [(a, min(a + BLOCK + depth - 1, hi)) for a in range(lo, max(hi - depth + 1, lo + 1), BLOCK)]
        else:
            pieces = [(lo, hi)]
        for a, b in pieces:
            digits = first_digits(data[a:b], depth)
            if not len(digits):
                continue
            open_ = np.zeros(b - a + 1, np.int32)
            starts, ends = np.clip(offsets[d:e] - a, 0, b - a), np.clip(offsets[d + 1 : e + 1] - a, 0, b - a)
            np.add.at(open_, np.maximum(starts, ends - depth + 1), 1)
            np.add.at(open_, ends, -1)
            valid = np.cumsum(open_)[: len(digits)] == 0
            new = np.ones(len(digits), bool)
            new[1:] = (digits[1:] != digits[:-1]) | (valid[1:] != valid[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(digits)))
            ok = valid[at]
            at, size = at[ok], size[ok]
            if len(size) and size.max() > RUN_WINDOWS:
                times = -(-size // RUN_WINDOWS)
                which = np.repeat(np.arange(len(at)), times)
                step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                at, size = at[which] + step * RUN_WINDOWS, np.minimum(size[which] - step * RUN_WINDOWS, RUN_WINDOWS)
            if len(at):
                yield np.searchsorted(offsets, at + a, "right") - 1, at + a, size, digits[at]
        d = e


def _bucket(digits: np.ndarray, buckets: int) -> np.ndarray:
    """Smallest hashes crowd near zero, so they are hashed once more."""
    with np.errstate(over="ignore"):
        h = (digits >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(digits: np.ndarray, buckets: int):
    """(bucket, places of its digits in rising order) of each bucket in use."""
    bucket = _bucket(digits, buckets)
    order = np.lexsort((digits, bucket))
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
        yield int(bucket[order[lo]]), order[lo:hi]


def _ordered(table: pa.Table):
    """The shard's documents by id, then by key: ids, rows' order and texts in that order.

    A document's place in this order names it between the steps.
    """
    ids = np.array([NO_ID if x is None else x for x in table.column("id").to_pylist()], np.int64)
    order = np.lexsort((table.column("key").to_numpy(), ids))
    return ids[order], order, table.column("text").combine_chunks().take(pa.array(order))


def _text_digests(texts) -> list[bytes]:
    data, offsets = text_buffer(texts)
    raw = memoryview(data.tobytes())
    return [hashlib.blake2b(raw[a:b], digest_size=TEXT).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _text_bucket(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[:4], "little") * buckets >> 32


def _digits_of_shard(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, _, texts = _ordered(table)
        data, offsets = text_buffer(texts)
        found = [(g, ids[d]) for d, _, _, g in runs_of(data, offsets, depth)]
        rows = {"bucket": [], "digits": [], "texts": [], "ids": []}
        add = lambda *x: [rows[k].append(v) for k, v in zip(rows, x)]
        if found:
            g, owner = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            order = np.argsort(g, kind="stable")
            g, owner = g[order], owner[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            many = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)).astype(np.uint64)
            g = g[first]
            sent = (g & ~np.uint64(1)) | many
            for b, own in _by_bucket(g, buckets):
                add(b, pack(sent[own], np.uint64), b"", b"")
        least: dict[bytes, int] = {}
        for i, x in zip(ids.tolist(), _text_digests(texts)):
            least.setdefault(x, i)
        by_bucket: dict[int, list[bytes]] = {}
        for x in least:
            by_bucket.setdefault(_text_bucket(x, buckets), []).append(x)
        for b, own in by_bucket.items():
            add(b, b"", b"".join(own), pack([least[x] for x in own], np.int64))
        n = len(rows["bucket"])
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "shard": pa.array([shard] * n, pa.int32())} | {k: pa.array(rows[k], pa.binary()) for k in ("digits", "texts", "ids")})

    return run


def _repeated_digits(table: pa.Table) -> pa.Table:
    """For each shard: its digits that two documents at least have, and its texts that a smaller id of another shard has.

    A document id lies in one shard only, so two shards are two documents.
    """
    r = table.to_pydict()
    g = unpack(r["digits"], np.uint64)
    shard = np.repeat(np.array(r["shard"]), [len(x) // 8 for x in r["digits"]])
    order = np.argsort(g, kind="stable")
    g, shard = g[order], shard[order]
    value = g >> np.uint64(1)
    first = np.append(True, value[1:] != value[:-1]) if len(value) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    many = np.maximum.reduceat((g & np.uint64(1)).astype(np.int8), np.flatnonzero(first)) if len(g) else np.zeros(0, np.int8)
    keep = ((np.bincount(group) > 1) | (many > 0))[group]
    value, shard = value[keep], shard[keep]
    order = np.argsort(shard, kind="stable")
    value, shard = value[order], shard[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    rows = [(int(shard[a]), pack(value[a:b], np.uint64), b"") for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(shard)).tolist())]
    least: dict[bytes, int] = {}
    sent: list[tuple[int, bytes, int]] = []
    for s, texts, ids in zip(r["shard"], r["texts"], r["ids"]):
        for k, i in enumerate(np.frombuffer(ids, np.int64).tolist() if ids else ()):
            x = texts[TEXT * k : TEXT * k + TEXT]
            least[x] = min(least.get(x, NO_ID), i)
            sent.append((s, x, i))
    copies: dict[int, list[bytes]] = {}
    for s, x, i in sent:
        if least[x] < i:
            copies.setdefault(s, []).append(x)
    rows += [(s, b"", b"".join(x)) for s, x in copies.items()]
    return pa.table({n: pa.array([x[k] for x in rows], pa.binary() if k else pa.int32()) for k, n in enumerate(("shard", "digits", "copies"))})


def _merged(key, start, end):
    """Overlapping or touching intervals of the same key made one."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    # Ends are compared within a key only: a running maximum over (key rank, end).
    rank = np.cumsum(np.append(0, key[1:] != key[:-1])).astype(np.int64)
    shift = rank * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    new = np.append(True, (rank[1:] != rank[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return key[at], start[at], np.maximum.reduceat(reach, at)


def _contexts_of_shard(depth: int, buckets: int):
    names = [x.split()[0] for x in _CONTEXTS.split(", ")]

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = {n: [] for n in names}
        if docs.num_rows and wanted.num_rows:
            shard = docs.column("shard")[0].as_py()
            ids, _, texts = _ordered(docs)
            blob = b"".join(x for x in wanted.column("copies").to_pylist() if x)
            elsewhere = {blob[i : i + TEXT] for i in range(0, len(blob), TEXT)}
            least: dict[bytes, int] = {}
            own, copies = [], []
            sizes = np.diff(text_buffer(texts)[1])
            for d, x in enumerate(_text_digests(texts)):
                if x in elsewhere or least.setdefault(x, int(ids[d])) < ids[d]:
                    if sizes[d] >= depth:
                        copies.append((d, 0, int(sizes[d])))
                else:
                    own.append(d)
            own = np.array(own, np.int64)
            data, offsets = text_buffer(texts.take(pa.array(own)))
            want = np.sort(unpack(wanted.column("digits").to_pylist(), np.uint64))
            raw = data.tobytes()
            seen: dict[bytes, int] = {}
            digit_of, id_of, occ, done = [], [], [], copies
            for doc, start, size, digit in runs_of(data, offsets, depth) if len(want) else ():
                at = np.minimum(np.searchsorted(want, digit >> np.uint64(1)), len(want) - 1)
                hit = np.flatnonzero(want[at] == digit >> np.uint64(1))
                for k, s, n, g in zip(doc[hit].tolist(), start[hit].tolist(), size[hit].tolist(), digit[hit].tolist()):
                    context, d = raw[s : s + n + depth - 1], int(own[k])
                    c = seen.setdefault(context, len(digit_of))
                    if c == len(digit_of):
                        digit_of.append(g), id_of.append(int(ids[d]))
                    if id_of[c] == ids[d]:
                        occ.append((c, d, s - int(offsets[k])))
                    else:
                        done.append((d, s - int(offsets[k]), s - int(offsets[k]) + len(context)))
            digits, id_a = np.array(digit_of, np.uint64), np.array(id_of, np.int64)
            bodies = list(seen)
            length = np.array([len(x) for x in bodies], np.int64)
            occ = np.array(occ, np.int64).reshape(-1, 3)
            done = np.array(done, np.int64).reshape(-1, 3)
            dk, ds, de = _merged(done[:, 0], done[:, 1], done[:, 2])
            occ = occ[np.argsort(occ[:, 0], kind="stable")]
            n_occ = np.bincount(occ[:, 0], minlength=len(digits))
            occ_at = np.cumsum(n_occ) - n_occ
            parts = list(_by_bucket(digits, buckets))
            if len(dk) and not parts:
                parts = [(shard % buckets, np.zeros(0, np.int64))]
            for b, mine in parts:
                at = np.concatenate([np.arange(occ_at[c], occ_at[c] + n_occ[c]) for c in mine]) if len(mine) else np.zeros(0, np.int64)
                last = (pack(dk, np.uint32), pack(ds, np.uint32), pack(de, np.uint32)) if b == parts[0][0] else (b"", b"", b"")
                row = (b, shard, pack(id_a[mine], np.int64), pack(length[mine], np.uint16), b"".join([bodies[c] for c in mine]), pack(np.repeat(np.arange(len(mine)), n_occ[mine]), np.uint32), pack(occ[at, 1], np.uint32), pack(occ[at, 2], np.uint32), *last)
                for n, x in zip(names, row):
                    rows[n].append(x)
        return pa.table({n: pa.array(rows[n], pa.int32() if n in ("bucket", "shard") else pa.binary()) for n in names})

    return run


def equal_windows(data: np.ndarray, pos: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over 8 bytes each, through ``depth`` bytes.

    Returns the windows (indices into pos) that equal another one and their groups' numbers.
    """
    w8 = words_at(data)
    active, label = np.arange(len(pos)), group
    for at in range(0, depth, 8):
        size = min(8, depth - at)
        digit = w8[pos[active] + at]
        if size < 8:
            digit = digit & np.uint64((1 << 8 * size) - 1)
        digit = digit.byteswap()  # the first byte is the most significant
        order = np.lexsort((digit, label))
        digit, label, active = digit[order], label[order], active[order]
        new = np.append(True, (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])) if len(label) else np.zeros(0, bool)
        label = np.cumsum(new) - 1
        keep = np.bincount(label)[label] > 1 if len(label) else new
        active, label = active[keep], label[keep]
        if not len(active):
            break
    return active, label


def _digits_at(body: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """First digits of the windows at some places of a buffer."""
    data, out = np.frombuffer(body, np.uint8), np.empty(len(at), np.uint64)
    order = np.argsort(at, kind="stable")
    i = 0
    while i < len(at):
        lo = int(at[order[i]])
        j = int(np.searchsorted(at[order], lo + BLOCK, "left"))
        out[order[i:j]] = first_digits(data[lo : int(at[order[j - 1]]) + depth], depth)[at[order[i:j]] - lo]
        i = j
    return out


def _settle(depth: int):
    def run(table: pa.Table) -> pa.Table:
        r = table.to_pydict()
        n_ctx = [len(x) // 2 for x in r["sizes"]]
        shards = np.array(r["shard"])
        ids, sizes = unpack(r["ids"], np.int64), unpack(r["sizes"], np.uint16).astype(np.int64)
        body = b"".join(r["bytes"])
        ends = np.cumsum(sizes)
        number: dict[bytes, int] = {}
        which = np.empty(len(ids), np.int64)
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            which[i] = number.setdefault(body[a:b], len(number))
        n = len(number)
        least = np.full(n, NO_ID, np.int64)
        np.minimum.at(least, which, ids)
        first = np.full(n, len(ids), np.int64)
        np.minimum.at(first, which, np.arange(len(ids)))
        # Contexts that share their first digit with another one are expanded into windows.
        digit = _digits_at(body, (ends - sizes)[first], depth) if n else np.zeros(0, np.uint64)
        _, group, count = np.unique(digit, return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[group] > 1) if n else np.zeros(0, np.int64)
        windows = sizes[first[several]] - depth + 1 if n else np.zeros(0, np.int64)
        part: dict[int, list[tuple[int, int]]] = {}
        if len(several):
            owner = np.repeat(several, windows)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            pos = (ends - sizes)[first[owner]] + step
            active, label = equal_windows(np.frombuffer(body, np.uint8), pos, group[owner], depth)
            if len(active):
                low = np.full(label.max() + 1, NO_ID, np.int64)
                np.minimum.at(low, label, least[owner[active]])
                gone = active[least[owner[active]] > low[label]]
                gone.sort()
                if len(gone):
                    o, s = owner[gone], step[gone]
                    new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)))
                    for a, b in zip(new.tolist(), np.append(new[1:], len(gone)).tolist()):
                        part.setdefault(int(o[a]), []).append((int(s[a]), int(s[b - 1]) + depth))
        base = np.cumsum(n_ctx) - n_ctx
        n_occ = [len(x) // 4 for x in r["occ_context"]]
        ctx = unpack(r["occ_context"], np.uint32).astype(np.int64) + np.repeat(base, n_occ)
        key, start = unpack(r["occ_doc"], np.uint32).astype(np.int64), unpack(r["occ_start"], np.uint32).astype(np.int64)
        shard = np.repeat(shards, n_occ)
        whole = ids[ctx] > least[which[ctx]] if len(ctx) else np.zeros(0, bool)
        out = [(shard[whole], key[whole], start[whole], start[whole] + sizes[ctx[whole]])]
        if part:
            some = np.flatnonzero(~whole & np.isin(which[ctx], list(part)))
            rows = [(shard[i], key[i], start[i] + a, start[i] + b) for i in some.tolist() for a, b in part[int(which[ctx[i]])]]
            if rows:
                out.append(tuple(np.array(x, np.int64) for x in zip(*rows)))
        n_done = [len(x) // 4 for x in r["done_doc"]]
        out.append((np.repeat(shards, n_done), unpack(r["done_doc"], np.uint32), unpack(r["done_start"], np.uint32), unpack(r["done_end"], np.uint32)))
        shard, key, start, end = (np.concatenate([np.asarray(x[i], np.int64) for x in out]) for i in range(4))
        rows = {"shard": [], "docs": [], "starts": [], "ends": []}
        order = np.argsort(shard, kind="stable")
        shard, key, start, end = shard[order], key[order], start[order], end[order]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(shard)).tolist()):
            k, s, e = _merged(key[a:b], start[a:b], end[a:b])
            rows["shard"].append(int(shard[a])), rows["docs"].append(pack(k, np.uint32)), rows["starts"].append(pack(s, np.uint32)), rows["ends"].append(pack(e, np.uint32))
        return pa.table({n: pa.array(v, pa.int32() if n == "shard" else pa.binary()) for n, v in rows.items()})

    return run


def whole_characters(body: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of an interval that cuts no UTF-8 character in two."""
    while start < end and body[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(body) and body[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _results(with_text: bool, kept: list[str]):
    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        place = np.empty(docs.num_rows, np.int64)
        place[_ordered(docs)[1]] = np.arange(docs.num_rows)
        key, start, end = _merged(unpack(gone.column("docs").to_pylist(), np.uint32).astype(np.int64), unpack(gone.column("starts").to_pylist(), np.uint32).astype(np.int64), unpack(gone.column("ends").to_pylist(), np.uint32).astype(np.int64))
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        cuts = np.flatnonzero(first)
        of = {int(key[a]): (a, b) for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist())}
        data, offsets = text_buffer(docs.column("text"))
        raw = data.tobytes()
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        texts = []
        for i, k in enumerate(place.tolist()):
            body = raw[offsets[i] : offsets[i + 1]]
            spans = [] if k not in of else list(zip(start[slice(*of[k])].tolist(), end[slice(*of[k])].tolist()))
            at, parts = 0, []
            for a, b in spans:
                parts.append(body[at:a])
                at = b
            left = b"".join([*parts, body[at:]]) if spans else body
            out["n_bytes"].append(len(body)), out["n_removed"].append(len(body) - len(left)), out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["spans"].append(",".join(f"{a}:{b}" for a, b in spans))
            if with_text:
                at, parts = 0, []
                for a, b in (whole_characters(body, a, b) for a, b in spans):
                    parts.append(body[at:a])
                    at = max(at, b)
                texts.append(b"".join([*parts, body[at:]]).decode("utf-8", "replace"))
        got = {"id": docs.column("id"), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "spans": pa.array(out["spans"], pa.string())}
        if with_text:
            got["kept_text"] = pa.array(texts, pa.string())
        return pa.table(got | {k: docs.column(k) for k in kept})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove the bytes of every ``depth``-byte string that also starts in a document with a smaller id.

    Returns one row per input row: the id, n_bytes, n_removed, n_spans, kept_sha256, spans
    ("start:end" of the maximal removed runs, in bytes), with ``with_text`` also kept_text (cut
    at whole characters only, so it stays valid UTF-8), then the columns named in ``keep``.
    See the module's docstring for null, short, repeated and empty input.
    """
    shards = shard_count(docs)
    carried, inner = pass_through(docs, [id_col, text_col], list(keep))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        *carried,
    )
    by_shard = rows.groupBy("shard")
    digits = by_shard.applyInArrow(_digits_of_shard(depth, shards), _DIGITS)
    wanted = digits.groupBy("bucket").applyInArrow(_repeated_digits, _WANTED)
    contexts = by_shard.cogroup(wanted.groupBy("shard")).applyInArrow(_contexts_of_shard(depth, shards), _CONTEXTS)
    gone = contexts.groupBy("bucket").applyInArrow(_settle(depth), _INTERVALS)
    fields = [T.StructField(n, t) for n, t in (("id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("spans", T.StringType()))]
    if with_text:
        fields.append(T.StructField("kept_text", T.StringType()))
    schema = T.StructType([*fields, *[T.StructField(a, docs.schema[c].dataType) for c, a in zip(keep, inner)]])
    out = by_shard.cogroup(gone.groupBy("shard")).applyInArrow(_results(with_text, inner), schema)
    names = [id_col, *[f.name for f in fields[1:]]]
    return out.select(*[F.col(f.name).alias(n) for f, n in zip(fields, names)], *[F.col(a).alias(c) for c, a in zip(keep, inner)])
