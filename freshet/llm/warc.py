"""Operator 2: WARC archives, with a capture index merged from sorted runs.

Every shard of pages becomes one archive: WARC/1.1 records, each a gzip member of its own, in a
binary column that Spark writes to the shared folder (so any store will do, and a lost task's
archive is written again).  Of records with equal payloads of ``least_payload`` bytes at least,
that with the smallest id is the response; the others are revisits that refer to it.

Archives are read back record by record; each yields a locally sorted run of its captures by URL
key, time and id.  Runs are cut at common splitters and each range merges its parts of all runs
by a loser tree, so ranges one after the other are the globally ordered capture histories.

Defined cases: a null payload is empty; a null URL has an empty key and no target header; equal
rows, and rows with one id and payload, are all responses (or all revisits of a smaller id); a
null id is archived under no number and counts as larger than all others, so it revisits a page
with an id and is a response if there is none; payloads of any length are one record; columns
besides the id, URL and html are left out, whatever they are called; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shard_count

LEVEL = 4
#: Bytes of an archive that are decompressed at a time, and of the compressed input that one archive should hold.
SLICE, SHARD_BYTES = 1 << 14, 1 << 18
#: Record ids are this prefix and the page's number.
RECORDS = 0x5F0E5EED00004000 << 64
EPOCH = 1_704_067_200
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bound of the sample of keys from which splitters are taken (they only balance the ranges), and captures of a range.
SAMPLE, RANGE_ROWS = 20_000, 20_000
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//", re.IGNORECASE)


def record_id(number: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=RECORDS | (number & (1 << 64) - 1 if number is not None else 1 << 64))}>"


def record_number(text: str) -> int | None:
    low = uuid.UUID(text.strip("<>").removeprefix("urn:uuid:")).int & (1 << 65) - 1
    if low >> 64:
        return None
    return low - (1 << 64) if low >> 63 else low


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from right to left, then path and query, all in one sortable string."""
    if not url:
        return ""
    try:
        u = urlsplit(url if _HOST.match(url) else "//" + url)
        host, port = u.hostname or "", u.port
    except ValueError:
        return quote(url, safe="/?&=%:,)(.~-_")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/")
    return quote(key + (f"?{u.query}" if u.query else ""), safe="/?&=%:,)(.~-_")


def write_record(number, url, when: int, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(number)}", f"WARC-Date: {datetime.datetime.fromtimestamp(when, datetime.UTC):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]|"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(archive: bytes):
    """(offset, length, headers, HTTP headers, payload) of each record of an archive."""
    at = 0
    while at < len(archive):
        z, end, parts = zlib.decompressobj(31), at, []
        while not z.eof:  # by slices, as what follows the record is copied each time
            part = archive[end : end + SLICE]
            if not part:
                raise ValueError(f"the record at byte {at} ends early")
            parts.append(z.decompress(part))
            end += len(part)
        body, size = b"".join(parts), end - at - len(z.unused_data)
        head, _, rest = body.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        h = _headers(head)
        block = rest[: int(h["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, size, h, _headers(http), payload
        at += size


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner is on top."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.lost = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, i: int) -> None:
        """Carry run i up from its leaf; an empty place keeps it while the tree is built."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.lost[node]
            if other < 0:
                self.lost[node] = i
                return
            if self._less(other, i):
                self.lost[node], i = i, other
            node //= 2
        self.lost[0] = i

    def __iter__(self):
        while self.k:
            i = self.lost[0]
            if self.head[i] is None:
                return
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self._play(i)


def _write(pages: pa.Table, revisits: pa.Table) -> pa.Table:
    first = {(i, d): f for i, d, f in zip(*(revisits.column(c).to_pylist() for c in ("number", "payload", "first")))}
    out = []
    shard = None
    for shard, i, url, html, when, digest in zip(*(pages.column(c).to_pylist() for c in ("shard", "id", "url", "html", "seconds", "digest"))):
        payload = html or b""
        out.append(write_record(i, url, EPOCH if when is None else when, payload, first.get((i, digest)), base64.b32encode(bytes.fromhex(digest)).decode()))
    return pa.table({"segment": pa.array([shard] if out else [], pa.int32()), "archive": pa.array([b"".join(out)] if out else [], pa.binary())})


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seconds: F.Column | None = None, least_payload: int = 0) -> DataFrame:
    """Archives of all rows, (segment, archive), written to the shared folder.

    ``seconds``: capture time of a row as Unix seconds; by default the epoch plus the id.
    """
    shards = shard_count(pages, SHARD_BYTES, least=16)
    html = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(url_col)), F.lit(shards)).cast("int").alias("shard"),
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("html"),
        (F.lit(EPOCH) + F.pmod(F.col(id_col).cast("long"), F.lit(1 << 30)) if seconds is None else seconds).cast("long").alias("seconds"),
        F.sha1(html).alias("digest"),
    )
    firsts = rows.filter(F.octet_length("html") >= least_payload).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    revisits = rows.filter(F.octet_length("html") >= least_payload).select("shard", "id", "digest").join(firsts, "digest").filter("first is not null and not (id <=> first)").groupBy(F.col("shard").alias("to"), F.col("id").alias("number"), F.col("digest").alias("payload")).agg(F.min("first").alias("first"))
    return materialise(rows.groupBy("shard").cogroup(revisits.groupBy("to")).applyInArrow(_write, "segment int, archive binary"), "warc")


def _run(batches):
    """The sorted run of each archive, as lines of key, time, id and the rest in JSON."""
    for batch in batches:
        rows = {"segment": [], "n": [], "run": []}
        for segment, archive in zip(batch.column("segment").to_pylist(), batch.column("archive").to_pylist()):
            run = []
            for at, size, h, http, payload in read_records(archive):
                number, digest = record_number(h["warc-record-id"]), h["warc-payload-digest"].removeprefix("sha1:")
                response = h["warc-type"] == "response"
                if response and payload_digest(payload) != digest:
                    raise ValueError(f"the payload at byte {at} of segment {segment} isn't what its digest says")
                run.append((url_key(h.get("warc-target-uri")), re.sub(r"\D", "", h["warc-date"]), number, h["warc-type"], len(payload) if response else int(http["content-length"]), digest, None if response else record_number(h["warc-refers-to"]), segment, at, size))
            run.sort(key=_order)
            rows["segment"].append(segment), rows["n"].append(len(run)), rows["run"].append(json.dumps(run))
        yield pa.RecordBatch.from_arrays([pa.array(rows["segment"], pa.int32()), pa.array(rows["n"], pa.int64()), pa.array(rows["run"], pa.string())], list(rows))


def _order(row) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0


def _sample(step: int):
    def run(batches):
        for batch in batches:
            keys = []
            for segment, text in zip(batch.column("segment").to_pylist(), batch.column("run").to_pylist()):
                keys += [json.dumps(_order(r)) for r in json.loads(text)[segment % step :: step]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    return run


def _cut(splitters: list[tuple]):
    import bisect

    def run(batches):
        for batch in batches:
            rows = {"range": [], "segment": [], "run": []}
            for segment, text in zip(batch.column("segment").to_pylist(), batch.column("run").to_pylist()):
                captures = json.loads(text)
                at = [0, *(bisect.bisect_left(captures, s, key=_order) for s in splitters), len(captures)]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    if b > a:
                        rows["range"].append(k), rows["segment"].append(segment), rows["run"].append(json.dumps(captures[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["range"], pa.int32()), pa.array(rows["segment"], pa.int32()), pa.array(rows["run"], pa.string())], list(rows))

    return run


_COLUMNS = (("url_key", pa.string()), ("capture_time", pa.string()), ("id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()))


def _merge(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("segment").to_numpy(), kind="stable")
    runs = [[(_order(r), r) for r in json.loads(table.column("run")[int(i)].as_py())] for i in order]
    merged = [r for _, r in LoserTree(runs)]
    n, k = len(merged), table.column("range")[0].as_py()
    return pa.table({name: pa.array([r[j] for r in merged], kind) for j, (name, kind) in enumerate(_COLUMNS)} | {"range": pa.array([k] * n, pa.int32()), "place": pa.array(range(n), pa.int64())})


def capture_index(archives: DataFrame) -> DataFrame:
    """Captures of all archives; by (range, place) they are in order of URL key, time and id."""
    runs = materialise(archives.mapInArrow(_run, "segment int, n long, run string"), "runs")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // RANGE_ROWS), min(64, total // 50))
    step = max(1, -(-total // SAMPLE))
    keys = sorted(tuple(json.loads(r["key"])) for r in runs.mapInArrow(_sample(step), "key string").collect())
    splitters = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    cut = runs.mapInArrow(_cut(splitters), "range int, segment int, run string")
    schema = "url_key string, capture_time string, id long, record_type string, payload_bytes long, payload_digest string, refers_to long, segment int, offset long, length long, range int, place long"
    return cut.groupBy("range").applyInArrow(_merge, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_payload: int = 0) -> DataFrame:
    """Write all rows to archives, read these back and return the captures with their place in the merged index."""
    return capture_index(write_archives(pages, id_col, url_col, html_col, least_payload=least_payload)).withColumnRenamed("id", id_col)
