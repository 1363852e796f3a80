"""Operator 7: n-gram Jaccard self-join by token-combination prefixes, and its components.

Tokens are the five-word shingles of a text.  All texts are covered:

1. Every shard counts its tokens; the counts meet per token.  A token of one text only can't
   be shared, so a text with too many of them is linked with nothing and is done.
2. The others order their tokens from rare to frequent.  A text may lose at most ``n - ceil(t n)``
   tokens to a partner, so a prefix that loses more is enough.  Rare tokens are indexed singly;
   frequent ones are dealt into sub-classes by hash, and pairs within a sub-class are indexed,
   for which the prefix is extended: of c tokens of a sub-class, c - 1 must be lost to lose all
   its pairs.  The number of sub-classes follows the set's size; near a change of that number a
   text is indexed both ways.
3. Texts with equal sets are one node.  Within an index entry every node is first verified
   against the node whose tokens are the most frequent, then representatives of the parts that
   are left against each other.  What is still apart is seen from that central node: two nodes
   share at most what both share with it, and what both have outside it.  So a pair is verified
   only if it has a token outside in common, or if what it shares inside could do by number.
   Pairs that are known to be connected need no comparison, as only components are asked for.
4. Verified links are joined into components by label propagation with pointer jumping.

Shingles are 64-bit hashes, sets are known by 128 bits of a digest.

Defined cases: null or wordless texts have no shingles and are linked with nothing; equal
rows are linked; a null id counts as larger than any other in a component's smallest id and
gives a null component if there is no other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, materialise, pack, shard_count, unpack
from .shingles import mix, shingle_sets

#: Tokens in so many texts at most are indexed singly.
RARE_TEXTS = 15
#: From this set size on, frequent tokens are indexed in pairs.
PAIRS_FROM = 16
#: Rounds in which representatives of parts are verified before all remaining pairs are.
PART_ROUNDS = 1
NO_ID = np.iinfo(np.int64).max


def _spread(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 32 bits of the token within it."""
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return bucket, (mix(tokens) >> np.uint64(32)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers by byte planes, which compress better."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _counts_of_shard(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        sets = [s for s in shingle_sets(table.column("text")) if len(s)]
        rows = {"bucket": [], "shard": [], "tokens": [], "counts": []}
        if sets:
            bucket, value = _spread(np.concatenate(sets), buckets)
            code, count = np.unique(bucket.astype(np.uint64) << np.uint64(32) | value, return_counts=True)
            bucket, value, count = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist()):
                rows["bucket"].append(int(bucket[a])), rows["shard"].append(shard), rows["tokens"].append(_planes(value[a:b])), rows["counts"].append(count[a:b].tobytes())
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "shard": pa.array(rows["shard"], pa.int32()), "tokens": pa.array(rows["tokens"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    return run


def _shared_tokens(table: pa.Table) -> pa.Table:
    """For each shard its tokens that two texts at least have, with the bit length of their number."""
    bucket = table.column("bucket")[0].as_py()
    blobs = table.column("counts").to_pylist()
    values = np.concatenate([_unplanes(x) for x in table.column("tokens").to_pylist()])
    counts = unpack(blobs, np.uint8).astype(np.int64)
    shard = np.repeat(table.column("shard").to_numpy(), [len(x) for x in blobs])
    order = np.argsort(values, kind="stable")
    values, counts, shard = values[order], counts[order], shard[order]
    first = np.append(True, values[1:] != values[:-1])
    group = np.cumsum(first) - 1
    total = np.bincount(group, counts).astype(np.int64)
    keep = (total > 1)[group]
    level = np.ceil(np.log2(total + 1)).astype(np.uint8)[group][keep]
    values, shard = values[keep], shard[keep]
    order = np.argsort(shard, kind="stable")
    values, shard, level = values[order], shard[order], level[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    spans = list(zip(cuts.tolist(), np.append(cuts[1:], len(shard)).tolist()))
    return pa.table({"shard": pa.array([int(shard[a]) for a, _ in spans], pa.int32()), "bucket": pa.array([bucket] * len(spans), pa.int32()), "tokens": pa.array([_planes(values[a:b]) for a, b in spans], pa.binary()), "levels": pa.array([level[a:b].tobytes() for a, b in spans], pa.binary())})


def _scheme(n: int) -> int:
    """Number of sub-classes of frequent tokens for sets of n tokens; 0: all are indexed singly."""
    return 0 if n < PAIRS_FROM else 1 << (n // 8).bit_length() - 1


def signatures(tokens: np.ndarray, level: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index keys of a set's extended prefix; ``tokens`` are its shared ones, ``n`` its size."""
    lost = n - -(-percent * n // 100)
    # Tokens that no other text has are lost to any partner.
    spare = lost - (n - len(tokens))
    if spare < 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    rare = level <= int(RARE_TEXTS).bit_length()
    found = []
    sizes = {_scheme(-(-percent * n // 100)), _scheme(n), _scheme(100 * n // percent)}
    for m in sizes:
        if m:
            sub = (tokens >> np.uint64(7)) % np.uint64(m)
            code = np.where(rare, np.uint64(1 << 63), sub)
            _, at = np.unique(code, return_index=True)
            opens = np.zeros(len(tokens), bool)
            opens[at] = True
            cost = rare | ~opens
        else:
            cost = np.ones(len(tokens), bool)
        size = int(np.searchsorted(np.cumsum(cost), spare + 1)) + 1
        single = np.flatnonzero(cost[:size]) if not m else np.flatnonzero(rare[:size])
        found.append(mix(tokens[single]))
        if m:
            other = np.flatnonzero(~rare[:size])
            other = other[np.argsort(sub[other], kind="stable")]
            t, s = tokens[other], sub[other]
            with np.errstate(over="ignore"):
                for gap in range(1, len(t)):
                    same = np.flatnonzero(s[gap:] == s[:-gap])
                    if not len(same):
                        break
                    low, high = np.minimum(t[same], t[same + gap]), np.maximum(t[same], t[same + gap])
                    found.append(mix(mix(low) * np.uint64(3) + high + np.uint64(m)))
    return distinct(np.concatenate(found))


def _nodes_of_shard(buckets: int, percent: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        out = {"id": [], "n": [], "node": [], "score": [], "tokens": [], "signs": []}
        if docs.num_rows:
            code, level = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
            if shared.num_rows:
                blobs = shared.column("tokens").to_pylist()
                bucket = np.repeat(shared.column("bucket").to_numpy().astype(np.uint64), [len(x) // 4 for x in blobs])
                code = bucket << np.uint64(32) | np.concatenate([_unplanes(x) for x in blobs])
                level = unpack(shared.column("levels").to_pylist(), np.uint8)
                order = np.argsort(code)
                code, level = code[order], level[order]
            seen = set()
            for i, tokens in zip(docs.column("id").to_pylist(), shingle_sets(docs.column("text"))):
                n, row = len(tokens), (None, None, None, None)
                if n and len(code):
                    bucket, value = _spread(tokens, buckets)
                    own = bucket.astype(np.uint64) << np.uint64(32) | value
                    at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                    hit = code[at] == own
                    if 100 * int(hit.sum()) >= percent * n:
                        node = hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()
                        row = (node, None, None, None)
                        if node not in seen:
                            seen.add(node)
                            t, lv = tokens[hit], level[at[hit]]
                            row = (node, int(lv.sum(dtype=np.int64)) * 1_000_000 // n, pack(t, np.uint64), signatures(t, lv, n, percent).view(np.int64))
                out["id"].append(i), out["n"].append(n)
                for name, x in zip(("node", "score", "tokens", "signs"), row):
                    out[name].append(x)
        kinds = {"id": pa.int64(), "n": pa.int64(), "node": pa.string(), "score": pa.int64(), "tokens": pa.binary(), "signs": pa.list_(pa.int64())}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})

    return run


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
            keep = []
            for x, y, (n, m) in zip(a, b, sizes):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(keep, pa.bool_())})

    return run


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for distinct pairs: exact comparison of their sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(_similar(percent), "a string, b string, linked boolean")


def _ordered_pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _near_size(percent: int):
    """Sets whose sizes differ too much can't be similar."""
    return 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")


def _seen_from(batches):
    """How many tokens a node shares with another one, and which of its tokens that one lacks."""
    for batch in batches:
        inside, outside = [], []
        for x, p in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
            x, p = np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64)
            hit = p[np.minimum(np.searchsorted(p, x), len(p) - 1)] == x
            inside.append(int(hit.sum()))
            outside.append(x[~hit].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "n_a", "label")] + [pa.array(inside, pa.int64()), pa.array(outside, pa.list_(pa.int64()))], ["node", "pivot", "n", "label", "inside", "outside"])


def _apart(parts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, n_x, n_y) of nodes of different parts that an index entry has in common and that may be similar."""
    seen = parts.select(F.col("node").alias("a"), F.col("top.node").alias("b"), "label").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = seen.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "label", "tokens_a", "tokens_b")
    rel = materialise(both.mapInArrow(_seen_from, "node string, pivot string, n long, label string, inside long, outside array<long>"), "seen")
    rel = rel.withColumn("size", F.size("outside").cast("long"))

    def named(x: str) -> list:
        return [F.col("node").alias({"x": "u", "y": "v"}[x]), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "label", "inside", "size")]]

    enough = lambda shared: (F.col("label_x") < F.col("label_y")) & ((100 + percent) * shared >= percent * (F.col("n_x") + F.col("n_y")))
    inside, outside = F.least("inside_x", "inside_y"), F.least("size_x", "size_y")
    token = rel.select("pivot", F.explode("outside").alias("token"), "node", "n", "label", "inside", "size")
    one = token.select("pivot", "token", *named("x")).join(token.select("pivot", "token", *named("y")), ["pivot", "token"]).filter(enough(inside + outside))
    # Without a token outside in common a partner has room * n tokens at most; smaller ones must exist.
    least = rel.groupBy("pivot").agg(F.min("n").alias("least"))
    able = rel.join(least, "pivot").filter((100 + percent) * F.col("inside") >= percent * (F.col("n") + F.col("least")))
    two = able.select("pivot", *named("x")).join(able.select("pivot", *named("y")), "pivot").filter(enough(inside))
    return one.select("u", "v", "n_x", "n_y").unionByName(two.select("u", "v", "n_x", "n_y"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); label: the least node reachable."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        moved = materialise(lower.join(hop, "low").select("node", F.col("label").alias("was"), F.least("low", "next").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("was != label").isEmpty():
            return labels


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: the id, n_shingles and component_id.

    Two texts are linked when the Jaccard similarity of their shingle sets is ``percent``
    hundredths at least.  See the module's docstring for null, empty and repeated input.
    """
    shards = shard_count(docs)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(shards)).cast("int").alias("shard"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    by_shard = rows.groupBy("shard")
    shared = by_shard.applyInArrow(_counts_of_shard(shards), "bucket int, shard int, tokens binary, counts binary").groupBy("bucket").applyInArrow(_shared_tokens, "shard int, bucket int, tokens binary, levels binary")
    members = materialise(by_shard.cogroup(shared.groupBy("shard")).applyInArrow(_nodes_of_shard(shards, percent), "id long, n long, node string, score long, tokens binary, signs array<long>"), "members")
    nodes = materialise(members.filter("tokens is not null").dropDuplicates(["node"]).select("node", "n", "score", "tokens", "signs"), "nodes")

    entries = nodes.select(F.explode("signs").alias("sign"), "node", "n", "score")
    several = entries.groupBy("sign").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("score", "node", "n")).alias("top")).filter("size > 1").select("sign", "top")
    entries = materialise(entries.join(several, "sign"), "entries")

    # Every node against the most central node that it shares an entry with, and the most frequent one.
    tops = entries.filter("node != top.node").select("node", F.col("n").alias("n_x"), F.col("top.n").alias("n_y"), F.col("top.node").alias("other"), F.col("top.score").alias("rank")).filter(_near_size(percent))
    tops = tops.groupBy("node", "other").agg(F.count(F.lit(1)).alias("times"), F.first("rank").alias("rank"))
    best = tops.groupBy("node").agg(F.max(F.struct("rank", "other")).alias("x"), F.max(F.struct("times", "other")).alias("y"))
    first = best.select(F.explode(F.array("x.other", "y.other")).alias("other"), "node").select(*_ordered_pair("node", "other")).distinct()
    known = materialise(verified(first, nodes, percent), "pairs")

    labels, step = connected(known.filter("linked")), 0
    while step <= PART_ROUNDS:
        parts = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_signs = parts.groupBy("sign").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("sign")
        parts = parts.join(open_signs, "sign")
        if step < PART_ROUNDS:
            part = parts.groupBy("sign", "label").agg(F.max(F.struct("score", "node", "n")).alias("x"))
            top = part.groupBy("sign").agg(F.max("x").alias("y"))
            pairs = part.join(top, "sign").filter("x.node != y.node").select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("x.n").alias("n_x"), F.col("y.n").alias("n_y"))
        else:
            pairs = _apart(parts, nodes, percent)
        pairs = pairs.filter(_near_size(percent)).select(*_ordered_pair("u", "v")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        more = materialise(verified(pairs, nodes, percent), "pairs")
        step = PART_ROUNDS if step < PART_ROUNDS and more.isEmpty() else step + 1
        known = known.unionByName(more)
        if not more.filter("linked").isEmpty():
            labels = connected(known.filter("linked"))

    least = members.filter("node is not null").groupBy("node").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = least.groupBy("label").agg(F.min("least").alias("component"))
    of_node = least.join(of_label, "label").select("node", "component")
    return members.select("id", "n", "node").join(of_node, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("id")).when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))
