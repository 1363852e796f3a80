"""Greedy selection of well separated times, as a fold over sorted streams.

Spark sorts the rows of every key once (secondary sort); a task then reads them in order and holds
of a key nothing but what it has picked, which the quotas bound.  Rows of a group whose quota is
met, and of a key that lacks nothing more, are passed over without a look at their times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Places at which any of the columns changes, the first included; nulls are values like others."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


class _Picks:
    """What a key has picked: times, and how many there were when the group began."""

    def __init__(self):
        self.times = np.zeros(0, np.int64)
        self.exact: set[int] = set()
        self.group, self.before, self.taken = None, 0, 0

    def free(self, at: np.ndarray, apart: int) -> np.ndarray:
        """Whether each time is so far apart from all that is picked."""
        if not len(self.times):
            return np.ones(len(at), bool)
        place = np.searchsorted(self.times, at)
        left = self.times[np.maximum(place - 1, 0)]
        right = self.times[np.minimum(place, len(self.times) - 1)]
        return (np.abs(at - left) >= apart) & (np.abs(at - right) >= apart)

    def add(self, hour: int, time: int) -> None:
        self.times = np.insert(self.times, np.searchsorted(self.times, hour), hour)
        self.exact.add(time)
        self.taken += 1


def _fold(keys: list[str], most: int, per_group: int, apart: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, _Picks()
        for batch in batches:
            if not batch.num_rows:
                continue
            chosen: list[int] = []
            order: list[int] = []
            columns = {n: batch.column(n) for n in batch.schema.names}
            cuts = _starts([columns[k] for k in [*keys, "phase", "tier", "g"]])
            hour, time = columns["h"].to_numpy(), columns["t"].to_numpy()
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], batch.num_rows).tolist()):
                own = tuple(columns[k][a].as_py() for k in keys)
                if own != key:
                    key, state = own, _Picks()
                group = tuple(columns[k][a].as_py() for k in ("phase", "tier", "g"))
                if group != state.group:
                    state.group, state.before, state.taken = group, len(state.exact), 0
                first = group[0] == 1
                room = (lambda: state.before < most and state.taken < per_group) if first else (lambda: len(state.exact) < most)
                at = a
                while at < b and room():
                    # The first row of a piece that is free now; each pick may take more of them.
                    end = min(b, at + 4096)
                    free = at + np.flatnonzero(state.free(hour[at:end], apart))
                    pick = next((k for k in free.tolist() if int(time[k]) not in state.exact), None)
                    if pick is None:
                        at = end
                        continue
                    state.add(int(hour[pick]), int(time[pick]))
                    chosen.append(pick)
                    order.append(len(state.exact))
                    at = pick + 1
            if chosen:
                taken = pa.array(chosen)
                yield pa.RecordBatch.from_arrays([*[pc.take(columns[n], taken) for n in [*keys, "d", "t", "y", "tier"]], pa.array(order, pa.int32())], [*keys, "d", "t", "y", "tier", "n"])

    return run


def picked(rows: DataFrame, keys: list[str], most: int, per_group: int, apart_us: int) -> DataFrame:
    """(keys, d, t, y, tier, n): rows chosen per key, in order ``n`` of their choice.

    ``rows`` has the keys, phase, tier, g, d (distance), o (order among equals), t and h (micros,
    h by the hour) and y.  Rows are looked at by (phase, tier, g, d, o, t).  In phase 1 a group
    (tier, g) takes up to ``per_group`` rows if the key had less than ``most`` when the group began;
    in phase 2 the key is filled up to ``most``.  Chosen hours are ``apart_us`` apart and no time is
    chosen twice.
    """
    order = ["phase", "tier", "g", "d", "o", "t"]
    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    ready = rows.select(*keys, "phase", "tier", "g", "d", "o", "t", "h", "y").repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*[f"`{k}` {t}" for k, t in kinds.items()], "d double, t long, y int, tier int, n int"])
    return ready.mapInArrow(_fold(keys, most, per_group, apart_us), schema)
