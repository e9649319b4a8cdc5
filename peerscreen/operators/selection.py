"""Exact order statistics of many groups and columns at once, by counting passes.

Values stay where they lie, in blocks of numpy arrays. A pass counts, per group, how many values
share the upper bits of their order-preserving key; the bucket that holds a wanted rank is opened in
the next pass by 16 further bits, so four passes settle any 64-bit number. A group, or an open
bucket, of at most KEEP values is sent as it is, which ends its search at once: small tables take
one pass. No row is copied per group, column or rank, and what travels is bounded by groups, not rows.
Tasks merge the counts by group and find the buckets; ranks and values alone reach the driver.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import partial, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peerscreen.functions.columns import finite

KEEP = 4096
BITS = 16
DEALT = 256  # groups of partitions a merging task is worth
MANY = 16  # partitions beyond which partial results are merged in rounds


def gathered(blocks, part: Callable[[Any], Any], merge: Callable[[Any, Any], Any]):
    """part(block) of all blocks, merged: within partitions, then among them.

    Functions of modules and partial() calls of them travel by name, which keeps short jobs short.
    """
    if blocks.getNumPartitions() > MANY:
        return blocks.mapPartitions(partial(within, part, merge)).treeReduce(merge)
    return reduce(merge, blocks.context.runJob(blocks, partial(within, part, merge)))


def within(part: Callable, merge: Callable, blocks: Iterator) -> list:
    found = [part(b) for b in blocks]
    return [reduce(merge, found)] if found else []


def ordered(values: np.ndarray) -> np.ndarray:
    """uint64 keys that sort like the numbers; both zeros are one."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def numbers(keys: np.ndarray) -> np.ndarray:
    """The inverse of ordered."""
    keys = np.asarray(keys, dtype=np.uint64)
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def told(keys: np.ndarray, shift: int, keep: int):
    """Few keys as they are, many as counts of their upper bits."""
    return ("keys", np.sort(keys)) if len(keys) <= keep else counted(keys, shift)


def counted(keys: np.ndarray, shift: int):
    return ("counts", *np.unique(keys >> np.uint64(shift), return_counts=True))


def added(a, b, shift: int, keep: int):
    if a[0] == b[0] == "keys":
        return told(np.concatenate([a[1], b[1]]), shift, keep)
    a, b = (counted(x[1], shift) if x[0] == "keys" else x for x in (a, b))
    names, at = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    return "counts", names, np.bincount(at, weights=np.concatenate([a[2], b[2]])).astype(np.int64)


def _pass(values: Callable, wanted: dict | None, shift: int, keep: int, block) -> dict:
    """What one block says about each group, or about each open bucket of a group."""
    found = {}
    for group, x in values(block).items():
        if wanted is None:
            if len(x):
                found[group] = told(ordered(x), shift, keep)
        elif group in wanted:
            keys = ordered(x)
            upper = keys >> np.uint64(shift + BITS)
            at = np.minimum(np.searchsorted(wanted[group], upper), len(wanted[group]) - 1)
            hit = wanted[group][at] == upper
            for k in np.unique(at[hit]):
                found[group, int(wanted[group][k])] = told(keys[hit & (at == k)], shift, keep)
    return found


def _merged(shift: int, keep: int, a: dict, b: dict) -> dict:
    return a | {k: added(a[k], v, shift, keep) if k in a else v for k, v in b.items()}


def _dealt(part: Callable, merge: Callable, width: int, blocks: Iterator) -> list:
    """What a partition says, by the task that merges the group."""
    out: list[dict] = [{} for _ in range(width)]
    for found in within(part, merge, blocks):
        for k, t in found.items():
            out[zlib.crc32(repr(k).encode()) % width][k] = t
    return [(i, d) for i, d in enumerate(out) if d]


def _settled(merge: Callable, shift: int, ranks: Callable, asked: dict | None, dealt: Iterator[tuple[int, dict]]) -> list[tuple]:
    """Per group or open bucket: its size, the ranks it settles, and (rank, bucket, rank inside) of the others."""
    out = []
    for k, t in reduce(merge, (d for _, d in dealt), {}).items():
        n = len(t[1]) if t[0] == "keys" else int(t[2].sum())
        rest = [(r, r) for r in ranks(k, n)] if asked is None else asked[k]
        if t[0] == "keys":
            out.append((k, n, [(r, float(numbers(t[1][[inside]])[0])) for r, inside in rest], []))
            continue
        ends, done, later = np.cumsum(t[2]), [], []
        for r, inside in rest:
            at = int(np.searchsorted(ends, inside, side="right"))
            if shift == 0:
                done.append((r, float(numbers(t[1][[at]])[0])))
            else:
                later.append((r, int(t[1][at]), inside - int(ends[at] - t[2][at])))
        out.append((k, n, done, later))
    return out


def _ranked(blocks, values: Callable, ranks: Callable, groups: int | None) -> tuple[dict[Hashable, dict[int, float]], dict[Hashable, int]]:
    """({group: {rank: value}}, {group: size}). Tasks merge and settle groups; the driver sees ranks and values."""
    out: dict[Hashable, dict[int, float]] = {}
    sizes: dict[Hashable, int] = {}
    asked: dict[tuple, list[tuple[int, int]]] | None = None  # (group, bucket) -> (rank, rank inside)
    parts = blocks.getNumPartitions()
    for shift in (48, 32, 16, 0):
        wanted: dict | None = None
        if asked is not None:
            wanted = {}
            for g, bucket in sorted(asked, key=lambda k: k[1]):
                wanted.setdefault(g, []).append(bucket)
            wanted = {g: np.array(b, dtype=np.uint64) for g, b in wanted.items()}
        merge = partial(_merged, shift, KEEP)
        n = groups if asked is None else len(asked)
        width = min(parts, blocks.context.defaultParallelism)
        if n is not None:  # every task tells the driver some 2 KB of its own, so few groups meet in few tasks
            width = max(min(width, -(-n * parts // DEALT)), 1)
        dealt = blocks.mapPartitions(partial(_dealt, partial(_pass, values, wanted, shift, KEEP), merge, width))
        if parts > 1:
            dealt = dealt.partitionBy(width, int)
        found = dealt.mapPartitions(partial(_settled, merge, shift, ranks, asked)).collect()  # a few numbers per group
        later: dict[tuple, list[tuple[int, int]]] = {}
        for k, n, done, rest in found:
            g = k if asked is None else k[0]
            if asked is None:
                sizes[g] = n
            out.setdefault(g, {}).update(done)
            for r, bucket, inside in rest:
                later.setdefault((g, bucket), []).append((r, inside))
        if not later:
            break
        asked = later
    return out, sizes


def order_statistics(
    blocks, values: Callable[[Any], dict[Hashable, np.ndarray]], ranks: Callable[[Hashable, int], Sequence[int]], groups: int | None = None
) -> dict[Hashable, dict[int, float]]:
    """{group: {rank: value}} for the 0-based ranks that ranks(group, n) asks for.

    values(block) gives the finite numbers of each group in a block; groups without any are absent.
    groups, if known, says about how many there are, which saves tasks.
    """
    return _ranked(blocks, values, ranks, groups)[0]


def between(n: int, level: float) -> tuple[int, int, float]:
    """The two ranks around a quantile and how far it lies from the lower to the upper."""
    place = (n - 1) * level
    low = int(np.floor(place))
    return low, min(low + 1, n - 1), place - low


def _around(levels: Callable, group: Hashable, n: int) -> list[int]:
    return sorted({r for q in levels(group) for r in between(n, q)[:2]})


def quantiles(
    blocks, values: Callable[[Any], dict[Hashable, np.ndarray]], levels: Callable[[Hashable], Sequence[float]], groups: int | None = None
) -> dict[Hashable, list[float]]:
    """{group: quantiles}, interpolated between neighbours; levels(group) says which."""
    found, sizes = _ranked(blocks, values, partial(_around, levels), groups)
    out = {}
    for g, at in found.items():
        cuts = [between(sizes[g], q) for q in levels(g)]
        out[g] = [at[a] + (at[b] - at[a]) * w if w else at[a] for a, b, w in cuts]
    return out


def quantile(values: np.ndarray, level: float) -> float:
    """What quantiles() finds, of one group that is at hand."""
    low, high, w = between(len(values), level)
    a, b = map(float, numbers(np.partition(ordered(values), (low, high))[[low, high]]))
    return a + (b - a) * w if w else a


def column_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of the finite values of every column; columns without values are absent."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = {c: batch[c].drop_null().to_numpy() for c in columns}
            yield pa.record_batch({"block": pa.array([pickle.dumps(arrays, protocol=5)], pa.binary())})

    numbers_ = df.select(*[finite(c).alias(c) for c in columns])
    blocks = numbers_.mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))  # noqa: S301 (packed above)
    if blocks.isEmpty():
        return {}
    return quantiles(blocks, lambda b: b, lambda c: levels, len(columns))
