"""Gradient-boosted trees on binned columns, many models in one pass.

The training table becomes blocks of numpy arrays that stay on the executors: row ids, bins of
every feature (one byte each, one set of bins per training set), targets, membership in the training
sets, and the running forecast of every model. A round is three or four jobs whatever the number of
models: one histogram pass per tree level, keyed by model, node, feature and bin. Histograms meet by
model in tasks that add them up in the order of their partitions and pick the splits; leaf values come
from the same sums, or, for absolute and quantile error, from one exact selection of residuals per leaf.
The first pass of a round also adds the last round's trees to the forecasts. Of two siblings only the
smaller one is counted, the other is the difference to the parent, whose sums stay in the task's partition.

Forecasts are persisted from round to round and checkpointed every CHECKPOINT_EVERY rounds, so a
lost executor costs at most that many updates of its blocks. To the driver come one split per judged
node and selected values, never histograms or rows.

Rows are drawn by a hash of row id, seed and round, columns by seed and round, so fits depend
neither on how rows are dealt nor on which other models share the pass.

Rounds of a small table take as long as their jobs, whatever its rows. Up to WHOLE bins every model
therefore gets a copy of its training rows and grows all its rounds in one task, the models side by
side: one job instead of some hundreds. Sums are added in the same order, so the trees are the same
(but for partitions of a few rows, which are joined first).
"""

from __future__ import annotations

import heapq
import math
import pickle
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from peerscreen.operators import ordering, selection

BINS = 64
BLOCK = 65_536
WORK = 20_000  # rows times models a partition is worth
SUMS = 64  # histograms of models and partitions a merging task is worth
CHECKPOINT_EVERY = 50
WHOLE = 16_000_000  # bins of a table that a task may hold to grow a model
TINY = 128  # rows a partition has at least on average, if its sums are to be taken on their own
FEW = 10  # rounds whose jobs take no longer than dealing out the table by model
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Fit:
    """One ensemble to grow."""

    columns: tuple[int, ...]  # of the table's features
    target: int
    member: int  # training set
    objective: str
    params: dict
    seed: int
    centred: bool  # forecasts begin at 0


@dataclass
class Node:
    gradient: float
    curvature: float
    rows: float
    depth: int
    parent: int = -1
    left: int = -1
    right: int = -1
    feature: int = -1
    bin: int = -1
    gain: float = 0.0
    judged: bool = False
    best: tuple | None = None  # gain, feature, bin, (gradient, curvature, rows) of the left side


#: ids, x (raw features, until they are binned), bins (one table per training set), targets,
#: members (rows x training sets), forecasts (rows x models). A plain dict travels between workers.
Block = dict


# --- from a DataFrame to blocks ---------------------------------------------------------


def blocks_of(df: DataFrame, models: int) -> RDD:
    """df has id long, x array<double> (null where missing), targets array<double>, members array<boolean>."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, -(-n * models // WORK)), -(-n // BLOCK), 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = lambda lists: lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        for batch in batches:
            if batch.num_rows:
                x, targets, members = wide(batch["x"]).astype(np.float64), wide(batch["targets"]), wide(batch["members"]).astype(bool)
                block = Block(ids=batch["id"].to_numpy().view(np.uint64), x=x, targets=targets, members=members)
                yield pa.record_batch({"block": pa.array([pickle.dumps(block, protocol=5)], pa.binary())})

    dealt = df.select("id", "x", "targets", "members").repartition(parts, "id").sortWithinPartitions("id")
    written = ordering.stable(dealt.mapInArrow(packed, "block binary"))
    return written.rdd.map(lambda r: pickle.loads(r["block"]))  # noqa: S301 (written one line above)


def fills(blocks: RDD, features: int, sets: int) -> np.ndarray:
    """Exact medians per training set and feature, 0 without values."""
    got = selection.quantiles(blocks, partial(_finite, features=features, sets=sets), lambda g: (0.5,), sets * features)
    return np.array([[got.get((s, f), [0.0])[0] for f in range(features)] for s in range(sets)])


def edges(blocks: RDD, features: int, sets: int, fill: np.ndarray) -> list[list[np.ndarray]]:
    """Cut points per training set and feature: values at equal shares of its rows, gaps filled."""

    def ranks(group, n):
        return sorted({max(math.ceil(n * i / BINS) - 1, 0) for i in range(1, BINS)})

    got = selection.order_statistics(blocks, partial(_filled, features=features, sets=sets, fill=fill), ranks, sets * features)
    return [[np.unique(list(got.get((s, f), {}).values())) for f in range(features)] for s in range(sets)]


def _finite(b: Block, features: int, sets: int):
    for_set = [b["x"][b["members"][:, s]] for s in range(sets)]
    return {(s, f): x[np.isfinite(x[:, f]), f] for s, x in enumerate(for_set) for f in range(features)}


def _filled(b: Block, features: int, sets: int, fill: np.ndarray):
    return {(s, f): c for s in range(sets) for f, c in enumerate(np.where(np.isfinite(b["x"]), b["x"], fill[s])[b["members"][:, s]].T)}


def _binned(b: Block, cuts: list[list[np.ndarray]], fill: np.ndarray, start: np.ndarray) -> Block:
    tables = []
    for s, own in enumerate(cuts):
        x = np.where(np.isfinite(b["x"]), b["x"], fill[s])
        tables.append(np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(own)], axis=1).astype(np.uint8))
    return Block(ids=b["ids"], bins=tables, targets=b["targets"], members=b["members"], forecasts=np.tile(start, (len(b["ids"]), 1)))


# --- gradients ---------------------------------------------------------------------------


def gradients(objective: str, residual: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """Gradient and curvature of the loss at forecasts that miss by `residual`; None stands for ones."""
    if objective == "squared":
        return -residual, None
    if objective == "absolute":
        return -np.sign(residual), None
    if objective == "quantile":
        return np.where(residual > 0, -p["quantile"], 1.0 - p["quantile"]), None
    root = np.sqrt(1.0 + (residual / p["huber_slope"]) ** 2)
    return -residual / root, root**-3


def selects(objective: str) -> bool:
    """Whether leaves take a quantile of their residuals instead of a regularised sum."""
    return objective in ("absolute", "quantile")


def mixed(x: np.ndarray, seed: int, number: int) -> np.ndarray:
    """Row ids scrambled to uniform 64-bit numbers."""
    golden = (0x9E3779B97F4A7C15 * (2 * (seed * 1_000_003 + number) + 1)) % 2**64
    with np.errstate(over="ignore"):
        z = x + np.uint64(golden)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def drawn(b: Block, fit: Fit, number: int) -> np.ndarray:
    """Rows of the training set that a round sees."""
    inside = b["members"][:, fit.member]
    share = fit.params["subsample"]
    if share < 1.0:
        inside = inside & (mixed(b["ids"], fit.seed, number) < np.uint64(int(share * 2.0**64)))
    return np.flatnonzero(inside)


def columns_of(fit: Fit, number: int) -> np.ndarray:
    """Columns a tree may split on."""
    keep = max(1, int(len(fit.columns) * fit.params["columns"] + 1e-9))
    if keep == len(fit.columns):
        return np.array(fit.columns)
    return np.array(sorted(random.Random(f"{fit.seed}/{number}").sample(fit.columns, keep)))


# --- what runs on the blocks -------------------------------------------------------------


@dataclass
class Shape:
    """A tree as the blocks need it."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def at(self, bins: np.ndarray) -> np.ndarray:
        """The node that every row reaches."""
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while (inner := self.feature[node] >= 0).any():
            down = np.where(bins[rows, np.maximum(self.feature[node], 0)] <= self.bin[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)
        return node


def shape(nodes: Sequence[Node]) -> Shape:
    return Shape(*(np.array([getattr(n, k) for n in nodes], dtype=np.int64) for k in ("feature", "bin", "left", "right")))


@dataclass
class Ask:
    """Nodes of a growing tree that the next pass counts, and what the judge of their sums must know."""

    tree: Shape
    nodes: list[int]
    columns: np.ndarray
    kin: list[tuple[int, int] | None]  # sibling and parent of each node, none of the root
    totals: dict[int, tuple[float, float, float]]  # gradient, curvature and rows of nodes and siblings, but for the root


def histograms(b: Block, fits: Sequence[Fit], number: int, asked: dict[int, Ask]) -> dict[int, np.ndarray]:
    """{model: sums of gradient, curvature and rows by (node, column, bin)} for the nodes asked of each model."""
    out = {}
    for m, ask in asked.items():
        fit, tree, nodes, columns = fits[m], ask.tree, ask.nodes, ask.columns
        rows = drawn(b, fit, number)
        bins = b["bins"][fit.member][rows]
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        place = slot[tree.at(bins)]
        rows, bins, place = rows[place >= 0], bins[place >= 0], place[place >= 0]
        g, h = gradients(fit.objective, b["targets"][rows, fit.target] - b["forecasts"][rows, m], fit.params)
        at = ((place[:, None] * len(columns) + np.arange(len(columns))) * BINS + bins[:, columns]).ravel()
        size = len(nodes) * len(columns) * BINS
        count = np.bincount(at, minlength=size).astype(float)
        sums = [np.bincount(at, np.repeat(g, len(columns)), size), count if h is None else np.bincount(at, np.repeat(h, len(columns)), size), count]
        out[m] = np.stack(sums).reshape(3, len(nodes), len(columns), BINS)
    return out


def _added(a: dict, b: dict) -> dict:
    return {m: a[m] + v for m, v in b.items()}


def _parts(at: int, blocks: Iterator[Block], count) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((model, partition), sums) of one partition."""
    for sums in selection.within(count, _added, blocks):
        yield from (((m, at), s) for m, s in sums.items())


def _by_model(key: tuple[int, int], width: int) -> int:
    return key[0] % width


def _summed(parts: Iterator[tuple[tuple[int, int], np.ndarray]]) -> list[dict[int, np.ndarray]]:
    """Parts come sorted, so sums are the same in every run."""
    out: dict[int, np.ndarray] = {}
    for (m, _), s in parts:
        out[m] = out[m] + s if m in out else s
    return [out]


def best_split(sums: np.ndarray, total: Sequence[float], fit: Fit, columns: np.ndarray) -> tuple | None:
    """(gain, feature, bin, sums of the left side) of a node's best split, if any is worth it."""
    p = fit.params
    left = sums.cumsum(axis=2)
    total = np.array(total)[:, None, None]
    right = total - left
    score = lambda s: s[0] ** 2 / (s[1] + p["penalty"])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left) + score(right) - score(total)
    fits = (left[1] >= p["min_rows"]) & (right[1] >= p["min_rows"]) & (left[2] > 0.5) & (right[2] > 0.5)
    gain = np.where(fits & np.isfinite(gain), gain, -np.inf)
    column, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[column, cut] > LEAST_GAIN:
        return None
    return float(gain[column, cut]), int(columns[column]), int(cut), tuple(map(float, left[:, column, cut]))


def _judged(both: tuple[dict[int, np.ndarray], tuple[dict, dict]], fits: Sequence[Fit], asked: dict[int, Ask]) -> tuple[dict, dict]:
    """({model: {node: sums}} that later passes subtract from, {model: [(node, its totals, its best split)]})."""
    found, (kept, _) = both
    kept, told = dict(kept), {}
    for m, sums in found.items():
        ask, own, told[m] = asked[m], dict(kept.get(m, {})), []
        for slot, k in enumerate(ask.nodes):
            here = {k: sums[:, slot]}
            if ask.kin[slot] is not None:
                sibling, parent = ask.kin[slot]
                here[sibling] = own.pop(parent) - here[k]
            for node, s in here.items():
                total = ask.totals[node] if node else tuple(map(float, s[:, 0].sum(axis=1)))
                best = best_split(s, total, fits[m], ask.columns)
                told[m].append((node, total, best))
                if best:
                    own[node] = s
        kept[m] = own
    return kept, told


def _first(found: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], tuple[dict, dict]]:
    return found, ({}, {})


def _splits(judged: tuple[dict, dict]) -> dict:
    return judged[1]


def judged(state: RDD, fits: Sequence[Fit], number: int, asked: dict[int, Ask], before: RDD | None) -> tuple[RDD, dict[int, list]]:
    """What tasks keep for the next pass of this round, and {model: [(node, totals, best split)]}."""
    parts = state.mapPartitionsWithIndex(partial(_parts, count=partial(histograms, fits=fits, number=number, asked=asked)))
    if state.getNumPartitions() > 1:
        width = min(len(fits), state.context.defaultParallelism, -(-len(fits) * state.getNumPartitions() // SUMS))
        parts = parts.repartitionAndSortWithinPartitions(width, partial(_by_model, width=width))
    sums = parts.mapPartitions(_summed)
    pairs = sums.map(_first) if before is None else sums.zip(before)  # one element a partition on either side
    after = pairs.map(partial(_judged, fits=fits, asked=asked)).persist(StorageLevel.MEMORY_AND_DISK)
    told = {m: found for d in after.map(_splits).collect() for m, found in d.items()}  # one split a node
    if len(told) < len(asked):
        raise ValueError("no training rows")
    if before is not None:
        before.unpersist()
    return after, told


def _updated(b: Block, members: list[int], steps: dict[int, tuple[Shape, np.ndarray]]) -> Block:
    forecasts = b["forecasts"].copy()
    for m, (tree, values) in steps.items():
        forecasts[:, m] += values[tree.at(b["bins"][members[m]])]
    return b | {"forecasts": forecasts}


def _each(change, blocks: Iterator[Block]) -> Iterator[Block]:
    return map(change, blocks)


def _leaf_residuals(b: Block, fits: Sequence[Fit], number: int, trees: dict[int, Shape]) -> dict[tuple[int, int], np.ndarray]:
    out = {}
    for m, tree in trees.items():
        rows = drawn(b, fits[m], number)
        leaf = tree.at(b["bins"][fits[m].member][rows])
        residual = b["targets"][rows, fits[m].target] - b["forecasts"][rows, m]
        out |= {(m, int(k)): residual[leaf == k] for k in np.unique(leaf)}
    return out


# --- growing one tree: the driver holds its nodes, not their sums -------------------------


@dataclass
class Growth:
    """A tree while it grows: by levels to a depth, or best leaf first to a number of leaves."""

    fit: Fit
    columns: np.ndarray
    nodes: list[Node] = field(default_factory=lambda: [Node(0.0, 0.0, 0.0, 0)])
    asked: list[int] = field(default_factory=lambda: [0])  # nodes whose sums the next pass takes
    queue: list[tuple[float, int]] = field(default_factory=list)
    taken: set[int] = field(default_factory=set)  # nodes that are split in the final tree

    def ask(self) -> Ask:
        kin, totals = [], {}
        for k in self.asked:
            at = self.nodes[k].parent
            pair = None if k == 0 else (self.nodes[at].left, self.nodes[at].right)
            kin.append(None if k == 0 else (pair[0] + pair[1] - k, at))
            totals |= {c: (self.nodes[c].gradient, self.nodes[c].curvature, self.nodes[c].rows) for c in pair or ()}
        return Ask(shape(self.nodes), self.asked, self.columns, kin, totals)

    def learn(self, found: Sequence[tuple]) -> None:
        """Take the splits of the nodes asked for and of their siblings, and go as far as they allow."""
        for k, total, best in found:
            node = self.nodes[k]
            node.judged, node.best = True, best
            if k == 0:
                node.gradient, node.curvature, node.rows = total
            if best and (k == 0 or node.parent in self.taken):
                heapq.heappush(self.queue, (-best[0], k))
        self.asked = []
        self._go_on()

    def _take(self, k: int) -> None:
        """Split a leaf for good; children that are judged may be next."""
        self.taken.add(k)
        for c in (self.nodes[k].left, self.nodes[k].right):
            if self.nodes[c].best:
                heapq.heappush(self.queue, (-self.nodes[c].best[0], c))

    def _split(self, k: int) -> None:
        node = self.nodes[k]
        node.gain, node.feature, node.bin, left = node.best
        right = np.array([node.gradient, node.curvature, node.rows]) - left
        for side, sums in (("left", left), ("right", right)):
            setattr(node, side, len(self.nodes))
            self.nodes.append(Node(*map(float, sums), node.depth + 1, k))

    def _go_on(self) -> None:
        p = self.fit.params
        leaves = p.get("leaves")
        last = (p.get("depth") or math.inf) - 1  # children of this level need no sums
        while self.queue and (leaves is None or len(self.taken) + 1 < leaves):
            gain, k = heapq.heappop(self.queue)
            node = self.nodes[k]
            if node.left < 0:
                self._split(k)
            pair = [node.left, node.right]
            judged = self.nodes[node.left].judged
            if leaves is None or node.depth >= last or judged:
                self._take(k)
                if not judged and node.depth < last:
                    self.asked.append(min(pair, key=lambda c: self.nodes[c].rows))
                continue
            # Best first: the children must be judged before the next leaf is chosen. All leaves
            # that may be next are split on trial, so that one pass serves them all.
            heapq.heappush(self.queue, (gain, k))
            for _, c in self.queue:
                if self.nodes[c].left < 0:
                    self._split(c)
                pair = [self.nodes[c].left, self.nodes[c].right]
                if self.nodes[c].depth < last and not self.nodes[pair[0]].judged:
                    self.asked.append(min(pair, key=lambda x: self.nodes[x].rows))
            return

    def tree(self) -> list[Node]:
        """The nodes of the final tree, depth first; trial splits are undone."""
        out: list[Node] = []

        def copy(k: int) -> int:
            at, n = len(out), self.nodes[k]
            out.append(Node(n.gradient, n.curvature, n.rows, n.depth))
            if k in self.taken:
                out[at].feature, out[at].bin, out[at].gain = n.feature, n.bin, n.gain
                out[at].left, out[at].right = copy(n.left), copy(n.right)
            return at

        copy(0)
        return out


# --- growing ensembles ---------------------------------------------------------------------


@dataclass
class Grown:
    """What one fit found: the starting forecast and its trees as parallel arrays."""

    base: float
    trees: list[dict]


def _bases(raw: RDD, fits: Sequence[Fit]) -> np.ndarray:
    """Starting forecasts: 0 if centred, else the mean, median or quantile of the targets."""
    start = np.zeros(len(fits))
    means = [m for m, f in enumerate(fits) if not f.centred and f.objective == "squared"]
    others = [m for m, f in enumerate(fits) if not f.centred and f.objective != "squared"]
    own = lambda b, m: b["targets"][b["members"][:, fits[m].member], fits[m].target]
    if means:
        sums = selection.gathered(raw, lambda b: np.array([(own(b, m).sum(), len(own(b, m))) for m in means]), np.add)
        start[means] = sums[:, 0] / np.maximum(sums[:, 1], 1)
    if others:
        got = selection.quantiles(raw, lambda b: {m: own(b, m) for m in others}, lambda m: (fits[m].params.get("quantile", 0.5),), len(others))
        start[others] = [got.get(m, [0.0])[0] for m in others]
    return start


def _level(fits: Sequence[Fit], group: tuple[int, int]) -> tuple[float]:
    return (fits[group[0]].params.get("quantile", 0.5),)


def _leaf_values(fits: Sequence[Fit], finals: dict[int, list[Node]], selected: Callable[[dict[int, Shape]], dict]) -> dict[int, np.ndarray]:
    """The step of every leaf, already shortened by the learning rate; 0 at inner nodes.

    selected(trees) gives {(model, leaf): [quantile of its residuals]} of leaves with rows.
    """
    out = {}
    for m, nodes in finals.items():
        p = fits[m].params
        out[m] = np.array([0.0 if n.feature >= 0 else -n.gradient / (n.curvature + p["penalty"]) if n.rows else 0.0 for n in nodes])
    chosen = {m: shape(nodes) for m, nodes in finals.items() if selects(fits[m].objective)}
    if chosen:
        got = selected(chosen)
        for m, tree in chosen.items():
            out[m] = np.array([got.get((m, k), [0.0])[0] if f < 0 else 0.0 for k, f in enumerate(tree.feature)])
    return {m: v * fits[m].params["learning_rate"] for m, v in out.items()}


def _selected(trees: dict[int, Shape], state: RDD, fits: Sequence[Fit], number: int) -> dict:
    leaves = sum(int((tree.feature < 0).sum()) for tree in trees.values())
    return selection.quantiles(state, partial(_leaf_residuals, fits=fits, number=number, trees=trees), partial(_level, fits), leaves)


def grown(df: DataFrame, features: int, sets: int, fits: Sequence[Fit]) -> tuple[np.ndarray, list[Grown]]:
    """Medians per training set and feature, and an ensemble per fit. See blocks_of for df."""
    level = StorageLevel.MEMORY_AND_DISK
    raw = blocks_of(df, len(fits)).persist(level)
    fill = fills(raw, features, sets)
    if not fits:
        raw.unpersist()
        return fill, []
    cuts = edges(raw, features, sets, fill)
    start = _bases(raw, fits)
    if max(f.params["rounds"] for f in fits) >= FEW and raw.map(_rows).sum() * features <= WHOLE:
        out = _grown_apart(raw, fits, cuts, fill, start)
        raw.unpersist()
        return fill, out
    state = raw.mapPartitions(partial(_each, partial(_binned, cuts=cuts, fill=fill, start=start))).persist(level)
    members = [f.member for f in fits]
    old, out, steps = raw, [Grown(float(s), []) for s in start], {}
    for number in range(max(f.params["rounds"] for f in fits)):
        if steps:
            old, state = state, state.mapPartitions(partial(_each, partial(_updated, members=members, steps=steps))).persist(level)
            if number % CHECKPOINT_EVERY == 0:
                state.checkpoint()
        growths = {m: Growth(f, columns_of(f, number)) for m, f in enumerate(fits) if number < f.params["rounds"]}
        kept = None
        while asked := {m: g.ask() for m, g in growths.items() if g.asked}:
            kept, found = judged(state, fits, number, asked, kept)
            for m, splits in found.items():
                growths[m].learn(splits)
            if old is not None:
                old.unpersist()
                old = None
        if kept is not None:
            kept.unpersist()
        finals = {m: g.tree() for m, g in growths.items()}
        values = _leaf_values(fits, finals, partial(_selected, state=state, fits=fits, number=number))
        steps = {m: (shape(nodes), values[m]) for m, nodes in finals.items()}
        for m, nodes in finals.items():
            out[m].trees.append(_arrays(nodes, values[m], fits[m], cuts[fits[m].member]))
    state.unpersist()
    return fill, out


# --- growing every model in a task of its own ------------------------------------------------


def _rows(b: Block) -> int:
    return len(b["ids"])


def _copies(at: int, blocks: Iterator[Block], fits: Sequence[Fit], cuts: list, fill: np.ndarray, start: np.ndarray) -> Iterator[tuple[tuple[int, int, int], Block]]:
    """((model, partition, block), its rows of the training set) for every model."""
    for k, b in enumerate(blocks):
        b = _binned(b, cuts, fill, start)
        for m, f in enumerate(fits):
            rows = np.flatnonzero(b["members"][:, f.member])
            own = Block(dealt=len(b["ids"]), ids=b["ids"][rows], bins=[b["bins"][f.member][rows]], targets=b["targets"][rows, f.target][:, None])
            yield (m, at, k), own | {"members": np.ones((len(rows), 1), dtype=bool), "forecasts": b["forecasts"][rows, m][:, None]}


def _joined(blocks: list[Block]) -> Block:
    """One block of a model's many small ones."""
    whole = Block({k: np.concatenate([b[k] for b in blocks]) for k in ("ids", "targets", "members", "forecasts")})
    return whole | {"bins": [np.concatenate([b["bins"][0] for b in blocks])]}


def _model(key: tuple[int, int, int]) -> int:
    return key[0]


def _selected_here(trees: dict[int, Shape], parts: list[list[Block]], fits: Sequence[Fit], number: int) -> dict:
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for b in (b for blocks in parts for b in blocks):
        for leaf, x in _leaf_residuals(b, fits, number, trees).items():
            found.setdefault(leaf, []).append(x)
    return {leaf: [selection.quantile(np.concatenate(x), _level(fits, leaf)[0])] for leaf, x in found.items()}


def _alone(parts: list[list[Block]], fit: Fit, cuts: list[np.ndarray]) -> list[dict]:
    """All trees of one model, from blocks by partition."""
    one, out = [replace(fit, target=0, member=0)], []
    for number in range(fit.params["rounds"]):
        growth, kept = Growth(fit, columns_of(fit, number)), {}
        while growth.asked:
            asked = {0: growth.ask()}
            count = partial(histograms, fits=one, number=number, asked=asked)
            (sums,) = _summed(s for at, blocks in enumerate(parts) for s in _parts(at, iter(blocks), count))
            kept, told = _judged((sums, (kept, {})), one, asked)
            growth.learn(told[0])
        nodes = growth.tree()
        values = _leaf_values(one, {0: nodes}, partial(_selected_here, parts=parts, fits=one, number=number))[0]
        step = {0: (shape(nodes), values)}
        parts = [[_updated(b, [0], step) for b in blocks] for blocks in parts]
        out.append(_arrays(nodes, values, fit, cuts))
    return out


def _each_alone(copies: Iterator[tuple[tuple[int, int, int], Block]], fits: Sequence[Fit], cuts: list) -> Iterator[tuple[int, list[dict]]]:
    """(model, trees) of the models whose copies come here, sorted by model, partition and block."""
    for m, own in groupby(copies, lambda c: c[0][0]):
        parts = [[b for _, b in some] for _, some in groupby(own, lambda c: c[0][1])]
        if sum(b["dealt"] for blocks in parts for b in blocks) < TINY * len(parts):
            parts = [[_joined([b for blocks in parts for b in blocks])]]
        yield m, _alone(parts, fits[m], cuts[fits[m].member])


def _grown_apart(raw: RDD, fits: Sequence[Fit], cuts: list, fill: np.ndarray, start: np.ndarray) -> list[Grown]:
    """An ensemble per fit, each from a task that holds all its training rows."""
    copies = raw.mapPartitionsWithIndex(partial(_copies, fits=fits, cuts=cuts, fill=fill, start=start))
    dealt = copies.repartitionAndSortWithinPartitions(len(fits), _model)
    found = dict(dealt.mapPartitions(partial(_each_alone, fits=fits, cuts=cuts)).collect())  # the models themselves
    if len(found) < len(fits):
        raise ValueError("no training rows")
    return [Grown(float(start[m]), found[m]) for m in range(len(fits))]


def _arrays(nodes: list[Node], steps: np.ndarray, fit: Fit, cuts: list[np.ndarray]) -> dict:
    place = {f: i for i, f in enumerate(fit.columns)}
    return {
        "feature": [place[n.feature] if n.feature >= 0 else -1 for n in nodes],
        "threshold": [float(cuts[n.feature][n.bin]) if n.feature >= 0 else 0.0 for n in nodes],
        "left": [n.left for n in nodes],
        "right": [n.right for n in nodes],
        "value": [float(v) / fit.params["learning_rate"] for v in steps],
        "cover": [float(n.rows) for n in nodes],
        "gain": [float(n.gain) for n in nodes],
        "weight": float(fit.params["learning_rate"]),
    }
