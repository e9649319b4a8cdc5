"""Isolation forest as Spark jobs.

Each tree needs only a small random subset of all rows of its scope. Rows are thinned by
hash thresholds, first to as many as all trees draw together, then per tree, and ranked
within the tree; every row has the same chance in every tree. Trees grow in parallel.
Scoring sends points and scopes through Arrow where the forest is small enough to
broadcast, and brings rows and trees together in bounded salted groups where it is not.
A NULL scope is a scope like any other. Missing values take the scope's median from a
sketch whose rank is off by at most a ten-thousandth of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import finite, ratio
from peerscreen.operators import decide, ordering

BROADCAST_NODES = 2_000_000
ROWS_PER_GROUP = 50_000
TREES_PER_CALL = 10
UNIT = float(2**31)


def _fraction(*columns) -> Column:
    """Repeatable uniform number in [0, 1) from a row's identity."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**31)) / UNIT


def average_path(n):
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    return np.where(big, 2.0 * (np.log(np.maximum(n, 2) - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1), out)


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One isolation tree as parallel node arrays; leaves carry their path length."""
    depth_limit = int(np.ceil(np.log2(max(len(x), 2))))
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}

    def add() -> int:
        for key, empty in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("path", 0.0)):
            tree[key].append(empty)
        return len(tree["path"]) - 1

    # A tree over n points has fewer than n inner nodes.
    draws = iter(rng.random((len(x) + 1, 2)).tolist())
    pending = [(add(), np.arange(len(x)), 0)]
    while pending:
        node, rows, depth = pending.pop()
        here = x[rows]
        low, high = here.min(axis=0), here.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not len(open_features):
            tree["path"][node] = float(depth + average_path(len(rows)))
            continue
        pick, place = next(draws)
        f = int(open_features[int(pick * len(open_features))])
        cut = float(low[f] + place * (high[f] - low[f]))
        if cut >= high[f]:  # neighbouring floats: keep both sides filled
            cut = float(low[f])
        goes_left = here[:, f] <= cut
        left, right = add(), add()
        tree["feature"][node], tree["threshold"][node] = f, cut
        tree["left"][node], tree["right"][node] = left, right
        pending += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return tree


def path_lengths(x: np.ndarray, trees: pd.DataFrame) -> np.ndarray:
    """Mean path length over the trees, all rows at once per tree level."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees.itertuples(index=False):
        feature, cut = np.asarray(t.feature), np.asarray(t.threshold)
        left, right, path = np.asarray(t.left), np.asarray(t.right), np.asarray(t.path)
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[rows, np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        total += path[at]
    return total / max(len(trees), 1)


@dataclass
class IsolationModel:
    """Trees, imputation medians and training scores, one set per value of ``keys``."""

    keys: list[str]
    columns: list[str]
    forest: DataFrame
    medians: DataFrame
    train_scores: DataFrame | None = None

    def raw_scores(self, features: DataFrame) -> DataFrame:
        """Add ``isolation_score`` (higher = easier to isolate); rows of unknown scopes get NULL."""
        return _score(features, self)

    def thresholds(self, contaminations: Sequence[float], *, hot: bool | None = None) -> DataFrame:
        """keys + contamination + the training score above which a row is flagged."""
        out = None
        for c in contaminations:
            one = ordering.group_percentile(
                self.train_scores, self.keys, "isolation_score", 1.0 - c, "score_cut", hot=hot
            ).withColumn("contamination", F.lit(float(c))).drop("n")
            out = one if out is None else out.unionByName(one)
        return out

    def score(
        self,
        features: DataFrame,
        *,
        contamination: float | Sequence[float] = 0.1,
        robust_threshold: float = S.ROBUST_THRESHOLD,
        hot: bool | None = None,
    ) -> DataFrame:
        """Robust and model scores combined, with reasons.

        Several contaminations give one row set per value (column ``contamination``).
        """
        many = [contamination] if isinstance(contamination, (int, float)) else list(contamination)
        if not all(0 < c < 0.5 for c in many):
            raise ValueError("contamination must be between 0 and 0.5")
        if hot is None:
            hot = ordering.has_hot_group(features, self.keys) or ordering.has_hot_group(self.train_scores, self.keys)
        raw = ordering.stable(self.raw_scores(features)) if hot else self.raw_scores(features)
        placed = _training_share(raw, self.train_scores, self.keys, hot=hot)
        cuts = self.thresholds(many, hot=hot)
        # Rows of a scope without a forest stay, with NULL model columns.
        if not self.keys:
            joined = placed.crossJoin(cuts)
        else:
            joined = (ordering.salted_join if hot else ordering.null_safe_join)(placed, cuts, self.keys)
        c = F.col("contamination")
        width = F.greatest(c / 3.0, F.lit(0.01))
        joined = joined.withColumns(
            {
                "model_anomaly_score": 1.0 / (1.0 + F.exp(-(F.col("_share") - (1.0 - c)) / width)),
                "is_model_anomaly": F.col("isolation_score") > F.col("score_cut"),
            }
        ).drop("_share", "score_cut")
        return decide.combine_scores(decide.apply_robust_baseline(joined, threshold=robust_threshold))


@dataclass(frozen=True)
class PeerAnomalyDetector:
    """Settings of a pooled detector: ``fit`` gives the model, ``fit_score`` scores its own rows."""

    contamination: float = 0.1
    robust_threshold: float = S.ROBUST_THRESHOLD
    seed: int = 42

    def __post_init__(self):
        if not 0 < self.contamination < 0.5:
            raise ValueError("contamination must be between 0 and 0.5")

    def fit(self, reference: DataFrame) -> IsolationModel:
        return fit(reference, seed=self.seed)

    def score(self, model: IsolationModel, features: DataFrame) -> DataFrame:
        return model.score(features, contamination=self.contamination, robust_threshold=self.robust_threshold)

    def fit_score(self, features: DataFrame) -> DataFrame:
        features = ordering.stable(features)
        return self.score(self.fit(features), features)


def fit(
    train: DataFrame,
    *,
    keys: Sequence[str] = (),
    columns: Sequence[str] = tuple(S.MODEL_FEATURES),
    n_trees: int = 250,
    sample: int = 256,
    seed: int = 42,
    minimum_rows: int = 8,
) -> IsolationModel:
    """Fit one forest per value of ``keys`` (none: a single pooled forest).

    Scopes with fewer than ``minimum_rows`` training rows get no forest.
    """
    keys, columns = list(keys), list(columns)
    train = train.select(*dict.fromkeys([*keys, *S.KEY4, "as_of_hour"]), *[finite(c).alias(c) for c in columns])
    # One row per scope: bounded sketches for the medians, and the size.
    facts = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.coalesce(F.percentile_approx(c, 0.5, 10_000), F.lit(0.0)).alias(f"_med_{c}") for c in columns],
    ).filter(F.col("_n") >= minimum_rows)
    facts = ordering.stable(facts)
    if not keys and facts.isEmpty():
        raise ValueError("at least eight reference components are required")
    identity = [F.col(c) for c in [*S.KEY4, "as_of_hour"]]
    joined = ordering.null_safe_join(train, facts, keys, "inner") if keys else train.crossJoin(facts)
    # Half more than the sample (over six standard deviations) per tree, before ranking,
    # so little is shuffled.
    drawn = 1.5 * sample
    pool = joined.filter(_fraction(*identity, F.lit(seed)) < F.lit(n_trees * drawn) / F.col("_n"))
    point = F.array(*[F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in columns])
    pool = pool.select(*keys, "_n", F.xxhash64(*identity).alias("_id"), point.alias("_x"))
    pool_size = F.least(F.col("_n").cast("double"), F.lit(n_trees * drawn))
    draws = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(t.alias("_tree"), _fraction(F.col("_id"), t, F.lit(seed)).alias("_u")))
    hits = F.filter(draws, lambda d: d["_u"] < F.lit(drawn) / pool_size)
    thinned = pool.select("*", F.inline(hits))
    # A Python call serves a bundle of trees; ranking and growing share one exchange.
    thinned = thinned.withColumn("_bundle", F.floor(F.col("_tree") / TREES_PER_CALL)).repartition(*keys, "_bundle")
    w = Window.partitionBy(*keys, "_bundle", "_tree").orderBy("_u", "_id")
    chosen = thinned.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample).drop("_u")

    key_types = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    head = "".join(f"`{k}` {key_types[k]}, " for k in keys)
    shape = head + (
        "_tree int, n_sample int, feature array<int>, threshold array<double>, "
        "left array<int>, right array<int>, path array<double>"
    )

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        first = {k: rows[k].iloc[0] for k in keys}
        order = np.lexsort((rows["_id"].to_numpy(), rows["_tree"].to_numpy()))
        numbers, points = rows["_tree"].to_numpy()[order], np.vstack(rows["_x"].to_numpy()[order])
        grown = []
        for number in np.unique(numbers):
            x = points[numbers == number]
            tree = grow_tree(x, np.random.default_rng([seed, int(number)]))
            grown.append({**first, "_tree": int(number), "n_sample": len(x), **tree})
        return pd.DataFrame(grown)

    forest = ordering.stable(chosen.groupBy(*keys, "_bundle").applyInPandas(grow, shape))
    medians = facts.select(*keys, *[F.col(f"_med_{c}").alias(c) for c in columns])
    model = IsolationModel(keys, columns, forest, medians)
    model.train_scores = ordering.stable(
        model.raw_scores(train).filter(F.col("isolation_score").isNotNull()).select(*keys, "isolation_score")
    )
    return model


def _score(features: DataFrame, model: IsolationModel) -> DataFrame:
    keys, columns = model.keys, model.columns
    medians = model.medians.select(*keys, *[F.col(c).alias(f"_med_{c}") for c in columns])
    joined = ordering.null_safe_join(features, medians, keys) if keys else features.crossJoin(medians)
    point = F.array(*[F.coalesce(finite(c), F.col(f"_med_{c}")) for c in columns])
    rows = joined.withColumn("_x", point).drop(*[f"_med_{c}" for c in columns])
    nodes = model.forest.agg(F.sum(F.size("path")).alias("n")).first()["n"] or 0
    if nodes <= BROADCAST_NODES:
        return _score_in_place(rows, model)
    return _score_in_groups(rows, model)


def _as_score(x: np.ndarray, trees: pd.DataFrame) -> np.ndarray:
    return np.power(2.0, -path_lengths(x, trees) / float(average_path(trees["n_sample"].max())))


def _score_in_place(rows: DataFrame, model: IsolationModel) -> DataFrame:
    """The node count was checked, so the forest travels as a broadcast variable."""
    scope = F.to_json(F.struct(*model.keys)) if model.keys else F.lit("")
    trees = model.forest.withColumn("_scope", scope).orderBy("_scope", "_tree").toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(dict(list(trees.groupby("_scope"))))

    @F.pandas_udf("double")
    def score(points: pd.Series, scopes: pd.Series) -> pd.Series:
        out = np.full(len(points), np.nan)
        for key, at in scopes.groupby(scopes).indices.items():
            if key in shared.value:
                out[at] = _as_score(np.vstack(points.to_numpy()[at]), shared.value[key])
        return pd.Series(out)

    return rows.withColumn("isolation_score", finite(score("_x", scope))).drop("_x")


def _packed(forest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per scope: its trees in flat arrays, and where each tree begins."""
    arrays = ["feature", "threshold", "left", "right", "path"]
    trees = forest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_tree", *arrays, "n_sample"))).alias("_t"))
    sizes = F.transform("_t.path", lambda path: F.size(path))
    begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    flat = [F.flatten(F.col(f"_t.{c}")).alias(c) for c in arrays]
    return trees.select(*keys, begins.alias("begins"), F.array_max("_t.n_sample").alias("n_sample"), *flat)


def _unpacked(scope) -> pd.DataFrame:
    """The trees of a packed scope as views of its arrays."""
    begins = np.asarray(scope.begins)
    parts = {c: np.split(np.asarray(getattr(scope, c)), begins[1:-1]) for c in ("feature", "threshold", "left", "right", "path")}
    return pd.DataFrame(parts).assign(n_sample=scope.n_sample)


def _score_in_groups(rows: DataFrame, model: IsolationModel) -> DataFrame:
    """Distinct points and packed trees meet in groups of about ROWS_PER_GROUP points; the scores join rows by point.

    Python sees scopes and points alone; all other columns stay where they are.
    """
    keys = model.keys
    at = [*keys, "_x"]
    points = ordering.stable(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_rows")))
    hot = not points.filter(F.col("_rows") > ordering.hot_rows(rows.sparkSession)).isEmpty()
    points = points.drop("_rows")
    sizes = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_GROUP).cast("int").alias("_salts"))
    attach = lambda df: ordering.null_safe_join(df, sizes, keys, "inner") if keys else df.crossJoin(sizes)
    spread = attach(points).withColumn("_salt", F.pmod(F.xxhash64("_x"), F.col("_salts")).cast("int")).drop("_salts")
    copies = attach(_packed(model.forest, keys)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    schema = points.schema.add("isolation_score", "double")

    def score(batch: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame(columns=schema.names)
        out = _as_score(np.vstack(batch["_x"].to_numpy()), _unpacked(trees.iloc[0])) if len(trees) else np.nan
        return batch.drop(columns="_salt").assign(isolation_score=out)

    group = [*keys, "_salt"]
    scored = spread.groupBy(*group).cogroup(copies.groupBy(*group)).applyInPandas(score, schema)
    scored = scored.withColumn("isolation_score", finite("isolation_score"))
    return (ordering.salted_join if hot else ordering.null_safe_join)(rows, scored, at).drop("_x")


def _training_share(rows: DataFrame, train_scores: DataFrame, keys: Sequence[str], *, hot: bool) -> DataFrame:
    """Add ``_share``: part of the training scores at or below the row's score; NULL for NULL scores."""
    keys, s = list(keys), "isolation_score"
    both = train_scores.select(*keys, s, F.lit(1).cast("bigint").alias("_w")).unionByName(
        rows.select(*keys, s, F.lit(0).cast("bigint").alias("_w"))
    )
    # Distinct scores are summed up, never the wide rows.
    totals = ordering.running_totals(both, keys, s, F.col("_w"), hot=hot)
    share = totals.select(*keys, s, ratio(F.col("before") + F.col("weight"), F.col("total")).alias("_share"))
    return (ordering.salted_join if hot else ordering.null_safe_join)(rows, share, [*keys, s])
