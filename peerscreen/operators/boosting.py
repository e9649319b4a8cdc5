"""Learned forecasts: ridge on Spark ML and boosted trees, scored from small tree tables.

Boosted trees of all configurations, training sets and seeds asked for are grown together
(operators/trees.py). A fitted ensemble is a few thousand nodes, so scoring evaluates it in
Arrow batches where the rows lie: no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from peerscreen import schema as S
from peerscreen.functions.columns import finite
from peerscreen.operators import forecast, ordering, selection, trees

OBJECTIVES = ["squared", "absolute", "pseudo_huber", "quantile"]

# --- fixed values: hyperparameters of the published candidates -------------------
BOOST_PARAMS = {
    "rounds": 350,
    "depth": 3,
    "learning_rate": 0.04,
    "min_rows": 12,
    "subsample": 0.9,
    "columns": 0.9,
    "penalty": 10.0,
}
HIST_PARAMS = {"rounds": 250, "depth": None, "leaves": 15, "learning_rate": 0.07, "min_rows": 20, "subsample": 1.0, "columns": 1.0, "penalty": 5.0}
RIDGE_PENALTY = 10.0
HUBER_SLOPE = 0.05
# --- end of fixed values -----------------------------------------------------------


@dataclass(frozen=True)
class CandidateConfig:
    """One forecasting configuration."""

    name: str
    model: str  # persistence | linear_extrapolation | ridge | boosted
    target: str = "normalized"
    feature_set: str = "leakage_only"
    objective: str | None = None
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.model not in (*forecast.BASELINES, "ridge", "boosted"):
            raise ValueError(f"unknown model family {self.model}")
        if self.target not in forecast.TARGETS:
            raise ValueError(f"unknown target {self.target}")
        if self.feature_set not in S.FEATURE_SETS:
            raise ValueError(f"unknown feature set {self.feature_set}")
        if self.model == "boosted" and self.objective not in OBJECTIVES:
            raise ValueError("boosted configurations need an objective")

    @property
    def feature_columns(self) -> list[str]:
        return list(S.FEATURE_SETS[self.feature_set])


# --- fixed values: the published comparison ------------------------------------------
COMPARISON = [
    CandidateConfig("persistence", "persistence"),
    CandidateConfig("linear_extrapolation", "linear_extrapolation"),
    CandidateConfig("xgb_v1_replica", "boosted", "normalized", "v1_all", "squared"),
    CandidateConfig("xgb_sq_norm_leak", "boosted", "normalized", "leakage_only", "squared"),
    CandidateConfig("xgb_sq_resid_leak", "boosted", "residual_over_persistence", "leakage_only", "squared"),
    CandidateConfig("xgb_abs_norm_leak", "boosted", "normalized", "leakage_only", "absolute"),
    CandidateConfig("xgb_abs_resid_leak", "boosted", "residual_over_persistence", "leakage_only", "absolute"),
    CandidateConfig("xgb_huber_resid_leak", "boosted", "residual_over_persistence", "leakage_only", "pseudo_huber"),
    CandidateConfig("xgb_sq_log1p_leak", "boosted", "log1p_normalized", "leakage_only", "squared"),
    CandidateConfig("xgb_sq_log1p_resid_leak", "boosted", "log1p_residual_over_persistence", "leakage_only", "squared"),
    CandidateConfig("xgb_abs_resid_aux", "boosted", "residual_over_persistence", "leakage_plus_aux", "absolute"),
    CandidateConfig("xgb_abs_resid_peer", "boosted", "residual_over_persistence", "leakage_plus_channel_peer", "absolute"),
]
FINAL = CandidateConfig("xgboost_v2", "boosted", "residual_over_persistence", "leakage_only", "absolute", {"gate": S.GATE_Z})
SQUARED = CandidateConfig("xgboost", "boosted", "normalized", "v1_all", "squared")
HIST = CandidateConfig("hist_gradient_boosting", "boosted", "normalized", "v1_all", "squared", HIST_PARAMS)
RIDGE = CandidateConfig("ridge", "ridge", "normalized", "v1_all")
# --- end of fixed values ---------------------------------------------------------------


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the exact median of every column, 0 for a column without values."""
    found = selection.column_quantiles(df, columns, [0.5])
    return df.sparkSession.createDataFrame([[found.get(c, [0.0])[0] for c in columns]], ", ".join(f"`{c}` double" for c in columns))


def features_array(columns: Sequence[str], fill: dict[str, float]) -> Column:
    return F.array(*[F.coalesce(finite(c), F.lit(float(fill[c]))) for c in columns])


# --- tree tables ----------------------------------------------------------------------


@dataclass
class Ensemble:
    """Weighted trees over a fixed feature order plus a constant."""

    columns: list[str]
    base: float
    trees: list[dict]  # feature, threshold, left, right, value, cover, gain, weight

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in self.trees:
            feature, cut = np.asarray(t["feature"]), np.asarray(t["threshold"])
            left, right = np.asarray(t["left"]), np.asarray(t["right"])
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                go_left = x[rows, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += t["weight"] * np.asarray(t["value"])[at]
        return total

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Exact path-dependent Shapley values; the last column is the bias.

        Works leaf by leaf: along one path only the split features matter (at
        most the tree depth), so their subsets are enumerated directly.
        """
        out = np.zeros((len(x), len(self.columns) + 1))
        out[:, -1] = self.base
        for t in self.trees:
            for value, path in _leaf_paths(t):
                weight = t["weight"] * value
                names = sorted(path)
                cold = {f: path[f]["share"] for f in names}
                warm = {}
                for f in names:
                    low, high = path[f]["low"], path[f]["high"]
                    warm[f] = ((x[:, f] > low) & (x[:, f] <= high)).astype(float)
                out[:, -1] += weight * math.prod(cold.values())
                m = len(names)
                for f in names:
                    others = [g for g in names if g != f]
                    total = np.zeros(len(x))
                    for mask in range(1 << len(others)):
                        chosen = [g for i, g in enumerate(others) if mask >> i & 1]
                        part = np.full(len(x), math.factorial(len(chosen)) * math.factorial(m - len(chosen) - 1) / math.factorial(m))
                        for g in others:
                            part = part * (warm[g] if g in chosen else cold[g])
                        total += part
                    out[:, f] += weight * total * (warm[f] - cold[f])
        return out

    def importance(self) -> dict[str, float]:
        """Mean gain of the splits of each feature, as shares of one."""
        gain, splits = dict.fromkeys(self.columns, 0.0), dict.fromkeys(self.columns, 0)
        for t in self.trees:
            for f, g in zip(t["feature"], t["gain"], strict=True):
                if f >= 0:
                    gain[self.columns[f]] += g
                    splits[self.columns[f]] += 1
        mean = {c: gain[c] / splits[c] if splits[c] else 0.0 for c in self.columns}
        total = sum(mean.values()) or 1.0
        return {c: g / total for c, g in mean.items()}


def _leaf_paths(t: dict):
    """(leaf value, {feature: interval and cover share}) for every leaf."""
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        f = t["feature"][at]
        if f < 0:
            yield t["value"][at], path
            continue
        for child, is_left in ((t["left"][at], True), (t["right"][at], False)):
            known = path.get(f, {"low": -np.inf, "high": np.inf, "share": 1.0})
            ratio = t["cover"][child] / t["cover"][at] if t["cover"][at] else 0.0
            step = dict(known, share=known["share"] * ratio)
            if is_left:
                step["high"] = min(step["high"], t["threshold"][at])
            else:
                step["low"] = max(step["low"], t["threshold"][at])
            stack.append((child, {**path, f: step}))


@dataclass
class FittedModel:
    config: CandidateConfig
    medians: dict[str, float]
    ensemble: Ensemble | None = None
    linear: tuple[list[float], float] | None = None

    @property
    def columns(self) -> list[str]:
        return self.config.feature_columns

    def prediction(self, df: DataFrame) -> Column:
        """Forecast column in limit fractions for the rows of ``df``."""
        c = self.config
        if c.model in forecast.BASELINES:
            return forecast.baseline(c.model)
        x = features_array(self.columns, self.medians)
        if self.linear is not None:
            weights, intercept = self.linear
            raw = F.lit(intercept)
            for i, w in enumerate(weights):
                raw = raw + F.element_at(x, i + 1) * float(w)
        else:
            raw = _raw_udf(self.ensemble)(x)
        decoded = forecast.decode_prediction(raw, c.target)
        gate = c.params.get("gate")
        return forecast.gate(decoded, gate) if gate is not None else decoded

    def transform(self, df: DataFrame, name: str = "pred") -> DataFrame:
        require_columns(self.config, df)
        return df.withColumn(name, self.prediction(df))

    def contributions(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Long table: keep + feature, contribution, feature_value; feature 'bias' closes the sum.

        Rows inside the quiet gate report the persistence value as bias.
        """
        if self.ensemble is None:
            raise ValueError("contributions need a boosted model")
        x = features_array(self.columns, self.medians)
        gate = self.config.params.get("gate")
        from peerscreen.functions.columns import quiet

        still = quiet(gate) if gate is not None else F.lit(False)
        wide = df.select(*keep, x.alias("_x"), forecast.offset(self.config.target).alias("_o"), still.alias("_q"), F.col("limit_fraction").alias("_lf"))
        wide = wide.withColumn("_c", _share_udf(self.ensemble)("_x"))
        n = len(self.columns)
        entries = [
            F.struct(
                F.lit(c).alias("feature"),
                F.when(F.col("_q"), 0.0).otherwise(F.element_at("_c", i + 1)).alias("contribution"),
                F.element_at("_x", i + 1).alias("feature_value"),
            )
            for i, c in enumerate(self.columns)
        ]
        bias = F.struct(
            F.lit("bias").alias("feature"),
            F.when(F.col("_q"), F.col("_lf")).otherwise(F.element_at("_c", n + 1) + F.col("_o")).alias("contribution"),
            F.lit(None).cast("double").alias("feature_value"),
        )
        return wide.select(*keep, F.explode(F.array(*entries, bias)).alias("_e")).select(*keep, "_e.*")

    def importance(self, spark) -> DataFrame:
        rows = sorted(self.ensemble.importance().items(), key=lambda kv: (-kv[1], kv[0]))
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _raw_udf(ensemble: Ensemble):
    @F.pandas_udf(T.DoubleType())
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(ensemble.raw(np.vstack(x.to_numpy())) if len(x) else [], dtype=float)

    return raw


def joint_predictions(models: Sequence[FittedModel]) -> Column:
    """array<double>: the forecast of every model for a row; gaps are filled by each model's own medians."""
    learned = [m for m in models if m.config.model not in forecast.BASELINES]
    columns = list(dict.fromkeys(c for m in learned for c in m.columns))
    own = [([columns.index(c) for c in m.columns], np.array([m.medians[c] for c in m.columns]), m.ensemble, m.linear) for m in learned]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def raw(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        every = np.vstack(x.to_numpy()).astype(float)
        out = []
        for at, fill, ensemble, linear in own:
            filled = np.where(np.isfinite(every[:, at]), every[:, at], fill)
            out.append(ensemble.raw(filled) if linear is None else filled @ np.array(linear[0]) + linear[1])
        return pd.Series(list(np.column_stack(out)))

    raws = raw(F.array(*[finite(c) for c in columns])) if learned else None
    if raws is None:
        return F.array(*[forecast.baseline(m.config.model) for m in models])

    def each(r: Column) -> Column:
        found, at = [], 0
        for m in models:
            c = m.config
            if c.model in forecast.BASELINES:
                found.append(forecast.baseline(c.model))
                continue
            at += 1
            decoded = forecast.decode_prediction(F.element_at(r, at), c.target)
            found.append(forecast.gate(decoded, c.params["gate"]) if c.params.get("gate") is not None else decoded)
        return F.array(*found)

    return F.element_at(F.transform(F.array(raws), each), 1)


def _share_udf(ensemble: Ensemble):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def shares(x: pd.Series) -> pd.Series:
        return pd.Series(list(ensemble.shares(np.vstack(x.to_numpy()))) if len(x) else [])

    return shares


def top_contributions(contributions: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The n strongest features per row (bounded by the number of features)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "feature")
    ranked = contributions.filter(F.col("feature") != "bias").withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= n)


@dataclass(frozen=True)
class Job:
    """One model of a joint fit."""

    config: CandidateConfig
    seed: int = 26170
    member: int = 0  # which training set


def settings(config: CandidateConfig) -> dict:
    return {**BOOST_PARAMS, "huber_slope": HUBER_SLOPE, **{k: v for k, v in config.params.items() if k not in ("gate", "bags")}}


def require_columns(config: CandidateConfig, df: DataFrame) -> None:
    """Fails with the names of the features that df lacks."""
    missing = [c for c in config.feature_columns if c not in df.columns]
    if missing and config.model not in forecast.BASELINES:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")


def fit_many(table: DataFrame, jobs: Sequence[Job], members: Sequence[Column] | None = None) -> list[FittedModel]:
    """All jobs on one table, boosted ones in the same passes over it.

    members[i] says which rows belong to training set i (default: one set of all); rows without ``y``
    belong to none. Medians
    of a training set come from its rows only.
    """
    members = members or [F.lit(True)]
    for job in jobs:
        require_columns(job.config, table)
    learned = [j for j in jobs if j.config.model not in forecast.BASELINES]
    if not learned:
        return [FittedModel(j.config, {}) for j in jobs]
    columns = list(dict.fromkeys(c for j in learned for c in j.config.feature_columns))
    targets = list(dict.fromkeys(j.config.target for j in learned))
    rows = table.filter(F.col("y").isNotNull()).select(
        F.xxhash64(*S.KEY4).alias("id"),
        F.array(*[finite(c) for c in columns]).alias("x"),
        F.array(*[forecast.encode_target(F.col("y"), t) for t in targets]).alias("targets"),
        F.array(*[F.coalesce(m, F.lit(False)) for m in members]).alias("members"),
    )
    rows = ordering.stable(rows)
    fits, owner = [], []
    for at, j in enumerate(jobs):
        if j.config.model == "boosted":
            own = tuple(columns.index(c) for c in j.config.feature_columns)
            for k in range(int(j.config.params.get("bags", 1))):
                centred = j.config.target.endswith("residual_over_persistence")
                fits.append(trees.Fit(own, targets.index(j.config.target), j.member, j.config.objective, settings(j.config), j.seed + k, centred))
                owner.append(at)
    fill, grown = trees.grown(rows, len(columns), len(members), fits)
    out = []
    for at, j in enumerate(jobs):
        c = j.config
        if c.model in forecast.BASELINES:
            out.append(FittedModel(c, {}))
            continue
        own = {name: float(fill[j.member][columns.index(name)]) for name in c.feature_columns}
        if c.model == "ridge":
            x = F.array(*[F.coalesce(F.element_at("x", columns.index(n) + 1), F.lit(own[n])) for n in c.feature_columns])
            part = rows.filter(F.element_at("members", j.member + 1)).select(x.alias("_x"), F.element_at("targets", targets.index(c.target) + 1).alias("_y"))
            out.append(FittedModel(c, own, linear=_fit_ridge(part)))
            continue
        parts = [g for g, o in zip(grown, owner) if o == at]
        every = [t | {"weight": t["weight"] / len(parts)} for g in parts for t in g.trees]
        out.append(FittedModel(c, own, ensemble=Ensemble(c.feature_columns, sum(g.base for g in parts) / len(parts), every)))
    return out


def fit_model(config: CandidateConfig, train: DataFrame, *, seed: int = 26170) -> FittedModel:
    """Fit on rows with a known ``y``; medians come from these rows only."""
    return fit_many(train, [Job(config, seed)])[0]


def _fit_ridge(rows: DataFrame) -> tuple[list[float], float]:
    """Ridge on standardised features; the penalty is per row in Spark ML."""
    data = rows.select(array_to_vector("_x").alias("features"), F.col("_y").alias("label"))
    n = data.count()
    model = LinearRegression(regParam=RIDGE_PENALTY / max(n, 1), elasticNetParam=0.0, standardization=True, solver="normal").fit(data)
    return [float(v) for v in model.coefficients], float(model.intercept)


def permutation_importance(model: FittedModel, rows: DataFrame, *, repeats: int = 5, seed: int = 26170, hot: bool | None = None) -> DataFrame:
    """Increase of the error when one feature is taken from a random other row.

    One pairing per repeat serves every feature: rows meet a partner by their
    places in two random orders, and each feature in turn is swapped in.
    """
    columns = model.columns
    base = rows.filter(F.col("y").isNotNull()).select(
        F.xxhash64(*S.KEY4).alias("_id"), features_array(columns, model.medians).alias("_x"), "y", "limit_fraction"
    )
    base = ordering.stable(base)
    if hot is None:
        hot = ordering.has_hot_group(base, [])
    swap = _swap_udf(model.ensemble)
    per_repeat = None
    for k in range(repeats):
        order = lambda side: F.xxhash64("_id", F.lit(seed + k), F.lit(side))  # noqa: E731, B023
        own = ordering.numbered(base.withColumn("_o", order(1)), [], "_o", "_pos", hot=hot)
        other = ordering.numbered(base.withColumn("_o", order(2)), [], "_o", "_pos", hot=hot)
        paired = own.drop("_o", "group_size").join(other.select("_pos", F.col("_x").alias("_z")), "_pos")
        scored = paired.withColumn("_p", swap("_x", "_z"))
        raw = lambda i: F.greatest(F.element_at("_p", i + 1) + forecast.offset(model.config.target), F.lit(0.0))
        errors = [F.avg(F.abs(raw(i) - F.col("y"))).alias(f"e{i}") for i in range(len(columns) + 1)]
        one = scored.agg(*errors).select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"e{i + 1}") - F.col("e0")).alias("delta")) for i, c in enumerate(columns)])
            ).alias("x")
        ).select("x.*")
        per_repeat = one if per_repeat is None else per_repeat.unionByName(one)
    return per_repeat.groupBy("feature").agg(
        F.avg("delta").alias("mae_increase"), F.stddev_pop("delta").alias("mae_increase_std")
    ).orderBy(F.desc("mae_increase"), "feature")


def _swap_udf(ensemble: Ensemble):
    """Predictions with no feature swapped, then with each feature swapped in turn."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def swapped(x: pd.Series, z: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        a, b = np.vstack(x.to_numpy()), np.vstack(z.to_numpy())
        out = [ensemble.raw(a)]
        for j in range(a.shape[1]):
            mixed = a.copy()
            mixed[:, j] = b[:, j]
            out.append(ensemble.raw(mixed))
        return pd.Series(list(np.column_stack(out)))

    return swapped


def with_params(config: CandidateConfig, **params) -> CandidateConfig:
    return replace(config, params={**config.params, **params})
