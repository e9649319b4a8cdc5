"""Data-quality checks. Each returns explicit rows: nothing is silently dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from peerscreen import schema as S
from peerscreen.functions.columns import as_number, blank, ratio, true_reasons


class ReadingsError(ValueError):
    """Readings that must not enter the feature pipeline."""


def _varies(c: Column | str) -> Column:
    """Aggregate: more than one value in the group, NULL counted as a value."""
    c = F.col(c) if isinstance(c, str) else c
    mixed = F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return mixed | ((F.count(c) > 0) & (F.count_if(c.isNull()) > 0))


def _differs(c: Column | str) -> Column:
    """Aggregate: more than one non-NULL value in the group."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def check_readings(df: DataFrame, *, strict: bool = False) -> DataFrame:
    """(check, n) for every rule of the core contract; ``strict`` raises if any n > 0."""
    missing = [c for c in S.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ReadingsError(f"missing required columns: {', '.join(sorted(missing))}")
    number = {c: as_number(c) for c in S.REQUIRED_NUMERIC}
    one_pass = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in S.REQUIRED_COLUMNS}
    one_pass |= {f"non_numeric_{c}": F.count_if(number[c].isNull()) for c in S.REQUIRED_NUMERIC}
    one_pass["negative_hours"] = F.count_if(number["hours"] < 0)
    one_pass["non_positive_limit"] = F.count_if(number["upper_limit"] <= 0)
    if "lower_limit" in df.columns:
        one_pass["lower_not_below_upper"] = F.count_if(as_number("lower_limit") >= number["upper_limit"])
    one_pass["empty_dataset"] = F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)
    wide = df.agg(*[c.cast("bigint").alias(n) for n, c in one_pass.items()])
    rows = wide.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in one_pass])).alias("x")
    ).select("x.*")
    identity = S.KEY4 + ["hours"]
    repeated = df.groupBy(*identity).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = rows.unionByName(
        repeated.agg(F.lit("duplicate_identity").alias("check"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n"))
    )
    moving = df.groupBy("component_id", "measurement_name").agg(_varies("upper_limit").alias("v")).filter("v")
    rows = rows.unionByName(moving.agg(F.lit("limit_changes").alias("check"), F.count(F.lit(1)).alias("n")))
    if strict:
        bad = rows.filter("n > 0").collect()  # at most one row per rule
        if bad:
            raise ReadingsError("; ".join(f"{r['check']}: {r['n']}" for r in bad))
    return rows


# --- row-level findings -----------------------------------------------------------


def blank_identity(df: DataFrame) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in S.KEY4]))
    return df.withColumn("column", F.explode(hits))


def bad_hours(df: DataFrame) -> DataFrame:
    h = as_number("hours")
    return df.withColumn(
        "problem", F.when(h.isNull(), "non_finite").when(h < 0, "negative")
    ).filter(F.col("problem").isNotNull())


def crossed_limits(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lower_limit") >= F.col("upper_limit"))


def duplicate_readings(df: DataFrame) -> DataFrame:
    """Every member of a repeated (history, hour) group with the group's size."""
    key = S.KEY4 + ["hours"]
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return df.join(repeated, key)


def moving_limits(df: DataFrame) -> DataFrame:
    """(history, limit column) pairs whose limit changes within the history."""
    columns = [c for c in ("upper_limit", "lower_limit") if c in df.columns]
    seen = df.groupBy(*S.KEY4).agg(*[_differs(c).alias(c) for c in columns])
    hits = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns]))
    return seen.select(*S.KEY4, F.explode(hits).alias("column"))


def shared_component_ids(df: DataFrame, *, families: bool = True) -> DataFrame:
    """Distinct (component, batch, family) of ids that name more than one device."""
    rule = _differs("batch_id") | _differs("component_family") if families else _differs("batch_id")
    places = df.select("component_id", "batch_id", "component_family").distinct()
    offenders = places.groupBy("component_id").agg(rule.alias("v")).filter("v").select("component_id")
    return places.join(offenders, "component_id", "left_semi")


def mixed_batches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(batch, column) pairs that should hold one value and hold several."""
    columns = [c for c in columns if c in df.columns]
    seen = df.groupBy("batch_id").agg(*[_varies(c).alias(c) for c in columns])
    hits = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns]))
    return seen.select("batch_id", F.explode(hits).alias("column"))


def incompatible_peers(df: DataFrame) -> DataFrame:
    """Peer groups that mix units, test conditions or limits; blanks do not count."""
    text = [c for c in ("measurement_unit", "test_condition") if c in df.columns]
    limits = [c for c in ("upper_limit", "lower_limit") if c in df.columns]
    filled = lambda c: F.when(~blank(c), F.trim(F.col(c)))
    seen = df.groupBy(*S.PEER).agg(
        *[_differs(filled(c)).alias(c) for c in text], *[_differs(c).alias(c) for c in limits]
    )
    hits = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in text + limits]))
    return seen.select(*S.PEER, F.explode(hits).alias("column")).withColumn(
        "code",
        F.when(F.col("column") == "measurement_unit", "INCOMPATIBLE_UNITS").otherwise("INCOMPATIBLE_TEST_CONDITIONS"),
    )


def first_errors(findings: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """The first n findings (a report limit, kept by a bounded top-n)."""
    return findings.orderBy(*order).limit(n)


# --- eligibility -----------------------------------------------------------------

# --- fixed values: reasons why a history is not scored, in reporting order ---------
WRONG_FAMILY = "Unsupported family: this bundle supports {family} only"
WRONG_MEASUREMENT = "Unsupported measurement: {measurement} in microamperes is required"
BAD_HOURS = "Hours must be finite, numeric and nonnegative"
NEED_BOTH = "Exactly one 0-hour and one 24-hour reading are required"
NOT_FINITE = "{column} must be finite and numeric at both checkpoints"
NEGATIVE = "Leakage must be nonnegative"
BAD_LIMIT = "A positive, unchanged upper_limit is required"
LOWER_GIVEN = (
    "This leakage bundle implements upper-limit screening only; lower limits require a separate profile"
)
OPTIONAL_BAD = "Supplied {column} must be finite and numeric"
CHANGES = "{column} changes between the two checkpoints"
WRONG_UNIT = "{column} must explicitly specify microamperes (uA)"
UNKNOWN_PROFILE = "Missing or unsupported profile_id for this trained bundle"
ACCEPTED_UNITS = ["uA", "µA", "μA"]
OPTIONAL_NUMBERS = [
    "nominal_capacitance_nf",
    "rated_voltage_v",
    "applied_voltage_v",
    "measurement_voltage_v",
    "temperature_c",
    "measurement_temperature_c",
    "prior_storage_humidity_pct",
    "capacitance_nf",
    "dissipation_factor_pct",
]
CONSTANT_COLUMNS = [
    "profile_id",
    "part_number",
    "nominal_capacitance_nf",
    "rated_voltage_v",
    "measurement_voltage_v",
    "measurement_temperature_c",
]
# --- end of fixed values -----------------------------------------------------------


def eligibility(
    readings: DataFrame,
    *,
    family: str = "MLCC_X7R",
    measurement: str | None = "leakage_ua",
    check_units: bool = True,
) -> DataFrame:
    """KEY4 + ``reasons``: an empty list means the history can be scored at 0 h and 24 h.

    All conditions are counts in one aggregation over the history.
    """
    have = set(readings.columns)
    hours = as_number("hours")
    early = F.coalesce(hours.isin(S.CHECKPOINTS), F.lit(False))
    value, limit = as_number("measurement_value"), as_number("upper_limit")
    hit = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    early_of = lambda c: F.when(early, c)
    conditions = {
        "_hours": F.count_if(hours.isNull() | (hours < 0)) > 0,
        "_zero": F.count_if(early & (hours == 0.0)) != 1,
        "_day": F.count_if(early & (hours == 24.0)) != 1,
        "_value": hit(early & value.isNull()) > 0,
        "_limit": hit(early & limit.isNull()) > 0,
        "_negative": hit(early & (value < 0)) > 0,
        "_limit_bad": (hit(early & (limit <= 0)) > 0)
        | F.coalesce(F.min(early_of(limit)) != F.max(early_of(limit)), F.lit(False))
        | (F.count(early_of(limit)) == 0),
    }
    if "lower_limit" in have:
        conditions["_lower"] = hit(early & F.col("lower_limit").isNotNull()) > 0
    numbers = [c for c in OPTIONAL_NUMBERS if c in have]
    for c in numbers:
        conditions[f"_num_{c}"] = hit(early & F.col(c).isNotNull() & as_number(c).isNull()) > 0
    constants = [c for c in CONSTANT_COLUMNS if c in have]
    for c in constants:
        v = early_of(F.col(c))
        conditions[f"_con_{c}"] = F.coalesce(F.min(v) != F.max(v), F.lit(False)) | (
            (F.count(v) > 0) & (F.count_if(early & F.col(c).isNull()) > 0)
        )
    units = [c for c in ("unit", "measurement_unit") if c in have] if check_units else []
    for c in units:
        conditions[f"_unit_{c}"] = F.count_if(early & ~F.coalesce(F.col(c).isin(ACCEPTED_UNITS), F.lit(False))) > 0
    seen = readings.groupBy(*S.KEY4).agg(*[c.alias(n) for n, c in conditions.items()])
    pairs = [(F.col("component_family") != family, WRONG_FAMILY.format(family=family))]
    if measurement is not None:
        pairs.append((F.col("measurement_name") != measurement, WRONG_MEASUREMENT.format(measurement=measurement)))
    pairs += [
        (F.col("_hours"), BAD_HOURS),
        (F.col("_zero") | F.col("_day"), NEED_BOTH),
        (F.col("_value"), NOT_FINITE.format(column="measurement_value")),
        (F.col("_limit"), NOT_FINITE.format(column="upper_limit")),
        (F.col("_negative"), NEGATIVE),
        (F.col("_limit_bad"), BAD_LIMIT),
    ]
    if "lower_limit" in have:
        pairs.append((F.col("_lower"), LOWER_GIVEN))
    pairs += [(F.col(f"_num_{c}"), OPTIONAL_BAD.format(column=c)) for c in numbers]
    pairs += [(F.col(f"_con_{c}"), CHANGES.format(column=c)) for c in constants]
    pairs += [(F.col(f"_unit_{c}"), WRONG_UNIT.format(column=c)) for c in units]
    return seen.select(*S.KEY4, true_reasons(pairs).alias("reasons"))


def unscored_reason(text: Column) -> Column:
    """Free-text reasons to the stable reason codes."""
    t = F.lower(text)
    has = lambda *words: _any(F.contains(t, F.lit(w)) for w in words)
    return (
        F.when(has("0-hour", "24-hour", "hour reading"), "missing_checkpoint")
        .when(has("profile_id", "unsupported profile"), "unsupported_profile")
        .when(has("unsupported family", "unsupported measurement"), "unsupported_profile")
        .when(has("hours must be"), "missing_checkpoint")
        .otherwise("core_error")
    )


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def resolve_profiles(readings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per history: profile, reason code if it cannot be scored, hours present and missing.

    The hour sets hold the distinct checkpoint hours of the profile grid.
    """
    grid = F.array(*[F.lit(h) for h in S.CHECKPOINTS])
    near = F.filter(grid, lambda c: F.abs(F.col("hours") - c) < S.HOUR_TOLERANCE)
    present = readings.groupBy(*S.KEY4).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.array_compact(
            F.array(*[F.max(F.when(F.array_contains(near, F.lit(h)), F.lit(h))) for h in S.CHECKPOINTS])
        ).alias("checkpoint_hours"),
    )
    dim = profiles.select("profile_id", "component_family", "measurement_name", "status", "required_hours")
    df = present.join(dim, S.SCOPE, "left")
    df = df.withColumn("missing_hours", F.array_except("required_hours", "checkpoint_hours"))
    return df.withColumn(
        "reason",
        F.when(F.col("profile_id").isNull(), "unsupported_profile")
        .when(F.col("status") != "supported", "profile_not_available")
        .when(F.size("missing_hours") > 0, "missing_checkpoint"),
    )


def unit_mismatches(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Declared units that are neither the profile unit nor one of its aliases."""
    dim = profiles.select(*S.SCOPE, F.col("measurement_unit").alias("profile_unit"), "unit_aliases")
    declared = F.trim(F.col("measurement_unit"))
    ok = (declared == F.col("profile_unit")) | F.array_contains("unit_aliases", F.lower(declared))
    return df.join(dim, S.SCOPE).filter(~blank("measurement_unit") & ~ok)


def preflight(df: DataFrame, family: str, measurement: str) -> DataFrame:
    """Upload-level findings: (code, n, fatal)."""
    have = set(df.columns)
    lower = F.count("lower_limit") if "lower_limit" in have else F.lit(0).cast("bigint")
    counts = df.agg(
        lower.alias("UNSUPPORTED_LOWER_LIMIT"),
        F.count_if((F.col("component_family") != family) | (F.col("measurement_name") != measurement)).alias(
            "UNSUPPORTED_FAMILY_OR_MEASUREMENT_PRESENT"
        ),
        (F.lit(0) if "profile_id" in have else F.count(F.lit(1))).cast("bigint").alias("PROFILE_ID_COLUMN_ABSENT"),
    )
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in counts.columns])).alias("x")
    ).select("x.*").withColumn("fatal", F.col("code") == "UNSUPPORTED_LOWER_LIMIT").filter("n > 0")


def supported_profiles(df: DataFrame, supported: Sequence[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a supported profile_id and the rest with the reason; a table of profiles may have any size."""
    if isinstance(supported, DataFrame):
        names = supported.select("profile_id").distinct()
        other = df.join(names, "profile_id", "left_anti").withColumn("reasons", F.array(F.lit(UNKNOWN_PROFILE)))
        return df.join(names, "profile_id", "left_semi"), other
    ok = F.coalesce(F.col("profile_id").isin(list(supported)), F.lit(False))
    return df.filter(ok), df.filter(~ok).withColumn("reasons", F.array(F.lit(UNKNOWN_PROFILE)))


def vanished(eligible: DataFrame, scored: DataFrame) -> DataFrame:
    """Eligible histories that came back without a score."""
    return (
        eligible.select(*S.KEY4)
        .distinct()
        .join(scored.select(*S.KEY4), S.KEY4, "left_anti")
        .withColumn("reason", F.lit("too_few_early_readings"))
    )


def early_readings(readings: DataFrame, checkpoints: Sequence[float] = tuple(S.CHECKPOINTS)) -> DataFrame:
    """Readings at exactly the checkpoints (1e-9 h tolerance)."""
    near = F.lit(False)
    for h in checkpoints:
        near = near | F.col("hours").between(h - S.HOUR_TOLERANCE, h + S.HOUR_TOLERANCE)
    return readings.filter(near)


def later_readings(readings: DataFrame, as_of_hour: float = S.AS_OF_HOUR) -> DataFrame:
    return readings.filter(F.col("hours") > as_of_hour + S.HOUR_TOLERANCE)


def ignored_readings(readings: DataFrame, as_of_hour: float = S.AS_OF_HOUR) -> DataFrame:
    """How many rows are neither a checkpoint nor after the cutoff."""
    near = F.lit(False)
    for h in S.CHECKPOINTS:
        near = near | (F.abs(F.col("hours") - h) < S.HOUR_TOLERANCE)
    later = F.col("hours") > as_of_hour + S.HOUR_TOLERANCE
    return readings.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(near).alias("checkpoint_rows"),
        F.count_if(later).alias("later_rows"),
        F.count_if(~near & ~later).alias("ignored_rows"),
    )


def check_outcomes(outcomes: DataFrame, early: DataFrame, *, as_of_hour: float = S.AS_OF_HOUR) -> DataFrame:
    """(check, n): too early, repeated, unknown identity, uncovered histories."""
    key = S.KEY4 + ["hours"]
    too_early = outcomes.agg(
        F.lit("at_or_before_cutoff").alias("check"),
        F.count_if(F.col("hours") <= as_of_hour + S.HOUR_TOLERANCE).alias("n"),
    )
    repeated = (
        outcomes.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        .agg(F.lit("repeated_observation").alias("check"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n"))
    )
    seen = outcomes.select(*S.KEY4).distinct().withColumn("o", F.lit(True))
    known = early.select(*S.KEY4).distinct().withColumn("e", F.lit(True))
    both = seen.join(known, S.KEY4, "full_outer").agg(
        F.count_if(F.col("e").isNull()).alias("unknown_identity"),
        F.count_if(F.col("o").isNull()).alias("uncovered_history"),
    )
    tall = both.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("unknown_identity", "uncovered_history")])
        ).alias("x")
    ).select("x.*")
    return too_early.unionByName(repeated).unionByName(tall)


def twice_supplied(first: DataFrame, second: DataFrame) -> DataFrame:
    """Observations present in both sources."""
    key = S.KEY4 + ["hours"]
    return first.select(*key).intersect(second.select(*key))


def check_labels(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """(check, n) for a truth table against the scored rows."""
    repeated = (
        labels.groupBy(*S.KEY4).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        .agg(F.lit("repeated_label").alias("check"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n"))
    )
    unlabelled = scored.join(labels, S.KEY4, "left_anti").agg(
        F.lit("unlabelled_row").alias("check"), F.count(F.lit(1)).alias("n")
    )
    bad = labels.join(scored.select(*S.KEY4), S.KEY4, "left_semi").agg(
        F.lit("bad_final_value").alias("check"),
        F.count_if(as_number("final_value").isNull() | (as_number("final_value") < 0)).alias("n"),
    )
    return repeated.unionByName(unlabelled).unionByName(bad)


# --- reports ----------------------------------------------------------------------


def dataset_counts(df: DataFrame) -> DataFrame:
    """Batches, components, histories and rows.

    Distinct counting is done by two levels of grouping, which spreads a hot
    batch or component over all tasks.
    """
    histories = df.groupBy(*S.KEY4).agg(F.count(F.lit(1)).alias("rows"))
    return histories.agg(
        F.count_distinct("batch_id").alias("batches"),
        F.count_distinct("component_id").alias("components"),
        F.count(F.lit(1)).alias("histories"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column with PASS / CHECK."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (
        counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_values")) for c in columns])).alias("x"))
        .select("x.*")
        .withColumn("status", F.when(F.col("missing_values") == 0, "PASS").otherwise("CHECK"))
    )


def invalid_report(df: DataFrame) -> DataFrame:
    checks = {
        "Negative hours": F.count_if(F.col("hours") < 0),
        "Negative measurement value": F.count_if(F.col("measurement_value") < 0),
        "Invalid upper limit": F.count_if(F.col("upper_limit") <= 0),
    }
    counts = df.agg(*[c.alias(n) for n, c in checks.items()])
    return (
        counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("invalid_rows")) for n in checks])).alias("x"))
        .select("x.*")
        .withColumn("status", F.when(F.col("invalid_rows") == 0, "PASS").otherwise("CHECK"))
    )


def audit(df: DataFrame) -> DataFrame:
    """Rows, components, batches, exact duplicates and duplicate checkpoints of an outside table."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c"))
    exact = copies.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), (F.coalesce(F.sum("c"), F.lit(0)) - F.count(F.lit(1))).alias("exact_duplicates")
    )
    per_checkpoint = df.groupBy(*S.KEY4, "hours").agg(F.count(F.lit(1)).alias("c"))
    points = per_checkpoint.agg(
        F.count_distinct("component_id").alias("components"),
        F.count_distinct("batch_id").alias("batches"),
        F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("duplicate_checkpoint_rows"),
    )
    return exact.crossJoin(points)  # one row each


def provenance(df: DataFrame, column: str = "data_source") -> DataFrame:
    """synthetic / unknown / measured_unverified / mixed, from conditional counts."""
    # Words that mark generated data.
    markers = ["synthetic", "simulated", "generated", "synth", "fake", "demo"]
    if column not in df.columns:
        return df.agg(F.lit("unknown").alias("provenance"))
    text = F.lower(F.trim(F.col(column)))
    marked = _any(F.contains(text, F.lit(m)) for m in markers)
    synth = F.count_if(~blank(column) & marked)
    real = F.count_if(~blank(column) & ~marked)
    return df.agg(
        F.when((synth == 0) & (real == 0), "unknown")
        .when(real == 0, "synthetic")
        .when(synth == 0, "measured_unverified")
        .otherwise("mixed")
        .alias("provenance")
    )


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], mapping: dict[str, tuple[str, float]], *, rtol=1e-8, atol=1e-10) -> DataFrame:
    """Per column pair: does ``left * factor`` equal ``right``, and the largest error."""
    keys = list(keys)
    l = left.select(*keys, *[F.col(c).cast("double").alias(f"l_{c}") for c in mapping])
    r = right.select(*keys, *[F.col(t).cast("double").alias(f"r_{c}") for c, (t, _) in mapping.items()])
    joined = l.join(r, keys)
    aggs = []
    for c, (_, factor) in mapping.items():
        scaled, target = F.col(f"l_{c}") * factor, F.col(f"r_{c}")
        error = F.abs(scaled - target)
        aggs += [
            F.max(error).alias(f"e_{c}"),
            F.count_if(~F.coalesce(error <= atol + rtol * F.abs(target), F.lit(False))).alias(f"b_{c}"),
        ]
    wide = joined.agg(*aggs)
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("source_feature"),
                        F.lit(t).alias("model_feature"),
                        F.lit(float(f)).alias("multiply_by"),
                        (F.col(f"b_{c}") == 0).alias("matches"),
                        F.col(f"e_{c}").alias("max_absolute_error"),
                    )
                    for c, (t, f) in mapping.items()
                ]
            )
        ).alias("x")
    ).select("x.*")


def record_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str], numeric: Sequence[str], *, tolerance=1e-9) -> DataFrame:
    """(field, mismatches) plus rows found on one side only."""
    keys = list(keys)
    cols = list(exact) + list(numeric)
    l = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in cols], F.lit(True).alias("l"))
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in cols], F.lit(True).alias("r"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    same = {c: F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in exact}
    for c in numeric:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        same[c] = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    aggs = {"only_left": F.count_if(F.col("r").isNull()), "only_right": F.count_if(F.col("l").isNull())}
    aggs |= {c: F.count_if(both & ~s) for c, s in same.items()}
    wide = l.join(r, keys, "full_outer").agg(*[a.alias(n) for n, a in aggs.items()])
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("mismatches")) for n in aggs])).alias("x")
    ).select("x.*")


def release_checks(full: DataFrame, early: DataFrame, labels: DataFrame) -> DataFrame:
    """(check, n): every n must be zero before a data release."""
    cut = full.filter(F.col("hours").isin(S.CHECKPOINTS))
    cols = sorted(set(cut.columns) & set(early.columns))
    counted = lambda df, name: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    out = counted(cut.select(cols).exceptAll(early.select(cols)), "early_missing_rows")
    out = out.unionByName(counted(early.select(cols).exceptAll(cut.select(cols)), "early_extra_rows"))
    repeated = full.groupBy(*S.KEY4, "hours").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    out = out.unionByName(counted(repeated, "repeated_reading"))
    ids = lambda df: df.select("component_id").distinct()
    out = out.unionByName(counted(ids(labels).exceptAll(ids(full)), "label_without_readings"))
    out = out.unionByName(counted(ids(full).exceptAll(ids(labels)), "readings_without_label"))
    positive = full.agg(
        F.lit("non_positive_value").alias("check"),
        F.count_if(~F.coalesce((F.col("measurement_value") > 0) & (F.col("upper_limit") > 0), F.lit(False))).alias("n"),
    )
    return out.unionByName(positive)


def restore_codes(cleaned: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring text codes lost to number parsing ('0805' read as 805) back from a source table.

    ``unmatched`` marks rows without a source; the caller refuses them.
    """
    originals = source.groupBy("component_id").agg(*[F.max(c).alias(f"_{c}") for c in columns])
    joined = cleaned.join(originals, "component_id", "left")
    out = joined.withColumns({c: F.col(f"_{c}") for c in columns})
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(f"_{c}").isNull()
    return out.withColumn("unmatched", missing).drop(*[f"_{c}" for c in columns])


def screening_status(df: DataFrame) -> DataFrame:
    """Status counts with percentage: above limit, check / monitor, normal."""
    status = (
        F.when(F.col("current_value") >= F.col("upper_limit"), "ABOVE LIMIT")
        .when(F.col("recommendation") != "ACCEPT", "CHECK / MONITOR")
        .otherwise("NORMAL")
    )
    counted = df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("components"))
    total = counted.agg(F.sum("components").alias("all"))  # three rows at most
    return counted.crossJoin(total).select(
        "status", "components", (ratio(F.col("components"), F.col("all")) * 100).alias("percentage")
    )
