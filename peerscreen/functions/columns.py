"""Column expressions used across operators. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from peerscreen import schema as S


def finite(c) -> Column:
    """NaN and infinities become NULL (Spark treats NaN as larger than anything)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def null_non_finite(df: DataFrame, columns=None) -> DataFrame:
    """Apply :func:`finite` to every double/float column (or the named ones)."""
    names = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: finite(c) for c in names})


def logistic(x: Column, threshold) -> Column:
    return 1.0 / (1.0 + F.exp(-(x - threshold)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division whose empty denominator is NULL, never an error."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_change(initial: Column, current: Column) -> Column:
    return (current - initial) / F.greatest(F.abs(initial), F.lit(1e-9))


def display_percent_change(initial: Column, current: Column) -> Column:
    return F.when(initial != 0, percent_change(initial, current))


def robust_scale_z(x: Column, median: Column, mad: Column, std: Column) -> Column:
    """0.6745 * deviation over the floored peer scale."""
    scale = F.greatest(
        mad,
        F.abs(median) * 0.01,
        F.coalesce(std, F.lit(0.0)) * 0.1,
        F.lit(1e-9),
    )
    return 0.6745 * (x - median) / scale


def textbook_mad_z(x: Column, median: Column, mad: Column) -> Column:
    scale = F.when(mad * 1.4826 > 0, mad * 1.4826).otherwise(
        F.greatest(F.abs(median) * 1e-3, F.lit(1e-12))
    )
    return (x - median) / scale


def slope_stratum(z: Column) -> Column:
    """0 below 2, 1 in [2, 5), 2 from 5; missing counts as 0."""
    v = F.coalesce(finite(z), F.lit(0.0))
    low, high = S.STRATA_EDGES
    return F.when(v < low, 0).when(v < high, 1).otherwise(2)


def quiet(gate: float = S.GATE_Z) -> Column:
    """True where level and drift both sit inside the gate."""
    return (F.abs(F.coalesce(F.col("slope_batch_robust_z"), F.lit(0.0))) < gate) & (
        F.abs(F.coalesce(F.col("current_batch_robust_z"), F.lit(0.0))) < gate
    )


def severity_band(limit_fraction: Column) -> Column:
    return (
        F.when(limit_fraction >= 1.0, "limit_breach")
        .when(limit_fraction >= 0.75, "near_limit")
        .when(limit_fraction >= 0.45, "elevated")
        .when(limit_fraction >= 0.2, "healthy")
        .otherwise("optimal")
    )


def arrhenius(temperature_c: Column, reference_c: float, activation_ev: float) -> Column:
    """Rate ratio between two temperatures; NULL at or below absolute zero."""
    boltzmann_ev_per_k = 8.617333262e-5
    kelvin = temperature_c + 273.15
    inverse = 1.0 / (reference_c + 273.15) - F.try_divide(F.lit(1.0), kelvin)
    return F.when(kelvin > 0, F.exp(inverse * (activation_ev / boltzmann_ev_per_k)))


def insulation_resistance(voltage: Column, current_ua: Column) -> Column:
    return F.try_divide(voltage, current_ua * 1000.0)


def true_reasons(pairs) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in pairs]))


def flag(c) -> Column:
    """Boolean that reads NULL as False."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("boolean"), F.lit(False))


def parse_boolean(c) -> Column:
    """true/false/1/0 in any case; anything else is NULL (the caller rejects it)."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def as_number(c) -> Column:
    """Text to double, stricter than try_cast alone.

    try_cast accepts type suffixes such as '1d' and the words inf/nan, which are
    not measurements, so a numeric pattern guards the cast.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c.cast("string"))
    number = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return finite(number)


def refuse_null(value: Column, witness: Column, message: str) -> Column:
    """``value``, failing the job where ``witness`` is NULL: a check without a pass of its own."""
    return F.when(witness.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def blank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
