"""Battery and charging relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalspark.operators import tseries as ts
from signalspark.operators.slices import with_previous, with_running_sum

# Charging states in order of their code.
CHARGE_STATES = ["idle", "connected", "locked", "charging", "complete", "fault"]


def soc_from_current(
    samples: DataFrame, keys: list[str], capacity_ah: float, soc0: float = 100.0, slice_s: float = 3600.0, order: tuple[str, ...] = ("t",)
) -> DataFrame:
    """State of charge by integrating current (amperes, positive discharges), left rectangles."""
    by = F.floor(F.col("t") / F.lit(float(slice_s)))
    x = with_previous(samples, keys, list(order), ["t", "current"], by).drop("slice_no", "slice_row")
    step = F.coalesce(F.col("current_p1") * (F.col("t") - F.col("t_p1")) / F.lit(3600.0), F.lit(0.0))
    x = with_running_sum(x, keys, list(order), {"_ah": step}, by)
    return x.withColumn("soc", F.lit(float(soc0)) - F.col("_ah") * 100.0 / F.lit(float(capacity_ah))).drop(
        "_ah", "t_p1", "current_p1"
    )


def battery_power(voltage: DataFrame, current: DataFrame, keys: list[str], hz: float, max_gap: float, slice_s: float) -> DataFrame:
    """Volts times amperes where both are known on their common grid."""
    both = ts.spans(voltage, keys).unionByName(ts.spans(current, keys))
    grid = ts.common_grid(both, keys, hz)
    v = ts.resample(voltage, grid, keys, keys, hz, max_gap, slice_s)
    i = ts.resample(current, grid, keys, keys, hz, max_gap, slice_s)
    return ts.series_pairs(v, i, keys).select(*keys, "gi", (F.col("x") * F.col("y")).alias("power"))


def power_consistency(power: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation and factor of a power candidate against V times I."""
    j = power.join(claimed, [*keys, "gi"])
    return ts.linear_fit(j, keys, "power", "claimed")


def ac_power(voltage: Column, current: Column, phases: int = 3, power_factor: float = 1.0) -> Column:
    return F.lit(phases) * voltage * current * F.lit(float(power_factor))


def classify_mode(samples: DataFrame, keys: list[str], dc_amps: float = 50.0) -> DataFrame:
    """AC when its current moves, DC when only a large direct current flows, else AC."""
    a = samples.groupBy(*keys).agg(F.max(F.abs("ac")).alias("ac_max"), F.max(F.abs("dc")).alias("dc_max"))
    dc = ~F.coalesce(F.col("ac_max") > 1.0, F.lit(False)) & F.coalesce(F.col("dc_max") > dc_amps, F.lit(False))
    return a.withColumn("mode", F.when(dc, "dc").otherwise("ac"))


def phase_count(samples: DataFrame, keys: list[str], active_amps: float = 1.0) -> DataFrame:
    """Phases that ever carry current."""
    per = samples.groupBy(*keys, "phase").agg(F.max(F.abs("current")).alias("peak"))
    return per.groupBy(*keys).agg(F.count_if(F.col("peak") > active_amps).alias("phases"))


def charge_state_name(code: Column) -> Column:
    names = F.array(*[F.lit(s) for s in CHARGE_STATES])
    return F.when((code >= 0) & (code < len(CHARGE_STATES)), F.get(names, code.cast("int"))).otherwise("unknown")
