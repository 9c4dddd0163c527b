"""Robust population statistics, tail tests and weights as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions.quantiles import quantiles
from prismark.sources.tables import written

MAD_TO_STD = 1.4826


def robust_fits(df: DataFrame, stats: list[str], by: list[str]) -> DataFrame:
    """(by..., center_<stat>, scale_<stat> ...): median, and median absolute deviation times 1.4826, of each population.

    All statistics are fitted in two aggregations, and the few rows of fits are written once: their size is known
    to what joins them, and nothing is fitted twice. df is read several times: hand over a written table.
    """
    stats = list(dict.fromkeys(stats))
    centers = written(quantiles(df, by, [(f"center_{s}", s, 0.5) for s in stats]), "centers")
    off = df.join(centers, by).select(*by, *[F.abs(F.col(s) - F.col(f"center_{s}")).alias(s) for s in stats])
    scales = quantiles(off, by, [(f"scale_{s}", s, 0.5) for s in stats])
    return written(centers.join(scales.select(*by, *[(F.col(f"scale_{s}") * MAD_TO_STD).alias(f"scale_{s}") for s in stats]), by), "fits")


def robust_fit(df: DataFrame, stat: str, by: list[str]) -> DataFrame:
    """(by..., center, scale) of one statistic."""
    return robust_fits(df, [stat], by).withColumnsRenamed({f"center_{stat}": "center", f"scale_{stat}": "scale"})


def robust_z(value: Column, center: Column, scale: Column) -> Column:
    """Distance from the centre in scales; a scale of 0 or less counts as 1, small positive ones stay."""
    return (value - center) / F.when(scale > 0, scale).otherwise(F.lit(1.0))


def tail_rejected(z: Column, limit: float | None, bad: str = "low") -> Column:
    """Whether z lies in the bad tail, the limit included. No limit: nothing does."""
    if bad not in ("low", "high"):
        raise ValueError(f"bad must be low or high, not {bad!r}")
    if limit is None:
        return F.lit(False)
    return z <= -limit if bad == "low" else z >= limit


def one_sided_weight(value: Column, center: Column, scale: Column, softness: float, bad: str = "low") -> Column:
    """Half a bell over the bad side of the centre, 1 on the good side; with no scale, a step from 1 to 0."""
    if bad not in ("low", "high"):
        raise ValueError(f"bad must be low or high, not {bad!r}")
    off = F.greatest(center - value if bad == "low" else value - center, F.lit(0.0))
    bell = F.exp(F.lit(-0.5) * F.pow(off / scale / F.lit(softness), 2))
    return F.when(scale <= 0, F.when(off <= 0, 1.0).otherwise(0.0)).otherwise(bell)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
