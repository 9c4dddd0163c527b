"""New frames as a stream: hard limits need no population, tail tests join a table fitted before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.config import Config
from prismark.functions.robust import robust_z
from prismark.operators.filters import rule_reason


def judge(stats: DataFrame, cfg: Config, fits: DataFrame | None = None) -> DataFrame:
    """A stream (or table) of statistics with rejection_reason. fits(object_id, center_*, scale_*): a static table to join."""
    joined = stats if fits is None else stats.join(fits, "object_id", "left")
    reasons = [F.when(F.col("pixel_count") <= 0, F.lit("vincent_empty_mask"))] if cfg.empty else []
    if cfg.border:
        reasons.append(F.when(F.col("touches_border") > 0, F.lit("vincent_border_pixel")))
    for r in cfg.rules:
        known = fits is not None and r.z is not None
        z = robust_z(F.col(r.stat), F.col(f"center_{r.stat}"), F.col(f"scale_{r.stat}")) if known else None
        reasons.append(rule_reason(r, F.col(r.stat), z))
    return joined.withColumn("rejection_reason", F.coalesce(*reasons, F.lit(None).cast("string"))).select(*stats.columns, "rejection_reason")
