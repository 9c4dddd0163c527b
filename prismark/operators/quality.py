"""Quality components, weighted score, adaptive floor and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismark.config import Floor, Quality
from prismark.functions.quantiles import quantiles
from prismark.functions.robust import clip


def blur(laplacian: Column, anchor: float) -> Column:
    return F.least(laplacian / anchor, F.lit(1.0))


def area(fraction: Column, anchor: float) -> Column:
    return F.least(fraction / anchor, F.lit(1.0))


def artefacts(fraction: Column, pixels: Column, anchor: float) -> Column:
    return F.when(pixels <= 0, 0.0).otherwise(clip(1 - fraction / anchor, 0.0, 1.0))


def centerness(cy: Column, cx: Column, pixels: Column, height: int, width: int, zone: float) -> Column:
    """1 less the squared distance of the centroid from the middle, and an exponential drop within `zone` of an edge."""
    half_w, half_h = max((width - 1) / 2, 1e-6), max((height - 1) / 2, 1e-6)
    dx, dy = F.abs(cx - (width - 1) / 2) / half_w, F.abs(cy - (height - 1) / 2) / half_h
    d = F.least(F.sqrt(dx * dx + dy * dy) / F.sqrt(F.lit(2.0)), F.lit(1.0))
    gap = F.least(cy, height - 1 - cy, cx, width - 1 - cx)
    drop = F.when(gap < zone, F.exp((gap - zone) * 0.5)).otherwise(1.0)
    return F.when(pixels <= 0, 0.0).otherwise(clip((1 - d * d) * drop, 0.0, 1.0))


def components(df: DataFrame, q: Quality, height: int, width: int) -> DataFrame:
    pixels = F.col("pixel_count")
    return (
        df.withColumn("blur", blur(F.col("laplacian"), q.blur_anchor))
        .withColumn("area", area(F.col("area_fraction"), q.area_anchor))
        .withColumn("vincents_artefacts", artefacts(F.col("artifact_fraction"), pixels, q.artifact_anchor))
        .withColumn("centerness", centerness(F.col("cy"), F.col("cx"), pixels, height, width, q.border_zone))
    )


def weighted(parts: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in parts)
    return sum((c * w for c, w in parts[1:]), parts[0][0] * parts[0][1]) / total


def score(df: DataFrame, q: Quality, height: int, width: int, without: tuple[str, ...] = ()) -> DataFrame:
    """df with the components, quality (their weighted mean) and confidence (their product, which feeds nothing)."""
    out = components(df, q, height, width)
    used = [(F.col(n), w) for n, w in q.weights if n not in without]
    product = F.lit(1.0)
    for name, _ in q.weights:
        product = product * F.col(name)
    return out.withColumn("quality", weighted(used)).withColumn("confidence", product)


def floors(df: DataFrame, cfg: Floor, views: int, value: str = "quality", by: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """(by..., floor): a low percentile, not under absolute_min, lowered until minimum_pool and `views` rows stay."""
    keep = max(cfg.minimum_pool, views)
    rank = Window.partitionBy(*by).orderBy(F.desc(value))
    ranked = df.withColumn("__k", F.row_number().over(rank)).where(F.col("__k") <= keep)
    kth = ranked.groupBy(*by).agg(F.max(F.when(F.col("__k") == views, F.col(value))).alias("__views"), F.max(F.when(F.col("__k") == keep, F.col(value))).alias("__keep"))
    base = df.groupBy(*by).agg(F.min(value).alias("__min"), F.count("*").alias("__n")).join(quantiles(df, list(by), [("__p", value, cfg.percentile)]), list(by))
    floor = F.greatest("__p", F.lit(cfg.absolute_min))
    floor = F.when(F.col("__n") >= keep, F.least(floor, F.col("__keep"))).otherwise(floor)
    return base.join(kth, list(by)).select(*by, F.when(F.col("__n") <= views, F.col("__min")).otherwise(F.least(floor, F.col("__views"))).alias("floor"))


def selection_pool(df: DataFrame, floor: DataFrame, value: str = "quality", by: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """Rows at or over their object's floor; a floor of 0 or less drops none."""
    return df.join(floor, list(by)).where((F.col("floor") <= 0) | (F.col(value) >= F.col("floor"))).drop("floor")


def ranges(df: DataFrame, stat: str, by: list[str]) -> DataFrame:
    """df with low and high, the ends of its population's range of the statistic: one aggregation, joined back."""
    return df.join(df.groupBy(*by).agg(F.min(stat).alias("low"), F.max(stat).alias("high")), by, "left")


def minmax(value: Column, low: Column, high: Column) -> Column:
    """value on its population's range (ranges()); a flat population gives 0."""
    return F.when(high > low, clip((value - low) / (high - low), 0.0, 1.0)).otherwise(0.0)


def summary(df: DataFrame, stats: list[str], by: list[str]) -> DataFrame:
    """One row for each population and statistic: min, max, mean, median."""
    plain = df.groupBy(*by).agg(*[f(s).alias(f"{n}_{s}") for s in stats for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    wide = plain.join(quantiles(df, by, [(f"median_{s}", s, 0.5) for s in stats]), by)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), *[F.col(f"{n}_{s}").cast("double").alias(n) for n in ("min", "max", "mean", "median")]) for s in stats]))
    return wide.select(*by, each.alias("x")).select(*by, "x.*")
