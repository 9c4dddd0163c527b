"""The data behind figures: histograms, goodness, sequences, long forms, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, stats: list[str], bins: int = 30, group: Column | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(stat, grp, bin, left, right, n) in equal bins from each statistic's minimum to maximum, or low to high; the last holds its end."""
    long = df.select((F.lit("all") if group is None else group).alias("grp"), F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])).alias("x")).select("grp", "x.stat", "x.v").where("v is not null")
    if low is None:
        ends = long.groupBy("stat").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    else:
        ends = long.groupBy("stat").agg(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = long.join(ends, "stat").where("v between lo and hi").groupBy("stat", "grp", at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return counted.select("stat", "grp", "bin", (F.col("lo") + F.col("bin") * step).alias("left"), (F.col("lo") + (F.col("bin") + 1) * step).alias("right"), "n")


def reported(value: Column, lower_is_better: bool) -> Column:
    return 1 - value if lower_is_better else value


def goodness(value: Column, low: Column, high: Column, lower_is_better: bool = False) -> Column:
    """Place on the population's range (quality.ranges), 1 is best; a flat population gives 0.5."""
    part = (value - low) / (high - low)
    return F.when(high > low, 1 - part if lower_is_better else part).otherwise(0.5)


def absolute_goodness(value: Column, lower_is_better: bool = False) -> Column:
    """Place on the fixed range 0 to 1, for statistics that are bounded by it."""
    return F.least(F.greatest(1 - value if lower_is_better else value, F.lit(0.0)), F.lit(1.0))


def round_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Both ends rounded outward to two digits; ends that meet are moved apart by a hundredth first."""
    out = lambda shift: (F.floor((low - shift) * 100) / 100, F.ceil((high + shift) * 100) / 100)
    a, b = out(0.0)
    wide = out(0.01)
    return F.when(b > a, a).otherwise(wide[0]), F.when(b > a, b).otherwise(wide[1])


def sequence(accepted: DataFrame, rejected: DataFrame, by: list[str]) -> DataFrame:
    """Both, in order of pos, with seq from 0."""
    both = accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1)


def violin_long(df: DataFrame, stats: list[str], group: Column) -> DataFrame:
    """(grp, stat, pos, value): each statistic on its global range."""
    ends = df.agg(*[f(s).alias(f"{n}_{s}") for s in stats for n, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(ends))  # one row of bounds
    scaled = [F.struct(F.lit(s).alias("stat"), F.when(F.col(f"hi_{s}") > F.col(f"lo_{s}"), (F.col(s) - F.col(f"lo_{s}")) / (F.col(f"hi_{s}") - F.col(f"lo_{s}"))).otherwise(0.0).alias("value")) for s in stats]
    return wide.select(group.alias("grp"), "object_id", "pos", F.explode(F.array(*scaled)).alias("x")).select("grp", "object_id", "pos", "x.stat", "x.value")


def weighted_sample(df: DataFrame, badness: Column, n: int, seed: int = 0, by: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """n rows of each population without replacement, with weights badness + 1e-6, by exponential keys: top k, no shuffle of all rows into order."""
    u = (F.pmod(F.xxhash64(*by, "pos", F.lit(seed)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    key = -F.log(u) / (badness + 1e-6)
    return df.withColumn("__k", key).withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy("__k", "pos"))).where(F.col("draw") <= n).drop("__k")


def overview(df: DataFrame, stats: list[str], bounded: tuple[str, ...] = (), bins: int = 40) -> DataFrame:
    """(stat, series, bin, left, right, n): series are accepted, rejected and each reason. Statistics in `bounded` stand on a
    fixed grid of bins + 1 bins from 0 to 1 + 1 / bins; a flat one on a range of one around its value."""
    long = df.select("rejection_reason", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])).alias("x")).select("rejection_reason", "x.*").where("v is not null and not isnan(v)")
    ends = long.groupBy("stat").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    fixed = F.col("stat").isin(*bounded) if bounded else F.lit(False)
    flat = F.col("hi") <= F.col("lo")
    lo = F.when(fixed, 0.0).when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(fixed, 1 + 1 / bins).when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    many = F.when(fixed, bins + 1).otherwise(bins)
    grid = ends.select("stat", lo.alias("lo"), ((hi - lo) / many).alias("step"), many.alias("many"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("step")), F.col("many") - 1).cast("int")
    series = F.explode(F.when(F.col("rejection_reason").isNull(), F.array(F.lit("accepted"))).otherwise(F.array(F.lit("rejected"), F.col("rejection_reason"))))
    counted = long.join(grid, "stat").where("v between lo and lo + step * many").select("stat", at.alias("bin"), "lo", "step", series.alias("series")).groupBy("stat", "series", "bin", "lo", "step").agg(F.count("*").alias("n"))
    return counted.select("stat", "series", "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("left"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("right"), "n")


def debug_samples(df: DataFrame, figures: int = 3, rows: int = 4, seed: int = 0) -> DataFrame:
    """(figure, place, object_id, pos): figures x rows different rows, by least seeded hash: the same on every run."""
    key = F.xxhash64("object_id", "pos", F.lit(seed))
    top = df.select("object_id", "pos", key.alias("__k")).orderBy("__k", "object_id", "pos").limit(figures * rows)
    at = F.row_number().over(Window.orderBy("__k", "object_id", "pos")) - 1  # over figures x rows rows
    return top.select(F.floor(at / rows).cast("int").alias("figure"), (at % rows).alias("place"), "object_id", "pos")


def scatter(coords: DataFrame, pool: DataFrame, picks: DataFrame, labels: DataFrame) -> DataFrame:
    """What a scatter plot shows: object_id, pos, coords, quality, cluster, step (null: not picked)."""
    key = ["object_id", "pos"]
    return coords.join(pool.select(*key, "quality"), key).join(labels.select(*key, "cluster"), key, "left").join(picks.select(*key, "step"), key, "left")
