"""Exact percentiles of populations of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismark.sources.tables import written

#: Distinct values of one population that a task may hold.
MOST = 1 << 17
BINS = 1024


def quantiles(df: DataFrame, by: list[str], wanted: list[tuple[str, str, float]], most: int = MOST) -> DataFrame:
    """(by..., names...): for each (name, statistic, share) the percentile between the two nearest rows, as in a sorted list; nulls don't count.

    Populations of up to `most` rows are aggregated by percentile(), which holds their distinct values. If any is larger,
    ranks are narrowed down by counted histograms instead: no task holds more than bins, or `most` values at the end.
    Both give the same numbers.
    """
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return df.groupBy(*by).agg(*[F.percentile(stat, share).alias(name) for name, stat, share in wanted])
    return _narrowed(df, by, wanted, most)


def _narrowed(df: DataFrame, by: list[str], wanted: list[tuple[str, str, float]], most: int) -> DataFrame:
    stats = list(dict.fromkeys(stat for _, stat, _ in wanted))
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])).alias("x")).select(*by, "x.*").where("v is not null")
    ends = long.groupBy(*by, "stat").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(stat).alias("of"), F.lit(share).alias("share"), F.lit(side).alias("side")) for name, stat, share in wanted for side in (0, 1)]))
    at = F.col("share") * (F.col("n") - 1)
    state = ends.withColumn("a", asked).select(*by, "stat", "n", "lo", "hi", "a.*").where("of = stat")
    state = state.select(*by, "stat", "name", "side", F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at)).alias("rank"), (at - F.floor(at)).alias("part"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    cols = state.columns
    state = written(state, "ranks")
    wide = (F.col("hi") > F.col("lo")) & (F.col("inside") > most)
    while not state.where(wide).isEmpty():
        todo = state.where(wide).select(*[F.col(c).alias(f"s_{c}" if c in (*by, "stat") else c) for c in cols])
        match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*by, "stat")])
        within = long.join(todo, match).where("v between lo and hi")
        step = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))  # halves: no overflow
        keys = [*by, "stat", "name", "side", "rank", "part", "below"]
        bins = within.groupBy(*keys, step.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("l"), F.max("v").alias("h"))
        upto = F.sum("c").over(Window.partitionBy(*by, "name", "side").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows at most
        hit = bins.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        narrowed = hit.select(*by, "stat", "name", "side", "rank", "part", F.col("l").alias("lo"), F.col("h").alias("hi"), (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside"))
        state = written(state.where(~wide).unionByName(narrowed), "ranks")
    found = state.where("hi = lo").select(*by, "name", "side", "part", F.col("lo").alias("v"))
    left = state.where("hi > lo").select(*[F.col(c).alias(f"s_{c}" if c in (*by, "stat") else c) for c in cols])
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*by, "stat")])
    few = long.join(left, match).where("v between lo and hi").groupBy(*by, "name", "side", "part", "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # `most` values at most
    found = found.unionByName(few.select(*by, "name", "side", "part", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v")))
    value = F.max(F.when(F.col("side") == 0, F.col("v"))) * (1 - F.max("part")) + F.max(F.when(F.col("side") == 1, F.col("v"))) * F.max("part")
    names = [name for name, _, _ in wanted]
    per = found.groupBy(*by, "name").agg(value.alias("value"))
    return per.groupBy(*by).pivot("name", names).agg(F.first("value"))
