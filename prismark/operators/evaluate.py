"""What a selection is worth: spread, quality, coverage and its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions.quantiles import quantiles
from prismark.operators.neighbors import nearest_selected, pair_distances
from prismark.sources.tables import written


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def picked_rows(pool: DataFrame, picks: DataFrame) -> DataFrame:
    return pool.join(picks, ["object_id", "pos"])


def intra_set(pool: DataFrame, picks: DataFrame) -> DataFrame:
    rows = picked_rows(pool, picks).select("object_id", F.col("step").cast("bigint").alias("pos"), "embedding")
    d = pair_distances(rows, rows).where("i < j")
    per = d.groupBy("object_id").agg(F.avg("dist").alias("a"), F.min("dist").alias("b"), F.max("dist").alias("c"), F.avg(1 - F.col("dist")).alias("s"))
    counts = rows.groupBy("object_id").agg(F.count("*").alias("n_selected"))
    return counts.join(per, "object_id", "left").select("object_id", "n_selected", _or0(F.col("a")).alias("mean_distance"), _or0(F.col("b")).alias("min_distance"), _or0(F.col("c")).alias("max_distance"), _or0(F.col("s")).alias("mean_similarity"))


def quality_metrics(pool: DataFrame, picks: DataFrame) -> DataFrame:
    marked = pool.join(picks.select("object_id", "pos", F.lit(True).alias("s")), ["object_id", "pos"], "left")
    chosen = F.when(F.col("s"), F.col("quality"))
    return marked.groupBy("object_id").agg(F.avg(chosen).alias("selected_mean"), F.min(chosen).alias("selected_min"), F.max(chosen).alias("selected_max"), F.avg("quality").alias("pool_mean"), F.min("quality").alias("pool_min"), F.count("*").alias("pool_count"))


def coverage(pool: DataFrame, picks: DataFrame) -> DataFrame:
    near = written(nearest_selected(pool, picks), "near")
    per = near.groupBy("object_id").agg(F.avg("dist").alias("m"), F.count_if(F.col("dist") <= 0.5).alias("w5"), F.count_if(F.col("dist") <= 0.3).alias("w3"), F.count("*").alias("n")).join(quantiles(near, ["object_id"], [("d", "dist", 0.5)]), "object_id")
    objects = pool.select("object_id").distinct()
    zero = F.lit(0).cast("bigint")
    return objects.join(per, "object_id", "left").select("object_id", _or0(F.col("m")).alias("mean_min_distance"), _or0(F.col("d")).alias("median_min_distance"), F.coalesce("w5", zero).alias("within_05"), F.coalesce("w3", zero).alias("within_03"), F.coalesce("n", zero).alias("total_unselected"))


def selection_log(pool: DataFrame, picks: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(object_id, step, pos, quality, min_distance, score): each pick's distance to those before it, null for the first."""
    rows = picked_rows(pool, picks).select("object_id", F.col("step").cast("bigint").alias("pos"), "embedding")
    before = pair_distances(rows, rows).where("j < i").groupBy("object_id", F.col("i").cast("int").alias("step")).agg(F.min("dist").alias("min_distance"))
    return picked_rows(pool, picks).join(before, ["object_id", "step"], "left").select("object_id", "step", "pos", "quality", "min_distance", (alpha * F.col("quality") + beta * F.col("min_distance")).alias("score"))


def run_report(rows: DataFrame, pool: DataFrame, picks: DataFrame) -> DataFrame:
    """Counters and id lists of each object. Lists of ids, not rows, are gathered: one report for each object is the result."""
    ids = lambda c: F.array_sort(F.collect_list(c))
    ok = F.col("rejection_reason").isNull()
    base = rows.groupBy("object_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), ids(F.when(~ok, F.col("pos"))).alias("rejected_ids"))
    pooled = pool.groupBy("object_id").agg(F.count("*").alias("pool_count"))
    chosen = picks.groupBy("object_id").agg(F.count("*").alias("selected"), ids("pos").alias("selected_ids"))
    none = F.array().cast("array<bigint>")
    return base.join(pooled, "object_id", "left").join(chosen, "object_id", "left").select(
        "object_id", "total", "accepted", "rejected", F.coalesce("pool_count", F.lit(0).cast("bigint")).alias("pool_count"), F.coalesce("selected", F.lit(0).cast("bigint")).alias("selected"),
        F.array_join(F.transform("rejected_ids", lambda x: x.cast("string")), ",").alias("rejected_ids"), F.array_join(F.transform(F.coalesce("selected_ids", none), lambda x: x.cast("string")), ",").alias("selected_ids"),
    )
