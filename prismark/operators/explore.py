"""What an explorer asks for: clusters with candidates and picks, worst examples, and reports as text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions.pixels import resize
from prismark.functions.quantiles import quantiles
from prismark.operators.select import cosine_to, farthest_points, lloyd, neighbourhood, quality_seeds, units

CLUSTERS = "object_id {kind}, cluster int, size bigint, medoid bigint, pick bigint, candidates array<bigint>"


def clusters(pool: DataFrame, k: int, init: str = "best_quality", x: int = 10) -> DataFrame:
    """One row for each cluster of each object: its size, medoid, neighbourhood and that one's best row.

    k is held between 1 and the object's rows, x to 1 at least; an unknown init means farthest. Clusters may share a pick.
    """
    kind = pool.schema["object_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        v = np.stack(rows["embedding"].to_numpy()).astype(float)
        q, pos = rows["quality"].fillna(1.0).to_numpy(dtype=float), rows["pos"].to_numpy()
        n = min(max(k, 1), len(v))
        labels, centers = lloyd(v, quality_seeds(q, n) if init == "best_quality" else farthest_points(v, n, int(q.argmax())))
        unit, out = units(v), []
        for c in range(n):
            far = cosine_to(unit, centers[c])
            near, members = neighbourhood(far, labels, c, max(x, 1)), np.flatnonzero(labels == c)
            if len(members):
                out.append((rows["object_id"].iloc[0], c, len(members), pos[members[far[members].argmin()]], pos[near[int(q[near].argmax())]], [int(pos[i]) for i in near]))
        return pd.DataFrame(out, columns=["object_id", "cluster", "size", "medoid", "pick", "candidates"])

    return pool.select("object_id", "pos", "embedding", "quality").groupBy("object_id").applyInPandas(run, CLUSTERS.format(kind=kind))


def clusters_text(found: DataFrame, pool: DataFrame) -> DataFrame:
    """(object_id, text): centroids, neighbourhoods, picks and the picks' qualities (3 digits) as JSON."""
    picks = found.join(pool.select("object_id", F.col("pos").alias("pick"), "quality"), ["object_id", "pick"])
    rows = F.array_sort(F.collect_list(F.struct("cluster", "medoid", "pick", "candidates", F.round("quality", 3).alias("quality"))))  # one entry for each cluster
    return picks.groupBy("object_id").agg(rows.alias("r")).select("object_id", F.to_json(F.struct(F.col("r.medoid").alias("centroids"), F.map_from_arrays(F.transform("r.medoid", lambda m: m.cast("string")), F.col("r.candidates")).alias("neighbours"), F.col("r.pick").alias("picks"), F.col("r.quality").alias("qualities"))).alias("text"))


def prefilter_text(rows: DataFrame, stats: list[str]) -> DataFrame:
    """(object_id, text): counts, ranges of the statistics and rejections by reason in alphabetical order."""
    ok = F.col("rejection_reason").isNull()
    ranges = [F.format_string(f"{s}: %.4f .. %.4f, mean %.4f, median %.4f", F.min(s), F.max(s), F.avg(s), F.first(f"__median_{s}")).alias(f"__{s}") for s in stats]
    rows = rows.join(quantiles(rows, ["object_id"], [(f"__median_{s}", s, 0.5) for s in stats]), "object_id")
    head = rows.groupBy("object_id").agg(F.format_string("total %d, accepted %d, rejected %d", F.count("*"), F.count_if(ok), F.count_if(~ok)).alias("__head"), *ranges)
    by = rows.where(~ok).groupBy("object_id", "rejection_reason").agg(F.count("*").alias("n"))
    lines = by.groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s: %d", "rejection_reason", "n"))), "\n").alias("__reasons"))  # one line for each reason
    return head.join(lines, "object_id", "left").select("object_id", F.concat_ws("\n", "__head", *[f"__{s}" for s in stats], F.coalesce("__reasons", F.lit("no rejections"))).alias("text"))


def worst_examples(rows: DataFrame, badness: Column, n: int, height: int, width: int, apart: float = 12.0) -> DataFrame:
    """(object_id, place, pos): the n worst rows of each object that look unlike: each differs from those before it by `apart` grey
    levels on small pictures; when no more do, the ones farthest from the chosen. rows: object_id, pos, gray."""
    kind = rows.schema["object_id"].dataType.simpleString()
    top = rows.select("object_id", "pos", "gray", badness.alias("bad")).where("bad is not null")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bad", "pos"], ascending=[False, True], kind="stable")
        small = [resize(np.asarray(v, dtype=float).reshape(height, width), 48).astype(float).ravel() for v in g["gray"]]
        chosen: list[int] = []
        near = np.full(len(small), np.inf)
        while len(chosen) < min(n, len(small)):
            free = np.array([i not in chosen for i in range(len(small))])
            good = np.flatnonzero(free & (near >= apart))
            i = int(good[0]) if len(good) else int(np.where(free, near, -1).argmax())
            chosen.append(i)
            near = np.minimum(near, [np.abs(s - small[i]).mean() for s in small])
        return pd.DataFrame({"object_id": [g["object_id"].iloc[0]] * len(chosen), "place": np.arange(len(chosen), dtype=np.int32), "pos": g["pos"].to_numpy()[chosen]})

    return top.groupBy("object_id").applyInPandas(run, f"object_id {kind}, place int, pos bigint")
