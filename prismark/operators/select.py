"""Subset selection: the n best and most diverse rows of each object, in pick order.

Two strategies give the same picks. `grouped` hands an object's rows to one numpy call (fast, memory in proportion
to the object); `rounds` keeps the pool a distributed table and takes one aggregation for each pick, so an
object may hold any share of all rows. `auto` counts the rows of the largest object and takes `grouped` up to
GROUPED_ROWS only. Ties go to the lowest position everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions import vectors
from prismark.sources.tables import written

GROUPED_ROWS = 20_000
POOL = ("object_id", "pos", "embedding", "quality")
PICKS = "object_id {kind}, step int, pos bigint"


# --- numpy kernels over one object -----------------------------------------------------------------------------------


def units(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def cosine_to(unit: np.ndarray, v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return 1.0 - (unit @ (v / size) if size > 0 else np.zeros(len(unit)))


def _best(score: np.ndarray, picked: list[int]) -> int:
    score = score.copy()
    score[picked] = -np.inf
    return int(score.argmax())


def greedy_quality_diversity(x: np.ndarray, q: np.ndarray, n: int, alpha: float, beta: float, mode: str = "min", extra: np.ndarray | None = None, weight: float = 0.5) -> list[int]:
    """Starts at the best quality; then the largest alpha * quality + beta * diversity, O(N) a pick.

    mode: distance to the nearest pick (min), the farthest (max) or the mean of the picks (prototype). extra: a second
    vector for each row, whose distances make up `weight` of the diversity.
    """
    if mode not in ("min", "max", "prototype"):
        raise ValueError(f"mode must be min, max or prototype, not {mode!r}")
    spaces = [(units(x), x, 1.0 if extra is None else 1.0 - weight)] + ([] if extra is None else [(units(extra), extra, weight)])
    picks = [int(q.argmax())] if n else []
    state: list = [None] * len(spaces)
    while len(picks) < n:
        diversity = np.zeros(len(x))
        for s, (unit, raw, share) in enumerate(spaces):
            if mode == "prototype":
                state[s] = raw[picks[-1]].astype(float) if state[s] is None else state[s] + raw[picks[-1]]
                diversity += share * cosine_to(unit, state[s])
            else:
                d = cosine_to(unit, raw[picks[-1]])
                state[s] = d if state[s] is None else (np.minimum if mode == "min" else np.maximum)(state[s], d)
                diversity += share * state[s]
        picks.append(_best(alpha * q + beta * diversity, picks))
    return picks


def farthest_points(x: np.ndarray, n: int, start: int) -> list[int]:
    unit = units(x)
    picks = [start] if n else []
    near = np.full(len(x), np.inf)
    while len(picks) < n:
        near = np.minimum(near, cosine_to(unit, x[picks[-1]]))
        near[picks[-1]] = -1
        picks.append(_best(near, picks))
    return picks


def facility_location(x: np.ndarray, n: int) -> list[int]:
    """Largest total similarity (cut to 0..1) of all rows to their nearest pick; blocks bound the N x N products."""
    unit = units(x)
    if not n:
        return []

    def gains(covered: np.ndarray) -> np.ndarray:
        out = np.empty(len(unit))
        for a in range(0, len(unit), 512):
            out[a : a + 512] = np.maximum(np.clip(unit @ unit[a : a + 512].T, 0, 1), covered[:, None]).sum(axis=0)
        return out

    covered = np.zeros(len(unit))
    picks: list[int] = []
    while len(picks) < n:
        picks.append(_best(np.round(gains(covered), 9), picks))
        covered = np.maximum(covered, np.clip(unit @ unit[picks[-1]], 0, 1))
    return picks


def determinantal(x: np.ndarray, q: np.ndarray, n: int, sigma: float) -> list[int]:
    """Greedy largest determinant of q q' exp(-distance / sigma), by one Cholesky row a pick (O(n N)).

    Rows that add no volume any more are taken by position."""
    unit = units(x)
    volume = q * q * np.exp(-np.where((unit * unit).sum(axis=1) > 0, 0.0, 1.0) / sigma)
    rows = np.zeros((n, len(x)))
    picks: list[int] = []
    for k in range(n):
        left = volume.copy()
        left[picks] = -np.inf
        best = int(np.where(left > 1e-12, left, -np.inf).argmax()) if (left > 1e-12).any() else next(i for i in range(len(x)) if i not in picks)
        row = q * q[best] * np.exp(-cosine_to(unit, x[best]) / sigma)
        if volume[best] > 1e-12:
            rows[k] = (row - rows[:k].T @ rows[:k, best]) / np.sqrt(volume[best])
            volume = volume - rows[k] ** 2
        picks.append(best)
    return picks


def next_best_view(x: np.ndarray, q: np.ndarray, n: int, share: float = 0.5) -> list[int]:
    picks = [int(q.argmax())] if n else []
    total = np.zeros(len(x))
    while len(picks) < n:
        total += np.linalg.norm(x - x[picks[-1]], axis=1)
        picks.append(_best(q + share * total / len(picks), picks))
    return picks


def quality_seeds(q: np.ndarray, k: int) -> list[int]:
    return [int(i) for i in np.argsort(-q, kind="stable")[:k]]


def lloyd(x: np.ndarray, seeds: list[int], rounds: int = 300, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) of k-means from given seeds; a cluster that loses all rows keeps its centre."""
    centers = x[seeds].astype(float)
    stop = tolerance * x.var(axis=0).mean()
    labels = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        labels = _nearest(x, centers)
        moved = centers.copy()
        for c in range(len(centers)):
            if (labels == c).any():
                moved[c] = x[labels == c].mean(axis=0)
        shift, centers = ((moved - centers) ** 2).sum(), moved
        if shift <= stop:
            break
    return _nearest(x, centers), centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]).argmin(axis=1)


def neighbourhood(distance: np.ndarray, labels: np.ndarray, cluster: int, x: int) -> list[int]:
    """The x + 1 rows nearest a centre that belong to its cluster; if none does, the cluster's nearest row."""
    near = [int(p) for p in np.argsort(distance, kind="stable")[: x + 1] if labels[p] == cluster]
    members = np.flatnonzero(labels == cluster)
    return near or ([int(members[distance[members].argmin()])] if len(members) else [])


def cluster_order(q: np.ndarray, labels: np.ndarray, k: int) -> list[int]:
    """Clusters by mean quality, the best first; empty ones last."""
    mean = np.array([q[labels == c].mean() if (labels == c).any() else -np.inf for c in range(k)])
    return [int(c) for c in np.argsort(-mean, kind="stable")]


def fill_up(x: np.ndarray, q: np.ndarray, labels: np.ndarray, picks: list[int], n: int, order: list[int], share: float = 0.2) -> list[int]:
    """Takes clusters in order, each until it is empty: the largest quality + share * distance to the nearest pick."""
    unit, picks = units(x), list(picks)
    near = np.full(len(x), np.inf)
    for p in picks:
        near = np.minimum(near, cosine_to(unit, x[p]))
    for c in order:
        members = np.flatnonzero(labels == c)
        while len(picks) < n:
            free = np.array([m for m in members if m not in picks], dtype=int)
            if not len(free):
                break
            best = int(free[(q[free] + share * (near[free] if picks else 1.0)).argmax()])
            picks.append(best)
            near = np.minimum(near, cosine_to(unit, x[best]))
    return picks


def kmeans_neighbourhoods(x: np.ndarray, q: np.ndarray, n: int, k: int | None = None, xnn: int = 10, init: str = "best_quality", shapes: np.ndarray | None = None, alpha: float = 0.6, beta: float = 0.4) -> list[int]:
    """One pick from each cluster's neighbourhood, then fill_up. shapes: second vectors, whose divergence from the picks scales
    the diversity of later picks, clusters then going by mean quality."""
    if init not in ("best_quality", "farthest"):
        raise ValueError(f"init must be best_quality or farthest, not {init!r}")
    if not n:
        return []
    k = min(k or n, n)
    seeds = quality_seeds(q, k) if init == "best_quality" else farthest_points(x, k, int(q.argmax()))
    labels, centers = lloyd(x, seeds)
    unit = units(x)
    far = np.stack([cosine_to(unit, c) for c in centers])
    order = cluster_order(q, labels, k)
    picks: list[int] = []
    for c in range(k) if shapes is None else order:
        free = [p for p in neighbourhood(far[c], labels, c, xnn) if p not in picks]
        if shapes is None:
            free = free or [next(p for p in quality_seeds(q, len(q)) if p not in picks)]
            pick = free[int(q[free].argmax())]
        elif not free:
            continue
        elif not picks:
            pick = free[int(q[free].argmax())]
        else:
            outline = units(shapes)
            apart = np.stack([cosine_to(outline[free], shapes[p]) for p in picks]).mean(axis=0)
            scale = apart / apart.max() if apart.max() > 1e-12 else np.ones(len(free))
            near = np.stack([cosine_to(unit[free], x[p]) for p in picks]).min(axis=0)
            pick = free[int((alpha * q[free] + beta * scale * near).argmax())]
        picks.append(pick)
    return fill_up(x, q, labels, picks, n, order)


# --- over a pool of many objects -------------------------------------------------------------------------------------


def grouped(pool: DataFrame, choose: Callable[..., list[int]], extra: str | None = None) -> DataFrame:
    """(object_id, step, pos): choose(vectors, qualities[, extra]) for each object, its rows in order of pos."""
    kind = pool.schema["object_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        more = [np.stack(rows[extra].to_numpy()).astype(float)] if extra else []
        picks = choose(x, rows["quality"].fillna(1.0).to_numpy(dtype=float), *more)
        pos = rows["pos"].to_numpy()
        return pd.DataFrame({"object_id": [rows["object_id"].iloc[0]] * len(picks), "step": np.arange(len(picks), dtype=np.int32), "pos": pos[picks]})

    return pool.select(*POOL, *([extra] if extra else [])).groupBy("object_id").applyInPandas(run, PICKS.format(kind=kind))


def rounds(pool: DataFrame, n: int, start: Column, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(object_id, step, pos) by one distributed aggregation for each pick.

    start: what the first pick has most of. score(embedding and quality struct, array of picked vectors): what the
    next one has most of. Only the picks (n vectors an object) are joined to the pool; every round's picks
    are written to the shared folder, so that lineage stays short and executors may be lost.
    """
    rows = pool.select(*POOL).withColumn("quality", F.coalesce(F.col("quality"), F.lit(1.0)))
    row = F.struct("pos", "embedding", "quality")

    first = rows.groupBy("object_id").agg(F.max_by(row, F.struct(start, -F.col("pos"))).alias("p"))
    picks = written(first.select("object_id", F.array("p.pos").alias("at"), F.array("p.embedding").alias("vs")), "picks")
    for _ in range(n - 1):
        left = rows.join(picks, "object_id").where(~F.array_contains("at", F.col("pos")))
        best = left.groupBy("object_id").agg(F.max_by(row, F.struct(score(F.struct("embedding", "quality"), F.col("vs")), -F.col("pos"))).alias("p"))
        grown = picks.join(best, "object_id", "left")
        more = F.col("p").isNotNull()
        picks = written(grown.select("object_id", F.when(more, F.concat("at", F.array("p.pos"))).otherwise(F.col("at")).alias("at"), F.when(more, F.concat("vs", F.array("p.embedding"))).otherwise(F.col("vs")).alias("vs")), "picks")
    return picks.select("object_id", F.posexplode("at").alias("step", "pos"))


def largest_object(pool: DataFrame) -> int:
    return pool.groupBy("object_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _auto(pool: DataFrame, strategy: str, in_group: Callable[[], DataFrame], in_rounds: Callable[[], DataFrame]) -> DataFrame:
    if strategy not in ("auto", "grouped", "rounds"):
        raise ValueError(f"strategy must be auto, grouped or rounds, not {strategy!r}")
    if strategy == "grouped" or strategy == "auto" and largest_object(pool) <= GROUPED_ROWS:
        return in_group()
    return in_rounds()


def select_gqd(pool: DataFrame, n: int = 10, alpha: float = 0.5, beta: float = 0.5, mode: str = "min", strategy: str = "auto") -> DataFrame:
    def score(r: Column, picked: Column) -> Column:
        if mode == "prototype":
            size = F.size(picked[0])
            mean = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(picked, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")))
            far = vectors.cosine_distance(r["embedding"], mean)
        else:
            each = F.transform(picked, lambda v: vectors.cosine_distance(r["embedding"], v))
            far = F.array_min(each) if mode == "min" else F.array_max(each)
        return alpha * r["quality"] + beta * far

    return _auto(pool, strategy, lambda: grouped(pool, lambda x, q: greedy_quality_diversity(x, q, min(n, len(x)), alpha, beta, mode)), lambda: rounds(pool, n, F.col("quality"), score))


def select_fps(pool: DataFrame, n: int = 10, start: str = "first", strategy: str = "auto") -> DataFrame:
    """start: first (lowest position) or best (highest quality)."""
    begin = -F.col("pos") if start == "first" else F.col("quality")

    def score(r: Column, picked: Column) -> Column:
        return F.array_min(F.transform(picked, lambda v: vectors.cosine_distance(r["embedding"], v)))

    return _auto(pool, strategy, lambda: grouped(pool, lambda x, q: farthest_points(x, min(n, len(x)), 0 if start == "first" else int(q.argmax()))), lambda: rounds(pool, n, begin, score))


def select_nbv(pool: DataFrame, n: int = 10, strategy: str = "auto") -> DataFrame:
    def score(r: Column, picked: Column) -> Column:
        far = F.aggregate(F.transform(picked, lambda v: vectors.euclidean(r["embedding"], v)), F.lit(0.0), lambda s, d: s + d)
        return r["quality"] + 0.5 * far / F.size(picked)

    return _auto(pool, strategy, lambda: grouped(pool, lambda x, q: next_best_view(x, q, min(n, len(x)))), lambda: rounds(pool, n, F.col("quality"), score))


def select_descriptors(pool: DataFrame, extra: str, n: int = 10, alpha: float = 0.5, beta: float = 0.5, weight: float = 0.5) -> DataFrame:
    return grouped(pool, lambda x, q, s: greedy_quality_diversity(x, q, min(n, len(x)), alpha, beta, "min", s, weight), extra)


def select_facility_location(pool: DataFrame, n: int = 10) -> DataFrame:
    return grouped(pool, lambda x, q: facility_location(x, min(n, len(x))))


def select_dpp(pool: DataFrame, n: int = 10, sigma: float = 0.5) -> DataFrame:
    return grouped(pool, lambda x, q: determinantal(x, q, min(n, len(x)), sigma))


def select_kmeans_xnn(pool: DataFrame, n: int = 10, k: int | None = None, xnn: int = 10, init: str = "best_quality", shapes: str | None = None) -> DataFrame:
    if shapes:
        return grouped(pool, lambda x, q, s: kmeans_neighbourhoods(x, q, min(n, len(x)), k, xnn, init, s), shapes)
    return grouped(pool, lambda x, q: kmeans_neighbourhoods(x, q, min(n, len(x)), k, xnn, init))
