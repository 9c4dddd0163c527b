"""Frames from the vector table: each vector of 64 is an 8 x 8 frame (grey, mask, hand mask)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.config import Kernels
from prismark.functions import pixels, shapes

SIDE = 8


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, pos, embedding, quality."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("label").alias("object_id"), F.col("vec_id").alias("pos"), "embedding", (0.5 + 0.5 * F.col("embedding")[0].cast("double")).alias("quality"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, pos, and the arrays mask, gray and hand, row by row."""
    e = F.transform("embedding", lambda v: v.cast("double"))

    def on(v, i):
        y, x = F.floor(i / SIDE), i % SIDE
        inner = (x >= 1) & (x <= SIDE - 2) & (y >= 1) & (y <= SIDE - 2)
        return ((F.col("pos") % 50 != 0) & ((inner & (v > 0)) | (v > 0.30))).cast("int")

    below = F.concat(F.slice("e", SIDE + 1, SIDE * (SIDE - 1)), F.slice("e", 1, SIDE))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("object_id"), F.col("vec_id").alias("pos"), e.alias("e"))
    gray = F.transform("e", lambda v: F.least(F.greatest(F.floor(128 + 512 * v), F.lit(0)), F.lit(255)).cast("int"))
    return rows.select("object_id", "pos", F.transform("e", on).alias("mask"), gray.alias("gray"), F.transform(below, lambda v: (v > 0.12).cast("int")).alias("hand"))


def _stack(column: pa.Array, height: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width)


def with_stats(df: DataFrame, kernels: Kernels, height: int = SIDE, width: int = SIDE, keep: tuple[str, ...] = ("object_id", "pos")) -> DataFrame:
    """keep and all statistics, from one Arrow pass over whole batches of equal frames; the pixels stay behind."""
    more = ("dilated", "eroded", "opened", "closed", "grown")
    names = [*pixels.STATS, *more]
    src = df.select(*keep, "mask", "gray", "hand")
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            mask, gray, hand = (_stack(b.column(n_kept + i), height, width) for i in range(3))
            on = pixels.foreground(mask)
            stats = pixels.frame_stats(mask, gray, hand, kernels.stroke, kernels.artifact, kernels.ring)
            e = pixels.ellipse(kernels.artifact)
            made = {"dilated": pixels.dilate(on, e), "eroded": pixels.erode(on, e), "opened": pixels.opened(on, e), "closed": pixels.closed(on, e), "grown": pixels.grow(on, 1)}
            stats |= {k: v.sum(axis=(1, 2)).astype(float) for k, v in made.items()}
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_kept)] + [pa.array(stats[n], type=pa.float64()) for n in names], names=[*keep, *names])

    return src.mapInArrow(run, schema)


def with_shapes(df: DataFrame, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """object_id, pos, solidity, extent, convexity, completeness: null where there is no contour or area."""
    src = df.select("object_id", "pos", "mask")
    names = ("solidity", "extent", "convexity", "completeness")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = [shapes.completeness(m) or (None,) * 4 for m in _stack(b.column(2), height, width)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, type=pa.float64()) for c in zip(*rows, strict=True)]], names=["object_id", "pos", *names])

    return src.mapInArrow(run, T.StructType([src.schema["object_id"], src.schema["pos"], *[T.StructField(n, T.DoubleType()) for n in names]]))


def with_descriptor(df: DataFrame, name: str, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """object_id, pos, embedding: a shape descriptor of each mask."""
    src = df.select("object_id", "pos", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = shapes.describe_all(_stack(b.column(2), height, width), name)
                rows = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], names=["object_id", "pos", "embedding"])

    return src.mapInArrow(run, T.StructType([src.schema["object_id"], src.schema["pos"], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def with_inputs(df: DataFrame, name: str, size: int = 224, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """object_id, pos, height, width, pixels (row by row) of what a model is given: masked_crop, square_crop, or contrast_input,
    contrast_alpha and contrast_mask on the background in the column of that name. Grey frames, so one channel."""
    plain = name in ("masked_crop", "square_crop")
    src = df.select("object_id", "pos", "gray", "mask", *([] if plain else ["background"]))
    made = {
        "masked_crop": lambda g, m, b: pixels.masked_crop(g, m), "square_crop": lambda g, m, b: pixels.contrast_input(g[..., None], m, None, size=size)[..., 0],
        "contrast_input": lambda g, m, b: pixels.contrast_input(g[..., None], m, b, 1, size)[..., 0], "contrast_alpha": lambda g, m, b: pixels.region_alpha(m, 1, size), "contrast_mask": lambda g, m, b: pixels.contrast_mask(m, 1, size),
    }[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # pictures are larger than frames
                b = whole.slice(at, 256)
                grays, masks = _stack(b.column(2), height, width), _stack(b.column(3), height, width)
                backs = [None] * b.num_rows if plain else b.column(4).to_pylist()
                out = [made(g.astype(np.uint8), m, c) for g, m, c in zip(grays, masks, backs, strict=True)]
                sides = [pa.array([o.shape[k] for o in out], type=pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sides, pa.array([o.ravel().astype(np.int32) for o in out], type=pa.list_(pa.int32()))], names=["object_id", "pos", "height", "width", "pixels"])

    return src.mapInArrow(run, T.StructType([src.schema["object_id"], src.schema["pos"], T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.IntegerType()))]))


#: The same encoding and statistics in SQL: px (pixels), st (one row of statistics for each frame).
PX_SQL = """
px as (
  select pos, object_id, (i - 1) // 8 as y, (i - 1) % 8 as x, e[((i + 7) % 64) + 1] > 0.12 as h,
    least(greatest(cast(floor(128 + 512 * e[i]) as int), 0), 255) as g,
    pos % 50 <> 0 and (((i - 1) % 8 between 1 and 6 and (i - 1) // 8 between 1 and 6 and e[i] > 0) or e[i] > 0.30) as m
  from (select vec_id as pos, label as object_id, embedding::double[] as e from embeddings), (select unnest(range(1, 65)) as i))"""

ST_SQL = (
    PX_SQL
    + """,
mo as materialized (
  select a.pos, a.object_id, a.y, a.x, any_value(a.m) as m, any_value(a.h) as h, any_value(a.g) as g,
    bool_or(b.m) filter (where abs(a.y - b.y) + abs(a.x - b.x) <= 1) as d, bool_and(b.m) filter (where abs(a.y - b.y) + abs(a.x - b.x) <= 1) as e,
    bool_or(b.m) as d8, bool_and(b.m) as e8
  from px a join px b on a.pos = b.pos and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all),
oc as (
  select a.pos, a.y, a.x, bool_or(b.e) as op, bool_and(b.d) as cl from mo a join mo b on a.pos = b.pos and abs(a.y - b.y) + abs(a.x - b.x) <= 1 group by all),
kk(dy, dx, l8, l4, sx, sy) as (values (-1,-1,2,0,-1,-1), (-1,0,0,1,0,-2), (-1,1,2,0,1,-1), (0,-1,0,1,-2,0), (0,0,-8,-4,0,0), (0,1,0,1,2,0), (1,-1,2,0,-1,1), (1,0,0,1,0,2), (1,1,2,0,1,1)),
cv as (
  select a.pos, a.y, a.x, sum(l8 * b.g) as l8, sum(l4 * b.g) as l4, sqrt(sum(sx * b.g) ** 2 + sum(sy * b.g) ** 2) as ten
  from px a cross join kk join px b on b.pos = a.pos
    and b.y = case when a.y + dy < 0 then 1 when a.y + dy > 7 then 6 else a.y + dy end and b.x = case when a.x + dx < 0 then 1 when a.x + dx > 7 then 6 else a.x + dx end
  group by a.pos, a.y, a.x),
al as (select * from mo join oc using (pos, y, x) join cv using (pos, y, x)),
s0 as (
  select object_id, pos, count(*) filter (where m)::double as pixel_count, (count(*) filter (where m) / 64.0)::double as area_fraction,
    max(case when m and (y in (0, 7) or x in (0, 7)) then 1.0 else 0.0 end)::double as touches_border,
    count(*) filter (where op <> cl)::double as artifact_pixels, count(*) filter (where d <> e)::double as band_pixels,
    coalesce(var_pop(l8) filter (where d <> e), 0)::double as laplacian, coalesce(avg(ten) filter (where d <> e), 0)::double as tenengrad,
    var_pop(l4)::double as global_laplacian, avg(ten)::double as global_tenengrad,
    count(*) filter (where m and (y in (0, 7) or x in (0, 7)))::double as ring,
    count(*) filter (where m and y = 0)::double as et, count(*) filter (where m and y = 7)::double as eb, count(*) filter (where m and x = 0)::double as el, count(*) filter (where m and x = 7)::double as er,
    greatest(count(distinct case when m then y end), 1)::double as n_rows, greatest(count(distinct case when m then x end), 1)::double as n_cols,
    count(*) filter (where m and h)::double as over, coalesce(min(y) filter (where m), 0)::double as y0, coalesce(min(x) filter (where m), 0)::double as x0,
    coalesce(max(y) filter (where m), 0)::double as y1, coalesce(max(x) filter (where m), 0)::double as x1,
    coalesce(avg(y) filter (where m), 0)::double as cy, coalesce(avg(x) filter (where m), 0)::double as cx,
    count(*) filter (where m and not e8)::double as rim_pixels, coalesce(avg(g) filter (where m and not e8), 0)::double as rim_brightness,
    count(*) filter (where d)::double as dilated, count(*) filter (where e)::double as eroded, count(*) filter (where op)::double as opened, count(*) filter (where cl)::double as closed, count(*) filter (where d8)::double as grown
  from al group by object_id, pos),
st as materialized (
  select *, case when pixel_count > 0 then artifact_pixels / pixel_count else 0 end as artifact_fraction, case when pixel_count > 0 then ring / pixel_count else 0 end as border_ratio,
    et / n_cols as edge_top_ratio, eb / n_cols as edge_bottom_ratio, el / n_rows as edge_left_ratio, er / n_rows as edge_right_ratio,
    greatest(et / n_cols, eb / n_cols, el / n_rows, er / n_rows) as edge_ratio, case when pixel_count > 0 then over / pixel_count else 0 end as hand_overlap
  from s0)"""
)
