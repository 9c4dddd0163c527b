"""The contract of embedding models, and what runs without learned weights."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (part of a model's name, type), in the order they are tried (fixed values).
NAMES = (("dinov3", "dinov3"), ("dinov2", "dinov2"), ("siglip2", "siglip2"), ("siglip", "siglip"), ("moonvit", "moonvit"), ("eva", "eva_clip"), ("clip", "clip"))


def infer_type(name: Column) -> Column:
    """The embedding type that a model's name stands for; unknown if none."""
    out = F.when(F.lit(False), F.lit(""))
    for part, kind in NAMES:
        out = out.when(F.lower(name).contains(part), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


class Embedder(Protocol):
    """A model, loaded once in each worker. Learned backbones are plugged in here; none is shipped."""

    dimension: int

    def set_background(self, background: int | None) -> None: ...

    def encode(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


class MeanPool:
    """A deterministic stand-in: mean grey of a grid of cells inside the mask, of length one."""

    def __init__(self, cells: int = 4):
        self.cells, self.dimension, self.background = cells, cells * cells, 0

    def set_background(self, background: int | None) -> None:
        self.background = background or 0

    def encode(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        on = np.where(mask > 0, image, self.background).astype(float)
        rows = np.array_split(np.arange(on.shape[0]), self.cells)
        cols = np.array_split(np.arange(on.shape[1]), self.cells)
        v = np.array([on[np.ix_(r, c)].mean() if len(r) and len(c) else 0.0 for r in rows for c in cols])
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v


def embed(df: DataFrame, make, height: int, width: int) -> DataFrame:
    """object_id, pos, embedding of df's gray and mask arrays; make() loads the model once in each task."""
    src = df.select("object_id", "pos", "gray", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            if b.num_rows:
                images, masks = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width) for i in (2, 3))
                rows = [model.encode(i, m).tolist() for i, m in zip(images, masks, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, type=pa.list_(pa.float64()))], names=["object_id", "pos", "embedding"])

    return src.mapInArrow(run, T.StructType([src.schema["object_id"], src.schema["pos"], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
