"""Near-duplicate vectors: p-stable hashing of normalised vectors, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import add_columns, cut, field, local_roots, map_runs, table
from prismark.llm.components import components
from prismark.llm.simhash import deal_blocks

#: Bits after the point of quantised vectors and projections: their products and sums stay exact in doubles.
GRID = 20


def collision(distance: float, width: float) -> float:
    """The chance that one quantised Gaussian projection puts points this far apart into the same cell of this width."""
    if distance <= 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, rows: int, miss: float, width: float) -> tuple[int, int]:
    """(projections in a key, tables): keys so long that unlike vectors share one with about `rows` of n others, and
    so many tables that a pair exactly at the threshold meets in none with chance `miss` at most."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(2.0, n / rows)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


class Hasher:
    """Cells of quantised random projections of unit vectors, in `tables` keys of `k` cells each."""

    def __init__(self, k: int, tables: int, width: float, seed: int):
        self.k, self.tables, self.width, self.seed = k, tables, width, seed
        self._of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _drawn(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if dim not in self._of:
            rng = np.random.default_rng([self.seed, dim])
            lines = np.round(rng.standard_normal((dim, self.k * self.tables)) * (1 << 10))
            offset = np.floor(rng.random(self.k * self.tables) * self.width * (1 << (GRID + 10)))
            mix = rng.integers(1, 1 << 62, self.k, dtype=np.int64) | 1
            self._of[dim] = lines, offset, mix
        return self._of[dim]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) keys. All sums are of whole numbers below 2^53, so they don't depend on the order of addition."""
        lines, offset, mix = self._drawn(unit.shape[1])
        cells = np.floor((np.round(unit * (1 << GRID)) @ lines + offset) / (self.width * (1 << (GRID + 10)))).astype(np.int64)
        with np.errstate(over="ignore"):
            return (cells.reshape(len(unit), self.tables, self.k) * mix[None, None, :]).sum(axis=2)


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one, in doubles. Scaled by their largest component first: squares neither overflow nor vanish."""
    rows = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype("<f8")
    rows /= np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _vectors(column: pa.Array, kind: str) -> list[bytes | None]:
    """The bytes of each vector, as precise as they came; None where it is null, empty, zero or holds what is no finite number."""
    out: list[bytes | None] = []
    for x in column:
        v = None
        if x.is_valid and len(x.values):
            v = x.values.to_numpy(zero_copy_only=False).astype(kind) if not x.values.null_count else None
        if v is not None and not (np.isfinite(v).all() and v.any()):
            v = None
        out.append(None if v is None else (v + v.dtype.type(0)).tobytes())  # without negative zeros
    return out


def _block(cosine: float, hasher: Hasher, kind: str):
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            t, i, j = (batch.column(c)[0].as_py() for c in (0, 2, 3))
            side, ids, mult = (batch.column(c).to_numpy() for c in (4, 5, 6))
            t %= hasher.tables
            unit = _units(batch.column(7).to_pylist(), kind)
            match = unit @ unit.T >= cosine
            np.fill_diagonal(match, False)
            if i != j:
                match &= side[:, None] != side[None, :]
            some = np.flatnonzero(match.any(axis=1))
            if not len(some):
                return None
            match = match[np.ix_(some, some)]
            roots = local_roots(match, ids[some])
            keys = hasher.keys(unit[some])
            for before in range(t):  # a pair counts in the first table where it meets
                match &= keys[:, before][:, None] != keys[:, before][None, :]
            links = match @ mult[some].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links), pa.array(roots)], names=["node", "links", "root"])

        return run

    return make


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cosine: float = 0.95, miss: float = 1e-3, rows_in_key: int = 256, block: int = 1024, width: float = 2.0, seed: int = 7) -> DataFrame:
    """One row for each row of df: id_col, n_links, component_id, kept.

    Vectors are scaled to length one; `tables` keys of quantised Gaussian projections bucket them, and each bucket's
    vectors are compared by exact cosines in doubles. Every link found has cosine >= `cosine`; a pair exactly at the
    threshold is missed with chance `miss`, closer pairs far less often.

    Equal vectors are one representative with a count (combined before the shuffle). Buckets that many share are cut
    into blocks of bounded size that meet pairwise inside workers, so no pair becomes a row: a block yields a
    count and one link for each member. A pair counts in the first table where it meets.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a
    null id. Rows that repeat an id and vector are one vector. Vectors of unlike length never link. An empty table
    gives none. Other columns are left out, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec"))
    kind = "<f4" if rows.schema["vec"].dataType.elementType == T.FloatType() else "<f8"  # cosines are in doubles either way
    packed = add_columns(rows, ["vec"], [field("raw", "binary")], lambda: lambda v: [_vectors(v, kind)], keep=["id"])
    members = cut(packed.withColumn("same", F.when(F.col("raw").isNotNull() & F.col("id").isNotNull(), F.sha2("raw", 256))), "members")
    valid = members.where("same is not null").select("id", "same", "raw")
    each = valid.groupBy("same", "id").agg(F.any_value("raw").alias("raw"))
    reps = cut(each.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.any_value("raw").alias("raw")), "reps")
    k, tables = plan(reps.count(), cosine, rows_in_key, miss, width)
    hasher = Hasher(k, tables, width, seed)

    def keyer():
        def run(raw):
            vs = raw.to_pylist()
            out: list = [None] * len(vs)
            lens = np.array([len(v) for v in vs])
            for n in np.unique(lens):
                at = np.flatnonzero(lens == n)
                keys = hasher.keys(_units([vs[x] for x in at], kind))
                for x, row in zip(at, keys, strict=True):
                    out[x] = row.tolist()
            return [out]

        return run

    keyed = add_columns(reps, ["raw"], [T.StructField("keys", T.ArrayType(T.LongType()), True)], keyer)
    # a table for each length of vectors, so that a block's vectors are of one length
    each_key = keyed.select("id", "mult", "raw", F.posexplode("keys").alias("t", "key"))
    spread = each_key.withColumn("t", F.octet_length("raw").cast("long") * tables + F.col("t"))
    dealt = deal_blocks(spread, block).select("t", "key", "i", "j", "chunk", "id", "mult", "raw")
    found = cut(map_runs(dealt, ["t", "key", "i", "j"], _block(cosine, hasher, kind), T.StructType([field("node", "long"), field("links", "long"), field("root", "long")])), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(components(found, "node", "root"), "node", "left")
    by_class = reps.join(linked, reps.id == linked.node, "left").select("same", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # rows without a class are dealt out by their id, not all to one task
    shared = members.select("id", F.coalesce("same", F.concat(F.lit("-"), F.xxhash64("id").cast("string"))).alias("same"))
    out = shared.join(by_class, "same", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op2_p_stable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with recursive v as materialized (
  select distinct vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
p as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id, vec_id as c from v union select p.b, r.c from r join p on p.a = r.vec_id),
n as (select a as vec_id, count(distinct b) as n from p group by a),
c as (select vec_id, min(c) as c from r group by vec_id)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id)::bigint as component_id, coalesce(c, vec_id) is not distinct from vec_id as kept
from embeddings left join n using (vec_id) left join c using (vec_id)"""
