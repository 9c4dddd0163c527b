"""SimHash fingerprints and their near-duplicate classes, compared bit plane by bit plane."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import add_columns, as_bytes, cut, field, local_roots, map_runs, table
from prismark.llm.components import components

BITS = 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text (UTF-8): A-Z lower-cased, words parted by ASCII white space, shingles hashed by XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounds the unpacked bits of a long text
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprinter(shingle: int, seed: int):
    def make():
        return lambda texts: [np.array([fingerprint(t, shingle, seed) for t in as_bytes(texts)], dtype=np.uint64).view(np.int64)]

    return make


def with_fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 3, seed: int = 42) -> DataFrame:
    """df with fingerprint (long: the 64 bits). Null and empty texts: 0. Columns pass through; fingerprint is replaced."""
    return add_columns(df, [text], [field("fingerprint", "long")], _fingerprinter(shingle, seed), keep)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints: row b holds bit b of each, 64 fingerprints to a word, the rest zero."""
    n = -(-len(values) // 64) * 64
    bits = np.zeros((BITS, n), dtype=np.uint8)
    bits[:, : len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def within(left: np.ndarray, right: np.ndarray, radius: int = 3) -> np.ndarray:
    """Boolean (left, right): fingerprints that differ in at most `radius` bits.

    right stands in bit planes. For every fingerprint of left a counter of each distance is kept bit-sliced: a
    word of each counter place for 64 distances. Three planes at a time go through a carry-save adder, whose sum
    and carry words ripple into the counters; what passes the radius stays marked in `over`. A row whose whole
    block is over is abandoned.
    """
    side = planes(right)
    out = np.zeros((len(left), len(right)), dtype=bool)
    places = max(1, radius.bit_length())
    alive = np.arange(len(left))
    full = np.full((len(left), side.shape[1]), 0, dtype=np.uint64)
    if len(right) % 64:
        full[:, -1] = np.uint64(((1 << 64) - 1) ^ ((1 << (len(right) % 64)) - 1))  # no fingerprints there
    over = full
    count = np.zeros((places, *over.shape), dtype=np.uint64)
    query = -((left[:, None] >> np.arange(BITS, dtype=np.uint64)[None, :]) & np.uint64(1))  # all ones where the bit is set

    def add(word: np.ndarray, place: int) -> None:
        for p in range(place, places):
            word, count[p] = count[p] & word, count[p] ^ word
        np.bitwise_or(over, word, out=over)

    def step(bits: tuple[int, ...]) -> None:
        xs = [side[b][None, :] ^ query[:, b][:, None] for b in bits]
        if len(xs) == 3:
            half = xs[0] ^ xs[1]
            add(half ^ xs[2], 0)
            if places > 1:
                add((xs[0] & xs[1]) | (half & xs[2]), 1)
            else:
                np.bitwise_or(over, (xs[0] & xs[1]) | (half & xs[2]), out=over)
        else:
            for x in xs:
                add(x, 0)

    top = np.uint64((1 << 64) - 1)
    for at in range(0, BITS, 3):
        step(tuple(range(at, min(at + 3, BITS))))
        if at % 12 == 9:
            left_over = ~(over == top).all(axis=1)
            if not left_over.all():
                alive, over, query = alive[left_over], over[left_over], query[left_over]
                count = np.ascontiguousarray(count[:, left_over])
                if not len(alive):
                    return out
    if radius + 1 != 1 << places:  # the counters' range reaches past the radius
        values = np.zeros((len(alive), side.shape[1] * 64), dtype=np.int64)
        for p in range(places):
            values += np.unpackbits(count[p].view(np.uint8), axis=1, bitorder="little").astype(np.int64) << p
        far = values[:, : len(right)] > radius
    else:
        far = False
    out[alive] = (np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")[:, : len(right)] == 1) & ~np.asarray(far)
    return out


def block_keys(n: int, radius: int, rows: int) -> list[tuple[tuple[int, int], ...]]:
    """Tables of (shift, width) pieces of the bits, such that fingerprints within the radius agree on all pieces of
    at least one table, and random ones share a key with about `rows` of n others.

    The bits fall into m blocks; `radius` differing bits leave m - radius blocks alike, so a table stands for each
    choice of that many. The fewest blocks are taken whose keys are wide enough for n. Any choice is exact.
    """
    need = max(0, int(np.ceil(np.log2(max(1, n / rows)))))
    m = radius + 1
    while (m - radius) * (BITS // m) < need and m < BITS:
        m += 1
    width = BITS // m
    take = min(width, -(-need // (m - radius)))
    return [tuple((b * width, take) for b in chosen) for chosen in combinations(range(m), m - radius)]


def _key(bits: Column, pieces: tuple[tuple[int, int], ...]) -> Column:
    out, used = F.lit(0).cast("long"), 0
    for shift, width in pieces:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")), used))
        used += width
    return out


def _linker(radius: int):
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            side = batch.column(4).to_numpy()
            bits = batch.column(5).to_numpy().view(np.uint64)
            ids = batch.column(6).to_numpy()
            i, j = batch.column(2)[0].as_py(), batch.column(3)[0].as_py()
            n = len(bits)
            match = np.zeros((n, n), dtype=bool)
            if i == j:
                match = within(bits, bits, radius)
            else:
                a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
                if not len(a) or not len(b):
                    return None
                found = within(bits[a], bits[b], radius)
                match[np.ix_(a, b)] = found
                match[np.ix_(b, a)] = found.T
            np.fill_diagonal(match, False)
            some = np.flatnonzero(match.any(axis=1))
            if not len(some):
                return None
            roots = local_roots(match[np.ix_(some, some)], ids[some])
            moved = roots != ids[some]
            return pa.RecordBatch.from_arrays([pa.array(ids[some][moved]), pa.array(roots[moved])], names=["u", "v"])

        return run

    return make


def deal_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows(t, key, id, ...) with i, j and chunk: keys with over `block` rows are cut into chunks by a hash of id, and every
    pair of chunks (i <= j) meets in a group of its own; other keys are one group. No group exceeds about twice the block."""
    # written first: the planner then knows its size, and sends it to the rows if it is small, which spares them a shuffle
    counts = cut(rows.groupBy("t", "key").agg(F.count("*").alias("__n")).where(F.col("__n") > block), "hot")
    chunks = F.coalesce(F.ceil(F.col("__n") / block), F.lit(1)).cast("int")
    at = rows.join(counts, ["t", "key"], "left").withColumn("__chunks", chunks).withColumn("chunk", F.expr("cast(pmod(xxhash64(id), __chunks) as int)"))
    with_each = at.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    return with_each.withColumn("i", F.least("chunk", "__j")).withColumn("j", F.greatest("chunk", "__j")).drop("__n", "__chunks", "__j")


def classes(rows: DataFrame, radius: int = 3, rows_in_key: int = 512, block: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """(fingerprint, component_id) of every fingerprint in rows(id_col, fingerprint); component_id is the smallest id
    reachable over fingerprints that differ in at most `radius` bits.

    Equal fingerprints become one representative first (combined before the shuffle), so copies never meet in pairs.
    Representatives are dealt out by exact block keys; keys that many share are cut into blocks of bounded size that
    meet pairwise. Each block yields at most one link for each member. An empty table gives an empty table; a null
    id is only a component's id where no row of it has one.
    """
    reps = cut(rows.groupBy("fingerprint").agg(F.min(id_col).alias("id")), "reps")
    n = reps.count()
    keyed = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("fingerprint"), p).alias("key")) for t, p in enumerate(block_keys(n, radius, rows_in_key))]))
    spread = reps.where("id is not null").select(keyed.alias("k"), "fingerprint", "id").select("k.t", "k.key", "fingerprint", "id")
    dealt = deal_blocks(spread, block).select("t", "key", "i", "j", "chunk", "fingerprint", "id")
    links = map_runs(dealt, ["t", "key", "i", "j"], _linker(radius), T.StructType([field("u", "long"), field("v", "long")]))
    found = components(links)
    return reps.join(found, reps.id == found.node, "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row for each row of df: id_col, fingerprint (long), component_id (smallest id reachable).

    Null and empty texts have fingerprint 0 and are copies of one another. Whole texts count, however long. Repeated
    rows are copies. Rows with a null id are compared through their copies only. An empty table gives none. Other
    columns are left out, whatever their names.
    """
    prints = cut(with_fingerprint(df, text, keep=[id_col]), "fingerprints")
    # many rows may share a fingerprint: a plain equi-join, which AQE splits
    return prints.join(classes(prints, radius, id_col=id_col), "fingerprint").select(id_col, "fingerprint", "component_id")


def hexed(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def op3_simhash_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexed(F.col("fingerprint")).alias("fingerprint"), "component_id")
