"""Contiguous shards of near-equal bytes, from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismark.llm.common import cut, table


def text_size(text: Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of a text (null: none) plus what each record costs besides."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead).cast("long")


def assign_shards(df: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (place in its shard, gapless from 0) to a narrow table.

    Rows are put into one global order: range partitions by `order` (rows that tie there are told apart by their
    place in the input, so that a key that a third of the rows share is split too). Each partition gives its
    total; running totals over partitions (one row for each) are joined back to the running sums inside, which
    gives every row's bytes before it without one task that sees all rows. A row goes to the shard in which
    its middle byte falls, with cuts at equal targets: a shard is off its target by at most half of the rows at
    its two ends.

    Null keys come first. Rows of size 0 or less count as 0. An empty table gives an empty table. Columns of df
    pass through; shard, slot and names that start with __ are replaced.
    """
    df = df.drop("shard", "slot", "__part", "__row", "__size", "__start", "__nth", "__rows", "__bytes", "__before", "__rows_before", "__first")
    placed = df.withColumn("__size", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")).withColumn("__row", F.monotonically_increasing_id())
    ranged = cut(placed.repartitionByRange(*order, "__row").withColumn("__part", F.spark_partition_id()), "shards")

    totals = ranged.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(every).alias("__bytes"),
    )
    inside = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order], "__row")
    summed = ranged.withColumn("__start", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).withColumn("__nth", F.row_number().over(inside) - 1)
    # as many rows as partitions: bounded by spark.sql.shuffle.partitions, whatever the data
    at = summed.join(F.broadcast(offsets), "__part")
    middle = 2 * (F.col("__before") + F.col("__start")) + F.col("__size")
    shard = F.expr(f"cast(({shards} * `__middle`) div greatest(2 * `__bytes`, 1) as int)")
    cast = at.withColumn("__middle", middle).withColumn("shard", F.least(shard, F.lit(shards - 1))).withColumn("__nth", F.col("__rows_before") + F.col("__nth"))
    cast = cut(cast.drop("__middle", "__before", "__rows_before", "__bytes", "__start", "__size", "__part", "__row"), "shards")
    firsts = cast.groupBy("shard").agg(F.min("__nth").alias("__first"))  # one row for each shard
    return cast.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("__nth") - F.col("__first")).drop("__nth", "__first")


def op4_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    put = assign_shards(docs, ["doc_id", "text_crc32", "size"], "size", 24)
    return put.select("doc_id", F.col("size").cast("long"), F.col("text_crc32").cast("long"), F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


#: The CRC is taken byte by byte: each byte is put in, then eight bits are shifted out.
OP4_SQL = """
with d as (select row_number() over () as rid, doc_id, octet_length(encode(coalesce(text, ''))) as n, hex(encode(coalesce(text, ''))) as h from documents),
c as (
  select doc_id, (n + 8)::bigint as size, xor(list_reduce([4294967295::ubigint] || flatten(list_transform(range(1, n + 1), lambda i: [('0x' || substr(h, 2 * i - 1, 2))::ubigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384::ubigint * (xor(a, b) & 1))), 4294967295::ubigint)::bigint as text_crc32
  from d),
s as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) - size as start, sum(size) over () as total from c),
p as (select *, least((24 * (2 * start + size)) // greatest(2 * total, 1), 23)::int as shard from s)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1)::bigint as slot, null::int as grown_shard from p"""
