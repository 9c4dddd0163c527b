"""Scans of frames and masks on disk, snapshots, and the sinks of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME = r"([^/]+)/[^/]+/([^/]+)\.[A-Za-z]+$"


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """object_id, stem, path of the files under <object>/<folder>/; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", NAME, 1).alias("object_id"), F.regexp_extract("path", NAME, 2).alias("stem"), "path")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """One row for each frame under root/<object>/images that has a mask: object_id, pos, id and the paths.

    pos is the rank by file name within the object (text order). A hand mask may be missing. Stems must be numbers.
    """
    images = _listed(spark, f"{root}/*/images", "*.png").withColumnRenamed("path", "image_path")
    masks = _listed(spark, f"{root}/*/masks", "*.png").withColumnRenamed("path", "mask_path")
    hands = _folder(spark, f"{root}/*/hand_masks", "hand_path")
    rows = images.join(masks, ["object_id", "stem"]).join(hands, ["object_id", "stem"], "left")
    pos = F.row_number().over(Window.partitionBy("object_id").orderBy("stem")) - 1
    return rows.withColumn("pos", pos).withColumn("id", F.col("stem").cast("bigint"))


def _folder(spark: SparkSession, path: str, name: str) -> DataFrame:
    """_listed, or no rows where no such folder exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if found is None or not len(found):
        return spark.createDataFrame([], f"object_id string, stem string, {name} string")
    return _listed(spark, path, "*.png").withColumnRenamed("path", name)


def depth_index(spark: SparkSession, path: str) -> DataFrame:
    """object_id, id, depth_path: numeric stems of any depth suffix, the last file name for each id."""
    files = _listed(spark, path, "*.{png,npy,jpg,jpeg,tiff}").where(F.col("stem").rlike("^[0-9]+$"))
    return files.groupBy("object_id", F.col("stem").cast("bigint").alias("id")).agg(F.max("path").alias("depth_path"))


def decode(spark: SparkSession, path: str) -> DataFrame:
    """object_id, stem, height, width, channels, data of PNG files, decoded in the JVM; colour is in the order blue, green, red."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    return images.select(F.regexp_extract("image.origin", NAME, 1).alias("object_id"), F.regexp_extract("image.origin", NAME, 2).alias("stem"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_run(out: str, quality: DataFrame, rejected: DataFrame, pool: DataFrame, picks: DataFrame, report: DataFrame) -> None:
    """The tables of a run: quality.csv, rejected.json, rejected_metrics.csv, embeddings, selection and report.json."""
    quality.write.mode("overwrite").option("header", True).csv(f"{out}/quality.csv")
    rejected.select("object_id", "pos", F.col("rejection_reason").alias("reason")).write.mode("overwrite").json(f"{out}/rejected.json")
    rejected.write.mode("overwrite").option("header", True).csv(f"{out}/rejected_metrics.csv")
    pool.select("object_id", "pos", "embedding", "quality").write.mode("overwrite").partitionBy("object_id").parquet(f"{out}/embeddings")
    picks.write.mode("overwrite").parquet(f"{out}/selection")
    report.write.mode("overwrite").json(f"{out}/report.json")


def write_samples(rows: DataFrame, out: str, kind: str, group: str | None = None) -> None:
    """Rows of samples, in folders by kind, group (slashes become underscores) and object."""
    named = rows.withColumn("kind", F.lit(kind)).withColumn("group", F.regexp_replace(F.col(group), "/", "_") if group else F.lit("all"))
    named.write.mode("overwrite").partitionBy("kind", "group", "object_id").parquet(out)


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pool, picks) of a written run; a pool whose ids repeat is an error."""
    pool, picks = spark.read.parquet(f"{path}/embeddings"), spark.read.parquet(f"{path}/selection")
    if pool.groupBy("object_id", "pos").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: positions repeat within an object")
    return pool, picks
