"""Shared plumbing: folders that driver and executors share, lineage cuts, Arrow maps over whole tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"

#: Longer words are looked up anew each time: tables of words met are bounded by entries, so entries must be bounded too.
LONGEST = 64

_own: dict[str, str] = {}
_cleared: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a folder of our own, in local mode only:
    driver and executors of a cluster share no machine-local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="prismark-")
    return _own[app]


def _clear(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped, and its file systems with it
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: a lost executor costs no earlier stage.

    Results are lazy and may read such tables at any time, so they stay until remove(), or until the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _cleared:
        _cleared.add(folder)
        atexit.register(_clear, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def pieces(batch: pa.RecordBatch, at: Sequence[int], most_bytes: int = 4 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose columns `at` hold about most_bytes of text at most (a longer text is a slice of its own).

    Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch; what Python makes of texts is larger, so that
    only a slice of them is held as Python objects at a time, whatever the session's settings are."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for i in at:
        if pa.types.is_string(batch.column(i).type) or pa.types.is_binary(batch.column(i).type):
            sizes += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        room = (ends[start - 1] if start else 0) + most_bytes
        stop = max(start + 1, min(int(np.searchsorted(ends, room, side="right")), start + most_rows))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(
    df: DataFrame,
    uses: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns that Python computes from each Arrow batch.

    make() runs once in each task and returns f(*arrow columns of uses) -> one sequence for each of fields.
    Columns of keep (None: all) pass through unread; a new column replaces an input column of its name. f is given a
    bounded slice of a batch at a time (pieces).
    """
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    read = list(dict.fromkeys([*kept, *uses]))
    src = df.select(*[F.col(f"`{c}`") for c in read])
    schema = T.StructType([src.schema[c] for c in kept] + list(fields))
    at = [read.index(c) for c in uses]
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            for part in pieces(batch, at):
                f = f or make()
                new = f(*[part.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_kept)] + [x if isinstance(x, pa.Array) else pa.array(x, type=_arrow(t.dataType)) for x, t in zip(new, fields, strict=True)], names=kept + names)

    return src.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}[kind], True)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_runs(df: DataFrame, keys: Sequence[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType) -> DataFrame:
    """Deal rows out by integer keys and call f with all rows of one key at a time; callers bound a key's rows."""
    src = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    at = [src.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rest = make(), None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows == 0:
                continue
            cuts = np.zeros(batch.num_rows, dtype=bool)
            for i in at:
                values = batch.column(i).to_numpy(zero_copy_only=False)
                cuts[1:] |= values[1:] != values[:-1]
            starts = np.concatenate([[0], np.flatnonzero(cuts)])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a > 1 and (out := f(batch.slice(a, b - a))) is not None:
                    yield out
            rest = batch.slice(starts[-1])
        if rest is not None and rest.num_rows > 1 and (out := f(rest)) is not None:
            yield out

    return src.mapInArrow(run, schema)


def local_roots(match: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix of links: the smallest id that each row reaches."""
    label = ids.copy()
    top = np.iinfo(ids.dtype).max
    while True:
        low = np.minimum(label, np.where(match, label[None, :], top).min(axis=1))
        if (low == label).all():
            return label
        label = low
