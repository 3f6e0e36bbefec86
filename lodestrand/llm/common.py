"""Shared pieces of the training-data operators: tables, row-wise Arrow maps, checkpoints, UTF-8 buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestrand import on_workers

#: A word of the contracts: a maximal run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches are cut to about so many bytes of text before kernels see them, which bounds their temporary arrays.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, by spark.checkpoint.dir; where it is unset, a folder of the driver's, if that is the only machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestrand-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where it is. Unlike a checkpoint's, its size is known to the planner, and does not grow from round to round of an iteration."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of the tables that a shuffle's rows come from, for which it takes a partition: up to the session's number, and beyond it.
PART_BYTES, LARGE_BYTES = 256 << 10, 32 << 20
MOST_PARTS = 20_000


def _bytes(leaf) -> int:
    """What the planner takes a leaf's size to be; of a table that joins made, this may have any number of digits."""
    try:
        return min(int(str(leaf.stats().sizeInBytes())), 1 << 62)
    except ValueError:  # more digits than Python reads
        return 1 << 62


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle that moves whole rows of df: the session's number, fewer for small tables and more for very large ones. Nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(_bytes(leaves.apply(i)) for i in range(leaves.size()))
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = -(-size // LARGE_BYTES) if size < 1 << 56 else 0  # sizes beyond are guesses
    return max(min(asked, -(-size // PART_BYTES)), min(large, MOST_PARTS), 1)


#: A key with more than one of so many rows is hot; there are fewer hot keys than that.
HOT = 10_000


def lookup(rows: DataFrame, values: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with values, which has one row for each key and, in the column n, how many rows have it. `total` is the number of rows, or at least half of it.

    Hot keys are met in pieces, each with a copy of the value, so that no key's rows gather in one task. Which keys are hot
    goes by broadcast: at most 2 * HOT rows of keys, whatever the input's size.
    """
    keys = [key] if isinstance(key, str) else list(key)
    is_hot = F.col(n) * HOT > total
    copies = F.ceil(F.col(n) * HOT / max(1, total)).cast("int")
    hot = F.broadcast(values.where(is_hot).select(*keys, copies.alias("__copies")))
    left = rows.withColumn("__piece", F.xxhash64(*rows.columns)).join(hot, keys, "left").withColumn("__piece", F.pmod("__piece", F.coalesce("__copies", F.lit(1))).cast("int")).drop("__copies")
    right = values.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.when(is_hot, copies - 1).otherwise(0)))).drop(n)
    return left.join(right, [*keys, "__piece"]).drop("__piece")


#: A key with more than one of so many rows is split, into pieces of about so many rows.
SPLIT = 1000


def split_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows joined with values, which has one row for each key: those of a hot key in pieces, each of which gets a copy of the value.

    Which keys are hot goes by broadcast: under SPLIT numbers, whatever the input's size. rows are read three times.
    """
    total = rows.count()
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * SPLIT > total)
    hot = F.broadcast(n.select(key, F.ceil(F.col("__n") * SPLIT / max(1, total)).cast("int").alias("__copies")))
    copies = F.coalesce("__copies", F.lit(1))
    left = rows.withColumn("__piece", F.xxhash64(*rows.columns)).join(hot, key, "left").withColumn("__piece", F.pmod("__piece", copies).cast("int")).drop("__copies")
    right = values.join(hot, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return left.join(right, [key, "__piece"]).drop("__piece")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batch in pieces of about `most` bytes of `column`; a longer text is a piece of its own."""
    lengths = _lengths(batch.column(batch.schema.get_field_index(column)))
    if not len(lengths):
        return
    ends, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            ends.append(i)
            total = 0
        total += n
    for end in [*ends, len(lengths)]:
        yield batch.slice(start, end - start)
        start = end


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one uint8 array, and the n+1 offsets of its rows; null counts as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_batches(df: DataFrame, schema: T.StructType, run: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow whose function yields dicts of columns, cast here to the declared schema."""
    target = to_arrow_schema(schema)
    on_workers()

    def mapped(batches):
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, f.type) for f, v in ((f, columns[f.name]) for f in target)], schema=target)

    return df.mapInArrow(mapped, schema)


def per_text(df: DataFrame, fields: str, factory: Callable[[], Callable[[str], tuple]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row for each of df: the columns `keep`, and those named in `fields` (DDL), which factory()(text) returns. A null text counts as empty."""
    at = keep.index(text) if text in keep else len(keep)
    inputs = df.select(*keep) if text in keep else df.select(*keep, df[text].alias("__text"))
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*(f for f in inputs.schema if f.name != "__text"), *added])
    names, inputs_text = added.names, inputs.columns[at]

    def run(batches):
        work = factory()
        for batch in batches:
            for piece in slices(batch, inputs_text):
                rows = [work(t or "") for t in piece.column(at).to_pylist()]
                yield {**{k: piece.column(i) for i, k in enumerate(keep)}, **dict(zip(names, zip(*rows)))}

    return map_batches(inputs, schema, run)
