"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Texts are handed to a helper in slices of about this many bytes, so that its arrays stay small whatever the batch.
SLICE_BYTES = 1 << 20
#: Odd constants of polynomial hashes.
BASE, SPREAD, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9
U = np.uint64


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k, modulo 2 ** 64, for k below n."""
    return tuple(np.cumprod(np.concatenate(([U(1)], np.full(n - 1, U(b), U)))) for b in (BASE, pow(BASE, -1, 1 << 64)))


def running_sums(codes: np.ndarray, up: np.ndarray) -> np.ndarray:
    """With sums s and powers p ** -k, (s[end] - s[start]) * p ** -start is the hash of a stretch, wherever it stands."""
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(MIX)
    return h ^ (h >> U(29))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; null text counts as empty.  Other columns are pruned."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows, cut where the UTF-8 bytes of the texts pass the limit."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        start, held = 0, 0
        sizes = pc.binary_length(texts).to_pylist()
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= limit:
                yield ids.slice(start, i + 1 - start).to_pylist(), texts.slice(start, i + 1 - start).to_pylist()
                start, held = i + 1, 0
        if start < len(sizes):
            yield ids.slice(start).to_pylist(), texts.slice(start).to_pylist()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, which the driver and all executors share.

    Where the session names none, a session on one machine uses one below the warehouse; on a cluster that is an error,
    because the warehouse can be the driver's own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*frames: DataFrame) -> None:
    """Deletes the folders made by written() that these are read from.  Nothing that is still to run may read them."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def bounded_sample(rows: DataFrame, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """At most n rows, those whose ids hash lowest: for fitting only.  The ids alone are ranked, then their rows read."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    lowest = rows.select(key.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.where(key <= F.lit(lowest)).limit(n) if lowest is not None else rows.limit(0)


def shared_buckets(rows: DataFrame, bucket: list[str], member: str, leader: str | None = None) -> DataFrame:
    """Rows of buckets that more than one member is in, once for each bucket and member (first columns of `rows`; the
    others come along).  `leader`: name of a column to add, the smallest member of the bucket.

    One shuffle.  Spark sorts each partition, spilling if it must; the rows stream through, whatever the size of a bucket.
    """
    fields, schema = rows.columns, rows.schema
    if leader:
        schema = StructType([*schema.fields, StructField(leader, schema[member].dataType)])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the batch before: its last row, the first member of that bucket, and whether the row is still to be given out
        last, low, due = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in fields}
            if last is not None:
                cols = {c: np.concatenate(([last[c]], v)) for c, v in cols.items()}
            same = np.logical_and.reduce([cols[c][1:] == cols[c][:-1] for c in bucket])
            fresh = np.concatenate(([True], ~(same & (cols[member][1:] == cols[member][:-1]))))
            starts = np.concatenate(([True], ~same))
            number = np.cumsum(starts) - 1
            first = cols[member][starts][number]
            if last is not None:
                first = np.where(number == 0, low, first)
            out = fresh & np.logical_or.reduceat(cols[member] != first, np.flatnonzero(starts))[number]
            out[0] &= due
            end = int(np.flatnonzero(fresh)[-1])
            due = not (out[end] or (end == 0 and not due))
            last, low = {c: v[-1] for c, v in cols.items()}, first[-1]
            if out.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[c][out]) for c in fields), *([pa.array(first[out])] if leader else [])], names=[*fields, *([leader] if leader else [])])

    return rows.repartition(*bucket).sortWithinPartitions(*bucket, member).mapInArrow(pick, schema)
