"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a temporary folder; a cluster must name one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str, partitions: str | None = None) -> DataFrame:
    """df as a table in the shared folder: later reads neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partitions) if partitions else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """As written(), bucketed by key: grouping by it reads the files in place, without a shuffle."""
    spark = df.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{made}").bucketBy(buckets, key).saveAsTable(made)
    return spark.table(made)


def free_name(taken: list[str], want: str) -> str:
    """want, or want with a suffix if a column has that name already (names compare without case)."""
    used = {x.lower() for x in taken}
    while want.lower() in used:
        want += "_"
    return want


def slices(batch: pa.RecordBatch, text_at: int = 1, most_rows: int = 1000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """batch in order, in parts of at most so many rows and, where it has more than one row, so many bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (held + n > most_bytes or i - begin >= most_rows):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)
