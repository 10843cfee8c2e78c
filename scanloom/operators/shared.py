"""Tables in the folder that driver and executors share, for results that later steps must find unchanged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a temporary folder and a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: later reads neither recompute it nor depend on one executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """df as a table whose rows are dealt by keys to as many tasks as there are shuffle partitions: joins, groups and windows by these keys do not shuffle it again."""
    spark, made = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, *keys).write.option("path", f"{shared_dir(spark)}/{made}").bucketBy(parts, *keys).saveAsTable(made)
    return spark.table(made)


def with_running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with `name`, the sum of `value` over the rows before in their group, and `name`_total, that of the whole group.

    Rows are dealt by range of keys, order and place in the input, so that neither a large group nor many equal orders meet in
    one task; a group's sums by range (as many as there are shuffle partitions, at most) are then added up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "running-sum")
    pieces = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    group = W.partitionBy(*(keys or [F.lit(0)]))
    below = F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), below.alias("_below"), F.sum("_sum").over(group).alias(f"{name}_total"))
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(pieces, same)
    return out.withColumn(name, F.col("_in") + F.col("_below")).select(*rows.columns, name, f"{name}_total")
