"""Stored tables without row updates: append, union with the newest row of each key, write a new version, swap.

Every sink writes to a new folder first and publishes it by a pointer, so that a lost executor or a second run leaves
the old version whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import with_running_sum

NO_IDS = F.array


def scan_rows(current: DataFrame, state: DataFrame, scan: DataFrame) -> DataFrame:
    """Observations of one scan of each target: a seen row for each finding, an unseen one for each other known key.

    current: target, finding_key, source, cvss, severity, version, cve_ids. scan: target, scan_id, started_at.
    """
    seen = current.select("target", "finding_key", "source", F.lit(True).alias("seen"), "cvss", "severity", "version", F.array_sort(F.coalesce("cve_ids", NO_IDS().cast("array<string>"))).alias("cve_ids"))
    gone = state.join(scan.select("target"), "target", "left_semi").join(current.select("target", "finding_key"), ["target", "finding_key"], "left_anti")
    unseen = gone.select("target", "finding_key", "source", F.lit(False).alias("seen"))
    return seen.unionByName(unseen, allowMissingColumns=True).join(scan, "target")


def next_state(state: DataFrame, current: DataFrame, resolved: DataFrame, now: Column | DataFrame) -> DataFrame:
    """The state after a scan. resolved: target, finding_key of RESOLVED verdicts. now: one time, or a table target, at.

    Present: new, or seen again (one occurrence more, one return more if it was resolved, open unless it says otherwise). Absent: only RESOLVED changes the status.
    """
    keys = ["target", "finding_key"]
    cur = current.select(*keys, F.struct("source", "cvss", "severity", "version", "cve_ids").alias("cur"))
    old = state.select(*keys, F.struct(*[c for c in state.columns if c not in keys]).alias("old"))
    rows = cur.join(old, keys, "full_outer").join(resolved.select(*keys, F.lit(True).alias("gone")), keys, "left")
    if isinstance(now, DataFrame):
        rows, now = rows.join(now.select("target", F.col("at").alias("_at")), "target", "left"), F.col("_at")
    here, o, back = F.col("cur").isNotNull(), F.col("old"), F.coalesce(F.col("old.status") == "resolved", F.lit(False))
    closes = ~here & F.coalesce("gone", F.lit(False)) & (o["status"] != "resolved")
    pick = lambda c: F.when(here, F.col(f"cur.{c}")).otherwise(o[c])
    return rows.select(
        *keys, *[pick(c).alias(c) for c in ("source", "cvss", "severity", "version", "cve_ids")],
        F.coalesce(o["first_seen"], now).alias("first_seen"),
        F.when(here, now).otherwise(o["last_seen"]).alias("last_seen"),
        F.when(here, "open").when(closes, "resolved").otherwise(o["status"]).alias("status"),
        (F.coalesce(o["occurrences"], F.lit(0)) + here.cast("int")).cast("bigint").alias("occurrences"),
        F.when(closes, now).when(~here, o["resolved_at"]).alias("resolved_at"),
        (F.coalesce(o["reappearance_count"], F.lit(0)) + (here & back).cast("int")).cast("bigint").alias("reappearance_count"),
        F.coalesce(o["solved"], F.lit(False)).alias("solved"), o["solved_at"].alias("solved_at"),
    )


def with_solved(state: DataFrame, events: DataFrame) -> DataFrame:
    """Marks by users, the newest for each key; the status stays. events: target, finding_key, solved, at."""
    last = events.groupBy("target", "finding_key").agg(F.max_by("solved", "at").alias("_s"), F.max("at").alias("_a"))
    out = state.join(last, ["target", "finding_key"], "left")
    return out.withColumn("solved_at", F.when(F.col("_s"), F.col("_a")).when(F.col("_s").isNull(), F.col("solved_at"))).withColumn("solved", F.coalesce("_s", "solved", F.lit(False))).drop("_s", "_a")


def without_targets(table: DataFrame, forgotten: DataFrame) -> DataFrame:
    return table.join(forgotten.select("target").distinct(), "target", "left_anti")


def open_table(state: DataFrame) -> DataFrame:
    """Open and unsolved findings with new refs in key order."""
    w = W.partitionBy("target").orderBy("finding_key")
    return state.where("status = 'open' and not coalesce(solved, false)").withColumn("ref", F.row_number().over(w) - 1)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str, stable: list[str] | None = None) -> DataFrame:
    """The newest row of each key (nulls are equal); keys that are gone from the new rows stay. The last of a key in `order`, by that column's own type, wins within new.

    Columns in `stable` keep the old row's value where there is an old row, such as an id given at the first insert.
    """
    kind = new.schema[order].dataType
    rows = old.withColumn("_batch", F.lit(0)).withColumn("_order", F.lit(None).cast(kind)).unionByName(new.withColumn("_batch", F.lit(1)).withColumn("_order", F.col(order)).select(*new.columns, "_batch", "_order"), allowMissingColumns=True)
    cols = [c for c in old.columns if c not in keys]
    stable = stable or []
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("_batch", "_order")).alias("_x"), *[F.max(F.when(F.col("_batch") == 0, F.struct(F.col(c).alias("v")))).alias(f"_s_{c}") for c in stable])
    return last.select(*keys, *[F.coalesce(F.col(f"_s_{c}.v"), F.col(f"_x.{c}")).alias(c) if c in stable else F.col(f"_x.{c}").alias(c) for c in cols])


def replaced(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Delete and insert by a null-safe key: the last row of a new key in `order`, of equal ones the greatest, replaces all old ones."""
    cols = [c for c in new.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(order).alias("_at"), F.struct(*cols))).alias("_x")).select(*keys, "_x.*").select(*old.columns)
    same = None
    marks = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys])
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = eq if same is None else same & eq
    return old.join(marks, same, "left_anti").unionByName(fresh)


def is_fresh(synced: Column, now: Column, hours: int = 24) -> Column:
    """Whether a stamp is younger; one that can't be read is stale."""
    at = F.try_to_timestamp(synced)
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) < hours * 3600, F.lit(False))


def sync_window(synced: Column, now: Column, lag_hours: int = 4) -> Column:
    """from, until of an incremental load; a window that runs backward becomes the last day."""
    until = F.timestamp_seconds(F.unix_timestamp(now) - lag_hours * 3600)
    day = F.timestamp_seconds(F.unix_timestamp(now) - 86400)
    wrong = synced.isNull() | (synced >= until)
    return F.struct(F.when(wrong, day).otherwise(synced).alias("since"), F.when(wrong, now).otherwise(until).alias("until"))


def last_results(targets: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The newest finished result of each target with its age in hours, or pending."""
    last = results.groupBy("target").agg(F.max_by("payload", "completed_at").alias("payload"), F.max("completed_at").alias("completed_at"))
    age = F.round((F.unix_timestamp(now) - F.unix_timestamp("completed_at")) / 3600, 1)
    return targets.select("target").distinct().join(last, "target", "left").withColumn("status", F.when(F.col("completed_at").isNull(), "pending").otherwise("ok")).withColumn("age_hours", age)


def source_changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with change: new, changed or same, by the natural key (corpus, title, platform, where null is empty) and the checksum."""
    key = lambda d: d.withColumn("_p", F.coalesce("platform", F.lit("")))
    old = key(stored).select("corpus", "title", "_p", F.col("checksum").alias("_c"), F.col("source_id").alias("_id"))
    out = key(incoming).join(old, ["corpus", "title", "_p"], "left")
    change = F.when(F.col("_id").isNull(), "new").when(F.col("_c").eqNullSafe(F.col("checksum")), "same").otherwise("changed")
    return out.withColumn("change", change).withColumn("source_id", F.coalesce("_id", "source_id") if "source_id" in incoming.columns else F.col("_id")).drop("_p", "_c", "_id")


def replaced_chunks(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after an ingest: those of changed sources go, the fresh ones come."""
    gone = changes.where("change = 'changed'").select("source_id")
    return chunks.join(gone, "source_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def batched(rows: DataFrame, done: DataFrame, order: str, size: int, first: int) -> DataFrame:
    """Rows not in earlier batches, numbered on from batch `first`, `size` rows each in order.

    Numbers are running counts over the range-sorted partitions, so that no task orders all rows.
    """
    todo = rows.join(done.select(order).distinct(), order, "left_anti")
    return numbered_in_order(todo, order, "_n").withColumn("batch_no", (F.lit(first) + F.floor(F.col("_n") / size)).cast("bigint")).drop("_n")


def numbered_in_order(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 0 by a column: the rows below each range (counted by range) and the place within it."""
    summed = with_running_sum(rows.withColumn("_one", F.lit(1)), [], [order], "_one", "_before")
    return summed.withColumn(name, F.col("_before").cast("bigint")).drop("_one", "_before", "_before_total")


def batch_files(rows: DataFrame, path: str) -> None:
    """rows with batch_no as JSON lines, a folder for each batch. A batch that is written again, as after a run that broke off, takes the place of its files; other batches stay."""
    rows.write.partitionBy("batch_no").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


class Versioned:
    """A table whose versions are folders; the newest whole one is the table."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self.fs.exists(self.path(self.root)):
            return 0
        names = (x.getPath().getName() for x in self.fs.listStatus(self.path(self.root)))
        return max([0, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())])

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{v}") if v else self.spark.createDataFrame([], self.schema)

    def tag(self) -> str | None:
        """What the newest version was published for."""
        v = self.version()
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.root}/v{v}"))] if v else []
        return next((n[5:] for n in names if n.startswith("_tag_")), None)

    def write(self, rows: DataFrame, tag: str | None = None) -> int:
        """Publishes rows, which may be computed from the version before, as the next one, under a tag such as a batch's. The rename fails if another job has published that version."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        v, made = self.version() + 1, f"{self.root}/_{uuid.uuid4().hex}"
        rows.write.parquet(made)
        if tag is not None:
            self.fs.create(self.path(f"{made}/_tag_{tag}")).close()
        source = self.path(made)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(source, self.path(f"{self.root}/v{v}"), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return v


def append_scans(rows: DataFrame, path: str, date: Column, batch: str | None = None) -> None:
    """Appends observations by date; scans that another batch has brought are not appended again.

    A named batch has a folder of its own, which its repetition writes over, so that a replay leaves each row once. There is one writer at a time.
    """
    spark = rows.sparkSession
    new, own = rows.withColumn("scan_date", date), batch or f"u{uuid.uuid4().hex}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        known = spark.read.parquet(path).where(F.col("batch_id").cast("string") != own).select("target", "scan_id").distinct()
        new = new.join(known, ["target", "scan_id"], "left_anti")
    new.write.partitionBy("scan_date").mode("overwrite").parquet(f"{path}/batch_id={own}")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
