"""The incremental forms: scans as they land, windows with late data, change feeds, dedup by watermark."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scanloom.operators.drift import SOURCE_OWNERS, ran_ok
from scanloom.operators.fleet import windowed_risk
from scanloom.operators.matching import changed_files
from scanloom.operators.shared import written
from scanloom.operators.state import Versioned, append_scans


def windowed_risk_stream(rows: DataFrame, time: str, value: str, keys: list[str], late: str = "1 day", length: str = "1 day", slide: str | None = None) -> DataFrame:
    return windowed_risk(rows.withWatermark(time, late), time, value, keys, length, slide)


def cve_dedup_stream(rows: DataFrame, time: str, late: str = "7 days") -> DataFrame:
    """The first of each record (null-safe five-column key) within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["cpe_base", "cve_id", "vulnerable_version", "version_start_including", "version_end_including"])


def each_batch(rows: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def batch_tag(checkpoint: str, epoch: int) -> str:
    """A name for a batch of the query with this checkpoint; the same for its repetition."""
    return f"b{zlib.crc32(checkpoint.encode()):08x}-{epoch}"


def file_change_feed(listing: DataFrame, manifest: Versioned, checkpoint: str, sink: Callable[[DataFrame, int], None], full: Callable[[int], bool] = lambda epoch: False) -> StreamingQuery:
    """New and changed files of each batch go to the sink; the manifest takes over the listing. full: whether a batch is a full pass, where all its files go.

    The manifest's versions are tagged with their batch, so that a batch whose manifest was published is not done again. One that broke off before goes to the
    sink again with the same number and the same rows: a sink that writes by that number gets each file once. Of several states of a path in a batch the one with the latest time is taken.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        tag = batch_tag(checkpoint, epoch)
        if manifest.tag() == tag:
            return
        last = batch.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "inode"), F.struct("mtime", "size", "inode")).alias("x")).select("path", "x.*")
        known = manifest.read()
        changed = changed_files(last, known)
        sink(changed if full(epoch) else changed.where("state <> 'same'"), epoch)
        manifest.write(known.join(last.select("path"), "path", "left_anti").unionByName(last), tag)

    return each_batch(listing, checkpoint, work)


FEED = "listed_at timestamp, last_full timestamp, full boolean, timed_out boolean"


def timed_change_feed(listing: DataFrame, manifest: Versioned, feed: Versioned, checkpoint: str, sink: Callable[[DataFrame, int, bool], bool], days: int = 30, once: bool = True) -> StreamingQuery:
    """As file_change_feed, with passes driven by time: listing has listed_at too, when the pass began, and feed (FEED) keeps what the last pass was.

    A pass is full, with all files, if no full one has ended or the last is `days` old; else its new and changed files go to the sink, which is told and says whether it timed out. A timeout of
    a full pass leaves it due; one of another pass leaves the manifest, so that its files are changed once more. A pass is over once the feed's version is published under the batch's
    name; one that broke off before goes to the sink again with the same number and kind, as the manifest's version that it may have published is passed over then.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        tag = batch_tag(checkpoint, epoch)
        now = None if feed.tag() == tag else batch.agg(F.max("listed_at")).first()[0]
        if now is None:
            return
        before = feed.read().first()
        last_full = before["last_full"] if before else None
        full = batch.sparkSession.range(1).select(full_pass_due(F.lit(last_full).cast("timestamp"), F.lit(now), days)).first()[0]
        stat = F.struct("mtime", "size", "inode")
        last = batch.groupBy("path").agg(F.max_by(stat, stat).alias("x")).select("path", "x.*")
        known = manifest.read(manifest.version() - 1) if manifest.tag() == tag else manifest.read()
        changed = changed_files(last, known)
        timed_out = bool(sink(changed if full else changed.where("state <> 'same'"), epoch, full))
        if manifest.tag() != tag and (full or not timed_out):
            manifest.write(known.join(last.select("path"), "path", "left_anti").unionByName(last), tag)
        feed.write(batch.sparkSession.createDataFrame([(now, now if full and not timed_out else last_full, full, timed_out)], FEED), tag)

    return each_batch(listing, checkpoint, work, once)


def full_pass_due(last_full: Column, now: Column, days: int = 30) -> Column:
    """Whether a full pass is due: never done, or days ago."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last_full) >= days * 86400, F.lit(True))


STATE = (
    "target string, finding_key string, source string, cvss double, severity string, version string, cve_ids array<string>, first_seen timestamp, last_seen timestamp, "
    "status string, occurrences bigint, resolved_at timestamp, reappearance_count bigint, solved boolean, solved_at timestamp"
)


def fold_scans(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after the scans of a batch, and their observations (seen and unseen rows), in one pass for all targets and scans.

    batch: target, scan_id, started_at, scan_status (map), finding_key, source, cvss, severity, version, cve_ids; a scan without findings has a row whose finding_key
    is null. A target's scans are taken in time order: windows by (target, key) carry the stored row and what was decided before through all of them, so that the number
    of jobs depends neither on the scans nor on the targets. Keys meet the scans from their first sight on, which are the observations to write. Of repeated
    rows of a finding in a scan the greatest counts.
    """
    keys, values = ["target", "finding_key"], ["source", "cvss", "severity", "version", "cve_ids"]
    landed = written(batch, "landed")
    scans = landed.select("target", "scan_id", "started_at", "scan_status").dropDuplicates(["target", "scan_id"])
    scans = scans.withColumn("turn", F.row_number().over(W.partitionBy("target").orderBy("started_at", "scan_id")))
    found = landed.where("finding_key is not null").groupBy("target", "scan_id", "finding_key").agg(F.max(F.struct(*values)).alias("cur"))
    old = state.join(scans.select("target").distinct(), "target", "left_semi").select(*keys, F.struct(*[c for c in state.columns if c not in keys]).alias("old"))
    first = found.join(scans.select("target", "scan_id", "turn"), ["target", "scan_id"]).groupBy(*keys).agg(F.min("turn").alias("since"))
    known = old.join(first, keys, "full_outer").withColumn("since", F.when(F.col("old").isNotNull(), 1).otherwise(F.col("since")))
    grid = known.join(scans, "target").where("turn >= since").join(found, ["target", "scan_id", "finding_key"], "left")
    so_far = W.partitionBy(*keys).orderBy("turn")
    until, before = so_far.rowsBetween(W.unboundedPreceding, 0), so_far.rowsBetween(W.unboundedPreceding, -1)
    grid = grid.withColumn("last", F.coalesce(F.last("cur", ignorenulls=True).over(until), F.struct(*[F.col(f"old.{c}").alias(c) for c in values])))
    grid = grid.withColumn("decided", F.when(F.col("cur").isNotNull(), "open").when(ran_ok(F.col("last.source"), F.col("scan_status")), "resolved"))
    grid = grid.withColumn("was", F.coalesce(F.last("decided", ignorenulls=True).over(before), F.col("old.status")))
    rows = written(grid.drop("scan_status", "since"), "folded")

    here = F.col("cur").isNotNull()
    seen = rows.select(
        "target", "scan_id", "started_at", "finding_key", F.col("last.source").alias("source"), here.alias("seen"), *[F.col(f"cur.{c}").alias(c) for c in ("cvss", "severity", "version")],
        F.when(here, F.array_sort(F.coalesce("cur.cve_ids", F.array().cast("array<string>")))).alias("cve_ids"),
    )
    closed = (F.col("decided") == "resolved") & (F.coalesce("was", F.lit("")) != "resolved")
    sums = rows.groupBy(*keys).agg(
        F.any_value("old").alias("o"), F.max_by("last", "turn").alias("x"), F.max_by(F.coalesce("decided", "was"), "turn").alias("status"), F.count_if(here).alias("n"),
        F.count_if(here & (F.col("was") == "resolved")).alias("again"), F.min(F.when(here, F.col("started_at"))).alias("first"), F.max(F.when(here, F.col("started_at"))).alias("latest"),
        F.max(F.when(closed, F.col("started_at"))).alias("closed_at"),
    )
    o = F.col("o")
    new = sums.select(
        *keys, *[F.col(f"x.{c}").alias(c) for c in values], F.coalesce(o["first_seen"], "first").alias("first_seen"), F.coalesce("latest", o["last_seen"]).alias("last_seen"), "status",
        (F.coalesce(o["occurrences"], F.lit(0)) + F.col("n")).cast("bigint").alias("occurrences"),
        F.when(F.col("status") == "resolved", F.coalesce("closed_at", o["resolved_at"])).when(F.col("n") == 0, o["resolved_at"]).alias("resolved_at"),
        (F.coalesce(o["reappearance_count"], F.lit(0)) + F.col("again")).cast("bigint").alias("reappearance_count"),
        F.coalesce(o["solved"], F.lit(False)).alias("solved"), o["solved_at"].alias("solved_at"),
    )
    untouched = state.join(scans.select("target").distinct(), "target", "left_anti")
    return untouched.unionByName(new.select(*state.columns)), seen


def ingest_scans(scans: DataFrame, state: Versioned, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Landed scans into observations at path and the state table, exactly once.

    The state's versions are tagged with their batch: a batch that was published is not done again, and one that broke off writes its observations over those of the broken
    attempt. Scans that an earlier batch brought are left out; only the dates of the batch's scans are read of the log for that.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        tag = batch_tag(checkpoint, epoch)
        if state.tag() == tag:
            return
        old = state.read()
        folder = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(folder):
            date = F.to_date("started_at")
            since, until = batch.agg(F.min(date), F.max(date)).first()
            known = batch.sparkSession.read.parquet(path).where((F.col("batch_id").cast("string") != tag) & F.col("scan_date").between(F.lit(since), F.lit(until))).select("target", "scan_id").distinct()
            batch = batch.join(known, ["target", "scan_id"], "left_anti")
        new, seen = fold_scans(old, batch)
        append_scans(seen, path, F.to_date("started_at"), tag)
        state.write(new.select(*old.columns), tag)

    return each_batch(scans, checkpoint, work, once)


DRIFT_OUT = "target string, scan_id string, finding_key string, verdict string, occurrences bigint, reappearance_count bigint"
#: Conf that a query with drift_stream needs: state by key in RocksDB, changes only in its checkpoints.
DRIFT_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class DriftMachine(StatefulProcessor):
    """What each scan of a target says of each of its keys, from a typed row of state a key and one of the last scan.

    Only the rows of keys whose state changes are written. With forget_ms, a key that no scan has changed for so long leaves the state by TTL (its next sight is NEW);
    with silent_ms, a target without a scan for so long gives one row with the verdict SILENT by a timer, which the next scan sets anew.
    """

    def __init__(self, silent_ms: int | None = None, forget_ms: int | None = None):
        self.silent_ms, self.forget_ms = silent_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "finding_key string", "source string, status string, occurrences bigint, reappearance_count bigint", self.forget_ms)
        self.scan = handle.getValueState("scan", "at bigint, scan_id string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = tuple(self.scan.get()) if self.scan.exists() else None
        taken = last
        known = {k[0]: tuple(v) for k, v in self.keys.iterator()}
        changed = set()
        for scan in sorted(rows, key=lambda x: (x["at"], x["scan_id"])):
            at = (scan["at"], str(scan["scan_id"]))
            if at == taken:
                continue
            if taken is not None and at[0] < taken[0]:
                yield _verdict(key[0], at[1], None, "LATE")
                continue
            taken = at
            ok = set(scan["ok"] or [])
            seen = dict(zip(scan["finding_keys"] or [], scan["sources"] or []))
            for k in sorted(known.keys() | seen.keys()):
                source, status, n, back = known.get(k, (None, None, 0, 0))
                if k in seen:
                    verdict = "NEW" if status is None else "REAPPEARED" if status == "resolved" else "PRESENT"
                    new = (seen[k], "open", n + 1, back + (status == "resolved"))
                elif ok & set(SOURCE_OWNERS.get(source, [])):
                    verdict, new = "RESOLVED", (source, "resolved", n, back)
                else:
                    verdict, new = "UNOBSERVED", (source, status, n, back)
                if new != known.get(k):
                    known[k] = new
                    changed.add(k)
                yield _verdict(key[0], at[1], k, verdict, new[2], new[3])
        for k in changed:
            self.keys.updateValue((k,), known[k])
        if taken != last:
            self.scan.update(taken)
            if self.silent_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield _verdict(key[0], self.scan.get()[1], None, "SILENT")

    def close(self) -> None:
        pass


def _verdict(target: str, scan_id: str, finding_key: str | None, verdict: str, occurrences: int | None = None, back: int | None = None) -> Row:
    return Row(target=target, scan_id=scan_id, finding_key=finding_key, verdict=verdict, occurrences=occurrences, reappearance_count=back)


def drift_stream(scans: DataFrame, silent_ms: int | None = None, forget_ms: int | None = None) -> DataFrame:
    """The state machine of findings by target over a stream of whole scans; the session needs DRIFT_CONF.

    scans: target, scan_id, started_at, status (map), findings (array of finding_key, source). Scans of a target are taken in order of time and id within a
    batch. One before the last scan taken is late: it changes nothing and comes out as one row with the verdict LATE (see split_late). The last scan once more is passed over.
    With silent_ms or forget_ms the clock drives the query: it goes on until it is stopped, whatever its trigger.
    """
    ok = F.map_keys(F.map_filter("status", lambda _, x: x == "ok"))
    rows = scans.select("target", "scan_id", F.unix_micros("started_at").alias("at"), ok.alias("ok"), F.col("findings.finding_key").alias("finding_keys"), F.col("findings.source").alias("sources"))
    return rows.groupBy("target").transformWithState(DriftMachine(silent_ms, forget_ms), DRIFT_OUT, "Append", "ProcessingTime" if silent_ms is not None or forget_ms is not None else "None")


def split_late(verdicts: DataFrame, path: str, late_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The verdicts of drift_stream into Parquet at path and the late scans at late_path, a folder for each batch, which its repetition writes over."""

    def work(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        for rows, to in ((held.where("verdict <> 'LATE'"), path), (held.where("verdict = 'LATE'").select("target", "scan_id"), late_path)):
            rows.write.mode("overwrite").parquet(f"{to}/batch_id={batch_tag(checkpoint, epoch)}")
        held.unpersist()

    return each_batch(verdicts, checkpoint, work, once)


def landed(spark, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """Parquet files as they land, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).withColumn("landed_at", F.current_timestamp())
