"""Streams end in what the batch form gives."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from scanloom.operators import drift, fleet
from scanloom.operators.state import Versioned, next_state, scan_rows
from scanloom.streaming import scans as st

D = [dt.datetime(2024, 1, i) for i in range(1, 10)]


def test_windows(spark, tmp_path):
    data = spark.createDataFrame([("t", D[i % 5], float(i)) for i in range(20)], "target string, at timestamp, cvss double")
    data.write.parquet(str(tmp_path / "in"))
    stream = st.windowed_risk_stream(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "at", "cvss", ["target"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in fleet.windowed_risk(data, "at", "cvss", ["target"]).collect()}


@pytest.fixture
def rocks(spark):
    """State by key in RocksDB."""
    for k, v in st.DRIFT_CONF.items():
        spark.conf.set(k, v)
    yield
    for k in st.DRIFT_CONF:
        spark.conf.unset(k)


def test_drift_equals_history(spark, tmp_path, rocks):
    seen = {"a": [0, 1, 4], "b": [1, 5], "c": [0, 2, 3]}
    rows = [("t", i + 1, D[i], {"network": "error" if i == 2 else "ok"}, [(k, "network") for k, at in seen.items() if i in at]) for i in range(6)]
    ddl = "target string, scan_id bigint, started_at timestamp, status map<string,string>, findings array<struct<finding_key:string,source:string>>"
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i : i + 2], ddl).write.mode("append").parquet(str(tmp_path / "in"))
    q = st.drift_stream(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("verdicts").trigger(availableNow=True).start()
    q.awaitTermination()
    scans = spark.createDataFrame([r[:4] for r in rows], "target string, scan_id bigint, started_at timestamp, status map<string,string>")
    obs = spark.createDataFrame([("t", r[1], k, s, 5.0) for r in rows for k, s in r[4]], "target string, scan_id bigint, finding_key string, source string, cvss double")
    want = {(str(r["scan_id"]), r["finding_key"], r["verdict"]) for r in drift.history(scans, obs).collect()}
    assert {(r["scan_id"], r["finding_key"], r["verdict"]) for r in spark.table("verdicts").collect()} == want


def test_change_feed_and_dedup(spark, tmp_path):
    ddl = "path string, mtime double, size bigint, inode bigint"
    spark.createDataFrame([("a", 1.0, 1, 1), ("b", 1.0, 1, 2)], ddl).write.parquet(str(tmp_path / "in"))
    manifest = Versioned(spark, str(tmp_path / "manifest"), ddl)
    manifest.write(spark.createDataFrame([("a", 1.0, 1, 1), ("c", 1.0, 1, 3)], ddl))
    out = []
    q = st.file_change_feed(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), manifest, str(tmp_path / "cp"), lambda df, i: out.extend(r["path"] for r in df.collect()))
    q.awaitTermination()
    assert out == ["b"] and {r["path"] for r in manifest.read().collect()} == {"a", "b", "c"}
    rows = spark.createDataFrame([("x", "CVE-1", None, None, None, D[0])] * 3, "cpe_base string, cve_id string, vulnerable_version string, version_start_including string, version_end_including string, at timestamp")
    rows.write.parquet(str(tmp_path / "cves"))
    q = st.cve_dedup_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "cves")), "at").writeStream.format("memory").queryName("cves").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("cves").agg(F.count("*")).first()[0] == 1


def test_ingest_is_exactly_once(spark, tmp_path):
    """Landed scans end in the state that windows over their history give; a repeated batch, after a crash before its commit, changes nothing."""
    ddl = "target string, scan_id bigint, started_at timestamp, scan_status map<string,string>, finding_key string, source string, cvss double, severity string, version string, cve_ids array<string>"
    seen = {"a": [0, 1, 4], "b": [1, 5], "c": [0, 2, 3]}
    for i in range(6):
        at = [("t", i + 1, D[i], {"network": "error" if i == 2 else "ok"}, k, "network", 5.0, "medium", "1", ["x"]) for k, own in seen.items() if i in own]
        spark.createDataFrame(at or [("t", i + 1, D[i], {"network": "ok"}, None, None, None, None, None, None)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = Versioned(spark, str(tmp_path / "state"), st.STATE)
    path, cp = str(tmp_path / "obs"), str(tmp_path / "cp")
    stream = lambda: st.ingest_scans(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in")), table, path, cp)
    stream().awaitTermination()
    first = {tuple(r) for r in table.read().select("finding_key", "status", "occurrences", "reappearance_count").collect()}
    n = spark.read.parquet(path).count()
    # the last batch's commit is lost
    last = max((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda x: int(x.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()
    stream().awaitTermination()
    assert {tuple(r) for r in table.read().select("finding_key", "status", "occurrences", "reappearance_count").collect()} == first
    assert spark.read.parquet(path).count() == n
    scans = spark.createDataFrame([("t", i + 1, D[i], {"network": "error" if i == 2 else "ok"}) for i in range(6)], "target string, scan_id bigint, started_at timestamp, status map<string,string>")
    obs = spark.createDataFrame([("t", i + 1, k, "network", 5.0) for k, own in seen.items() for i in own], "target string, scan_id bigint, finding_key string, source string, cvss double")
    want = drift.state_from_history(drift.history(scans, obs))
    assert first == {tuple(r) for r in want.select("finding_key", "status", "occurrences", "reappearance_count").collect()}


def test_late_scans_are_told(spark, tmp_path, rocks):
    ddl = "target string, scan_id bigint, started_at timestamp, status map<string,string>, findings array<struct<finding_key:string,source:string>>"
    for i, at in enumerate((D[3], D[1])):
        spark.createDataFrame([("t", i + 1, at, {"network": "ok"}, [("k", "network")])], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = st.drift_stream(rows).writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["verdict"] for r in spark.table("late").collect()) in (["LATE", "NEW"], ["NEW", "PRESENT"])
    assert spark.range(1).select(st.full_pass_due(F.lit(D[0]), F.lit(D[8]), 8), st.full_pass_due(F.lit(D[0]), F.lit(D[8]), 9), st.full_pass_due(F.lit(None).cast("timestamp"), F.lit(D[8]))).first() == (True, False, True)


SCANS = "target string, scan_id bigint, started_at timestamp, status map<string,string>, findings array<struct<finding_key:string,source:string>>"


def test_drift_goes_on_from_its_checkpoint(spark, tmp_path, rocks):
    """Each scan in a query of its own, late and repeated ones too: state by key lives on, and late scans go to their own table."""
    seen = {"a": [0, 1, 4], "b": [1, 5], "c": [0, 2, 3]}
    rows = [(f"t{j}", i + 1, D[i], {"network": "error" if i == 2 + j else "ok"}, [(k, "network") for k, at in seen.items() if i in at]) for i in range(6) for j in range(2)]
    out, late, cp = (str(tmp_path / x) for x in ("out", "late", "cp"))

    def run(rows):
        spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCANS).parquet(str(tmp_path / "in"))
        st.split_late(st.drift_stream(stream), out, late, cp).awaitTermination()

    run(rows[:6])
    run(rows[6:9])
    run([rows[0], rows[8], *rows[9:]])
    scans = spark.createDataFrame([r[:4] for r in rows], "target string, scan_id bigint, started_at timestamp, status map<string,string>")
    obs = spark.createDataFrame([(r[0], r[1], k, s, 5.0) for r in rows for k, s in r[4]], "target string, scan_id bigint, finding_key string, source string, cvss double")
    want = sorted((r["target"], str(r["scan_id"]), r["finding_key"], r["verdict"]) for r in drift.history(scans, obs).collect())
    assert sorted((r["target"], r["scan_id"], r["finding_key"], r["verdict"]) for r in spark.read.parquet(out).collect()) == want
    assert [(r["target"], r["scan_id"]) for r in spark.read.parquet(late).collect()] == [("t0", "1")]


def test_silent_targets_and_forgotten_keys(spark, tmp_path, rocks):
    """Timers and TTL go by the clock, so that these queries run on until they are stopped."""
    scan = lambda target, i: (target, i, D[i], {"network": "ok"}, [("k", "network")])

    def run(name, rows, want, **how):
        spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
        stream = st.drift_stream(spark.readStream.schema(SCANS).parquet(str(tmp_path / f"in-{name}")), **how)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(processingTime="1 second").start()
        got, until = [], time.time() + 40
        while got != want and time.time() < until:
            time.sleep(0.5)
            if q.exception():
                raise q.exception()
            if (tmp_path / name / "_spark_metadata").exists():
                got = sorted((r["target"], r["verdict"]) for r in spark.read.schema(st.DRIFT_OUT).parquet(str(tmp_path / name)).collect())
        q.stop()
        assert got == want

    run("silent", [scan("a", 1)], [("a", "NEW"), ("a", "SILENT")], silent_ms=1)
    run("ttl", [scan("a", 1)], [("a", "NEW")], forget_ms=1)
    run("ttl", [scan("a", 2)], [("a", "NEW"), ("a", "NEW")], forget_ms=1)
    run("kept", [scan("a", 1)], [("a", "NEW")], forget_ms=3_600_000)
    run("kept", [scan("a", 2)], [("a", "NEW"), ("a", "PRESENT")], forget_ms=3_600_000)


def fold_rows(n_scans):
    seen = {"a": (0, 1, 4), "b": (1, 5), "c": (0, 2, 3)}
    out = []
    for i in range(n_scans):
        at = [(t, i + 1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), {"network": "error" if i % 6 == 2 else "ok"}, k, "network", float(i), "medium", "1", ["x", f"y{i}"]) for t in ("t", "u") for k, own in seen.items() if i % 6 in own]
        out += at + [("v", i + 1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), {"network": "ok"}, None, None, None, None, None, None)]
    return out


FOLD = "target string, scan_id bigint, started_at timestamp, scan_status map<string,string>, finding_key string, source string, cvss double, severity string, version string, cve_ids array<string>"


def one_by_one(spark, state, rows):
    """The fold by the operators of one scan, a scan at a time."""
    batch = spark.createDataFrame(rows, FOLD)
    seen = []
    for i in sorted({r[1] for r in rows}):
        part = batch.where(f"scan_id = {i}")
        scan = part.select("target", "scan_id", "started_at", "scan_status").dropDuplicates(["target"])
        cur = part.where("finding_key is not null").select("target", "finding_key", "source", "cvss", "severity", "version", "cve_ids")
        gone = state.where("status <> 'resolved'").join(scan.select("target", "scan_status"), "target").join(cur.select("target", "finding_key"), ["target", "finding_key"], "left_anti")
        seen += scan_rows(cur, state, scan.drop("scan_status")).select("target", "scan_id", "finding_key", "seen", "source", "cvss").collect()
        state = spark.createDataFrame(next_state(state, cur, gone.where(drift.ran_ok(F.col("source"), F.col("scan_status"))), scan.select("target", F.col("started_at").alias("at"))).select(*names(st.STATE)).collect(), st.STATE)
    return state, seen


def names(ddl):
    return [x.split()[0] for x in ddl.split(", ")]


def test_a_batch_of_many_scans_equals_one_scan_at_a_time(spark):
    rows = fold_rows(13)
    start = spark.createDataFrame([("t", "old", "network", 1.0, "low", "1", ["z"], D[0], D[0], "resolved", 3, D[0], 1, True, D[0]), ("w", "far", "network", 1.0, "low", "1", ["z"], D[0], D[0], "open", 3, None, 1, False, None)], st.STATE)
    state, seen = start, []
    for part in (rows[:20], rows[20:]):
        state, obs = st.fold_scans(state, spark.createDataFrame(part, FOLD))
        seen += obs.select("target", "scan_id", "finding_key", "seen", "source", "cvss").collect()
    want, want_seen = one_by_one(spark, start, rows)
    assert sorted(map(str, state.select(*names(st.STATE)).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, seen)) == sorted(map(str, want_seen))


def test_jobs_of_a_fold_do_not_grow_with_its_scans(spark):
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (2, 24):
        spark.sparkContext.setJobGroup(f"fold-{n}", "fold")
        state, seen = st.fold_scans(spark.createDataFrame([], st.STATE), spark.createDataFrame(fold_rows(n), FOLD))
        state.count(), seen.count()
        counts.append(len(tracker.getJobIdsForGroup(f"fold-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 4, counts
