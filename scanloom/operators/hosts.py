"""All hosts in one job: from built findings to verdicts, intel, ranking and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drift, findings, matching, priority, remediation, shared, state


def ranked_hosts(table: DataFrame, scans: DataFrame, known: DataFrame, observations: DataFrame, kev: DataFrame, epss: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Findings of each target's scan with drift, intel, score, band and rank; and the verdicts, those of findings that are gone included.

    table: findings.build. scans: target, scan_id, status (map), one scan a target. known: the state table. observations: earlier ones (target,
    finding_key, started_at, scan_id, seen, cvss, severity, cve_ids). now may be the scan's column started_at. Hosts without a finding have no row; hosts whose scan failed have no scan.
    """
    # written, as findings enter three times here and verdicts twice more in a report
    one = shared.dealt(findings.one_per_key(table), "host-keys", ["target", "finding_key"])
    verdicts = shared.written(drift.compute_drift(one, known, scans.select("target", "status", *[c for c in scans.columns if c == "started_at"]), observations, now), "host-verdicts")
    cves = one.select("target", "finding_key", F.explode("cve_ids").alias("cve_id"))
    intel = matching.exploit_intel(cves, kev, epss, ["target", "finding_key"])
    marks = verdicts.select("target", "finding_key", F.col("status").alias("drift_status"), "age_days", "reappearance_count", "first_seen")
    rows = one.join(marks, ["target", "finding_key"]).join(intel, ["target", "finding_key"], "left")
    # dealt by scan, as the windows by asset, by rank and by text and the report all go by it
    return priority.ranked(priority.scored(rows.repartition("target", "scan_id"), ["target", "scan_id"]), ["target", "scan_id"]), verdicts


def host_reports(ranked: DataFrame, verdicts: DataFrame, scans: DataFrame, known: DataFrame, catalog: DataFrame, platform: Column, wording: dict[str, str] = remediation.WORDING) -> DataFrame:
    """target, scan_id, report: a document of four parts for every scan, also for one that found nothing. scans: target, scan_id, previous_at (null on a first scan)."""
    facts = remediation.with_fix_facts(ranked.withColumn("platform", platform), catalog)
    facts = facts.withColumn("section", F.when(F.col("band") == "FIX NOW", "fix_now").otherwise("still_open"))
    headers = drift.header(verdicts, scans.where("previous_at is not null").select("target", "previous_at"))
    return remediation.scan_reports(facts, scans, headers, drift.resolved_list(verdicts, known), wording)


#: The stored state of a host's findings, with the text that a report names one by.
STATE = (
    "target string, finding_key string, source string, affected string, cvss double, severity string, version string, cve_ids array<string>, first_seen timestamp, last_seen timestamp, "
    "status string, occurrences bigint, resolved_at timestamp, reappearance_count bigint, solved boolean, solved_at timestamp"
)
SCAN_LOG = "target string, scan_id string, started_at timestamp"
#: What builds the rows of each kind of source.
BUILDERS = {"systems": findings.host_os_rows, "services": findings.service_rows, "packages": findings.package_rows, "audit": findings.audit_rows, "malware": findings.malware_rows, "web": findings.web_rows}


def process_hosts(sources: dict[str, DataFrame], scans: DataFrame, stored: state.Versioned, folder: str, kev: DataFrame, epss: DataFrame, catalog: DataFrame, platform: Column, batch: str, wording: dict[str, str] = remediation.WORDING) -> DataFrame:
    """One scan of each of many hosts, from the scanners' rows to stored state and reports (target, scan_id, report), all hosts in one job.

    sources: rows by kind (see BUILDERS). scans: target, scan_id, started_at, status (map); hosts that failed are left out of it (failed_hosts), and rows without a scan are too.
    stored: a table of STATE. In folder are the log of scans, the observations and the reports, each by batch. The batch is published last, under its name: until
    then its folders are written over by a repetition, and after it a repetition gives the reports that were written. Hosts without a finding have a report as well.
    """
    spark = scans.sparkSession
    at = lambda name: f"{folder}/{name}/batch_id={batch}"
    if stored.tag() == batch:
        return spark.read.parquet(at("reports"))
    scans = shared.written(scans.select("target", F.col("scan_id").cast("string").alias("scan_id"), "started_at", "status"), "host-scans")
    table = findings.build(*[BUILDERS[kind](rows.withColumn("scan_id", F.col("scan_id").cast("string"))) for kind, rows in sources.items()])
    table = shared.written(table.join(scans.select("target", "scan_id"), ["target", "scan_id"], "left_semi"), "host-findings")
    old = stored.read()
    log, seen = _earlier(spark, f"{folder}/scans", batch, SCAN_LOG), _earlier(spark, f"{folder}/observations", batch, OBSERVED)
    previous = log.groupBy("target").agg(F.max("started_at").alias("previous_at"))
    here = scans.join(previous, "target", "left")
    ranked, verdicts = ranked_hosts(table, scans, old, seen.where("seen"), kev, epss, F.col("started_at"))
    host_reports(ranked, verdicts, here, old, catalog, platform, wording).write.mode("overwrite").parquet(at("reports"))
    now = findings.one_per_key(table)
    state.scan_rows(now, old, scans.drop("status")).select([x.split()[0] for x in OBSERVED.split(", ")]).write.mode("overwrite").parquet(at("observations"))
    scans.drop("status").write.mode("overwrite").parquet(at("scans"))
    new = state.next_state(old, now, verdicts.where("status = 'RESOLVED'"), scans.select("target", F.col("started_at").alias("at")))
    named = now.select("target", "finding_key", "affected").unionByName(old.join(now, ["target", "finding_key"], "left_anti").select("target", "finding_key", "affected"))
    stored.write(new.join(named, ["target", "finding_key"], "left").select(old.columns), batch)
    return spark.read.parquet(at("reports"))


OBSERVED = "target string, scan_id string, finding_key string, source string, seen boolean, cvss double, severity string, version string, cve_ids array<string>, started_at timestamp"


def _earlier(spark, path: str, batch: str, schema: str) -> DataFrame:
    """What other batches have written to a folder of batches."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch_id string").parquet(path).where(F.col("batch_id") != batch).drop("batch_id")


def failed_hosts(raw: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    """target, status, error: an error row for each host whose result can't be read or says so; the others are ok and go on. raw: target, status, error and, from a permissive reader, the corrupt record."""
    broken = F.col(corrupt).isNotNull() if corrupt in raw.columns else F.lit(False)
    said = F.coalesce(F.col("status"), F.lit("ok")) == "error"
    return raw.select("target", F.when(broken | said, "error").otherwise("ok").alias("status"), F.when(broken, F.concat(F.lit("unreadable: "), F.substring(F.col(corrupt) if corrupt in raw.columns else F.lit(""), 1, 200))).when(said, F.coalesce("error", F.lit("unknown"))).alias("error"))
