"""One findings table from six sources: mapping, first-wins merges, stable keys, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.scalars import filesystem_cvss, host_audit_cvss, key_part, malware_cvss, severity_bucket, severity_rank, web_cvss

SCHEMA = (
    "target string, scan_id string, finding_key string, source string, affected string, cpe string, version string, port int, service string, "
    "cvss double, severity string, cve_ids array<string>, description string, remediation_refs array<string>, "
    "script_findings array<struct<id:string,output:string>>"
)
KEYS = ["target", "scan_id"]
#: The order in which sources build the table; it decides first-wins merges and numbers.
SOURCE_ORDER = {"host_os": 0, "network": 1, "iot_defaults": 2, "filesystem": 3, "host_audit": 4, "malware": 5, "web": 6}
WORKERS = ["network", "iot", "filesystem", "host_audit", "malware", "web"]
#: Bookkeeping that a reader of findings doesn't need; fixed names.
BOOKKEEPING = ["ref", "finding_key", "drift_status", "age_days", "first_seen", "reappearance_count"]


def default_credentials(scripts: str | Column = "script_findings") -> Column:
    c = F.col(scripts) if isinstance(scripts, str) else scripts
    return F.coalesce(F.exists(c, lambda s: F.contains(s["id"], F.lit("default-accounts")) & (F.trim(F.coalesce(s["output"], F.lit(""))) != "")), F.lit(False))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _rows(df: DataFrame, **cols: Column) -> DataFrame:
    """The schema's columns (null where not given) and pos, the row's place in its source."""
    kinds = dict(x.strip().split(" ", 1) for x in SCHEMA.replace("struct<id:string,output:string>", "struct<id:string;output:string>").split(","))
    out = []
    for name, kind in kinds.items():
        kind = kind.replace(";", ",")
        out.append((cols[name] if name in cols else F.col(name) if name in KEYS else _none(kind)).cast(kind).alias(name))
    return df.select(*out, F.col("pos"))


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def host_os_rows(systems: DataFrame) -> DataFrame:
    """systems: target, scan_id, source_no, pos, cpe, os_name, highest_cvss, cve_ids, description, remediation_links. One row for each product string, the first source's."""
    one = first_wins(systems, [*KEYS, "cpe"], [F.col("source_no"), F.col("pos")])
    return _rows(one, finding_key=F.concat(F.lit("os:"), key_part("os_name", "this_device")), source=F.lit("host_os"), affected=F.concat(F.lit("Operating system: "), F.coalesce(F.nullif(F.col("os_name"), F.lit("")), F.lit("this device"))),
                 cvss=F.col("highest_cvss"), severity=severity_bucket("highest_cvss"), cve_ids=F.col("cve_ids"), description=F.col("description"), remediation_refs=F.col("remediation_links"))


def service_rows(services: DataFrame) -> DataFrame:
    """services: target, scan_id, source (network, iot_defaults), source_no, pos, port, protocol, service, cpe, version, highest_cvss, cve_ids, description, remediation_links, script_findings.

    One row a port, whatever its protocol: the first source's, with the first script findings that there are. Rows without a port stay. Default credentials are critical.
    """
    with_port = services.where("port is not null")
    order = [F.col("source_no"), F.col("pos")]
    w = W.partitionBy(*KEYS, "port").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scripts = F.first(F.when(F.size("script_findings") > 0, F.col("script_findings")), ignorenulls=True).over(w)
    merged = first_wins(with_port.withColumn("script_findings", scripts), [*KEYS, "port"], order)
    rows = merged.unionByName(services.where("port is null"))
    severity = F.when(default_credentials(), "critical").otherwise(severity_bucket("highest_cvss"))
    port = F.coalesce(F.col("port").cast("string"), F.lit("None"))
    key = F.concat(F.lit("net:"), port, F.lit("/"), key_part("protocol", "tcp"), F.lit(":"), key_part("service"))
    named = [F.nullif(F.col(c), F.lit("")) for c in ("product", "version") if c in rows.columns]
    affected = F.trim(F.concat_ws(" ", F.concat(F.lit("Port "), port, F.lit(" — "), F.coalesce("service", F.lit(""))), *named))
    return _rows(rows, finding_key=key, source=F.col("source"), affected=affected, cpe=F.col("cpe"), version=F.col("version"), port=F.col("port"), service=F.col("service"),
                 cvss=F.col("highest_cvss"), severity=severity, cve_ids=F.col("cve_ids"), description=F.col("description"), remediation_refs=F.col("remediation_links"), script_findings=F.col("script_findings"))


def package_rows(packages: DataFrame) -> DataFrame:
    """packages: target, scan_id, pos, package, version, cve_id, severity (upper case), fixed_version, description. A row for each package and version.

    Ids and fixed versions are collected in order without repeats; each row that raises the score gives severity and description, an empty description keeping the one before.
    """
    before = W.partitionBy(*KEYS, "package", "version").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    p = packages.withColumn("cvss", filesystem_cvss(F.upper("severity")))
    p = p.withColumn("raises", F.coalesce(F.col("cvss") > F.max("cvss").over(before), F.lit(True)))
    ordered = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("x"))))), lambda s: s["x"]))
    said = F.coalesce(F.col("description"), F.lit("")) != ""
    agg = p.groupBy(*KEYS, "package", "version").agg(
        F.min("pos").alias("pos"), F.max("cvss").alias("cvss"), ordered("cve_id").alias("cve_ids"), ordered("fixed_version").alias("remediation_refs"),
        F.coalesce(F.max_by("description", F.when(F.col("raises") & said, F.col("pos"))), F.lit("")).alias("description"),
    )
    return _rows(agg, finding_key=F.concat(F.lit("pkg:"), key_part("package")), source=F.lit("filesystem"), affected=F.trim(F.concat(F.lit("Package: "), F.col("package"), F.lit(" "), F.coalesce("version", F.lit("")))),
                 version=F.col("version"), cvss=F.col("cvss"), severity=severity_bucket("cvss"), cve_ids=F.col("cve_ids"), description=F.col("description"), remediation_refs=F.col("remediation_refs"))


def audit_rows(tests: DataFrame) -> DataFrame:
    """tests: target, scan_id, pos, test_id, severity, description, solution. No merging: a key may stand twice."""
    cvss = host_audit_cvss(F.upper("severity"))
    refs = F.array_compact(F.array(F.nullif(F.col("solution"), F.lit(""))))
    return _rows(tests, finding_key=F.concat(F.lit("audit:"), key_part("test_id")), source=F.lit("host_audit"), affected=F.concat(F.lit("Host setting: "), F.col("test_id")),
                 cvss=cvss, severity=severity_bucket(cvss), cve_ids=F.array(), description=F.col("description"), remediation_refs=refs)


def malware_rows(hits: DataFrame) -> DataFrame:
    """hits: target, scan_id, pos, path, sha256, signature, severity, engine."""
    cvss = malware_cvss(F.upper("severity"))
    key = F.concat(F.lit("mal:"), key_part(F.coalesce(F.nullif(F.col("sha256"), F.lit("")), F.col("path"))), F.lit(":"), key_part("signature"))
    said = F.concat(F.coalesce("engine", F.lit("ClamAV")), F.lit(" signature match: "), F.coalesce("signature", F.lit("")))
    return _rows(hits, finding_key=key, source=F.lit("malware"), affected=F.concat(F.lit("File: "), F.col("path")), cvss=cvss, severity=severity_bucket(cvss), cve_ids=F.array(), description=said, remediation_refs=F.array())


def web_rows(hits: DataFrame) -> DataFrame:
    """hits: target, scan_id, pos, template_id, name, host, matched_at, severity, cvss_score, cve_ids, description, references."""
    cvss = web_cvss("cvss_score", F.upper("severity"))
    at = F.coalesce(F.nullif(F.col("matched_at"), F.lit("")), F.col("host"), F.lit(""))
    return _rows(hits, finding_key=F.concat(F.lit("web:"), key_part("template_id"), F.lit(":"), key_part(at, "")), source=F.lit("web"), affected=F.trim(F.concat(F.col("name"), F.lit(" on "), at)),
                 cvss=cvss, severity=severity_bucket(cvss), cve_ids=F.col("cve_ids"), description=F.col("description"), remediation_refs=F.col("references"))


def numbered(rows: DataFrame) -> DataFrame:
    """ref: the row's number within its scan, in build order."""
    no = F.lit(99)
    for name, n in SOURCE_ORDER.items():
        no = F.when(F.col("source") == name, n).otherwise(no)
    w = W.partitionBy(*KEYS).orderBy(no, "pos", "finding_key")
    return rows.withColumn("ref", F.row_number().over(w) - 1).drop("pos")


def build(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for x in sources[1:]:
        out = out.unionByName(x)
    return numbered(out)


def one_per_key(findings: DataFrame) -> DataFrame:
    """A row for each key before drift and storage: the highest score, then the lowest ref; ids of all."""
    rest = [c for c in findings.columns if c not in (*KEYS, "finding_key", "cve_ids")]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("cvss", F.lit(-1.0)), -F.col("ref")))
    out = findings.groupBy(*KEYS, "finding_key").agg(best.alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cve_ids")))).alias("cve_ids"))
    return out.select(*KEYS, "finding_key", "cve_ids", "x.*")


def reader_view(findings: DataFrame) -> DataFrame:
    return findings.drop(*BOOKKEEPING)


def kept_severities(rows: DataFrame, web: bool = False) -> DataFrame:
    return rows.where(F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM", *(["LOW"] if web else [])))


def top_of_source(rows: DataFrame, n: int | None = 10, by_cvss: bool = False) -> DataFrame:
    """At most n rows of each source in a scan, worst first, equal ones as they came; None keeps all."""
    if n is None:
        return rows
    order = [severity_rank(F.lower("severity")).desc(), *([F.desc("cvss_score")] if by_cvss else []), F.col("pos")]
    w = W.partitionBy(*KEYS, "source").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def severity_counts(rows: DataFrame, keys: list[str], names: tuple[str, ...] = ("critical", "high", "medium", "low")) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in names], F.count(F.lit(1)).alias("total"))


def worker_status(scans: DataFrame, results: DataFrame) -> DataFrame:
    """A status for each scan and worker: missing, what the worker said, or ok. results: target, scan_id, worker, status."""
    every = scans.select(*KEYS).withColumn("worker", F.explode(F.array(*map(F.lit, WORKERS))))
    said = results.select(*KEYS, "worker", F.coalesce("status", F.lit("ok")).alias("status"))
    return every.join(said, [*KEYS, "worker"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
