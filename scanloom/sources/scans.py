"""Landed scan files as typed tables. A directory of files is one read; what can't be parsed is kept apart, never dropped unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.scalars import detection_severity, signature_severity
from scanloom.functions.versions import as_cpe23, cpe_base, cpe_part, cpe_version, humanized

NMAP_HOST = (
    "_corrupt_record string, status struct<_state:string>, address array<struct<_addr:string,_addrtype:string,_vendor:string>>, "
    "hostnames struct<hostname:array<struct<_name:string>>>, ports struct<port:array<struct<_protocol:string,_portid:int,"
    "state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string,cpe:array<string>>,"
    "script:array<struct<_id:string,_output:string>>>>>, "
    "os struct<osmatch:array<struct<_name:string,osclass:array<struct<cpe:array<string>>>>>>"
)


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def hosts(spark: SparkSession, path: str) -> DataFrame:
    """Hosts of service scans (XML) with their file; files that can't be parsed have _corrupt_record."""
    return spark.read.format("xml").option("rowTag", "host").option("mode", "PERMISSIVE").schema(NMAP_HOST).load(path).select("*", _file())


def services(host_rows: DataFrame) -> DataFrame:
    """A row for each port in any state. The product string is the first of an application, else the first listed."""
    p = host_rows.select("file", F.posexplode("ports.port").alias("pos", "p"))
    cpes = F.coalesce(F.col("p.service.cpe"), F.array().cast("array<string>"))
    cpe = as_cpe23(F.coalesce(F.get(F.filter(cpes, lambda c: cpe_part(c) == "a"), F.lit(0)), F.get(cpes, F.lit(0))))
    scripts = F.transform(F.coalesce("p.script", F.array().cast("array<struct<_id:string,_output:string>>")), lambda s: F.struct(s["_id"].alias("id"), s["_output"].alias("output")))
    return p.select(
        "file", "pos", F.col("p._portid").alias("port"), F.coalesce("p._protocol", F.lit("tcp")).alias("protocol"),
        F.coalesce("p.state._state", F.lit("unknown")).alias("state"), F.coalesce("p.service._name", F.lit("unknown")).alias("service"),
        F.col("p.service._product").alias("product"), F.col("p.service._version").alias("version"), cpe.alias("cpe"), scripts.alias("script_findings"),
    )


def host_systems(host_rows: DataFrame) -> DataFrame:
    """Product strings of operating systems: named matches first, then those that services tell; the first label of each stays."""
    named = host_rows.select("file", F.posexplode("os.osmatch").alias("i", "m")).select("file", F.lit(0).alias("branch"), "i", F.col("m._name").alias("name"), F.explode("m.osclass").alias("c"))
    named = named.select("file", "branch", "i", "name", F.posexplode("c.cpe").alias("j", "cpe"))
    told = host_rows.select("file", F.posexplode("ports.port").alias("i", "p")).select("file", F.lit(1).alias("branch"), "i", F.lit(None).cast("string").alias("name"), F.posexplode("p.service.cpe").alias("j", "cpe"))
    rows = named.unionByName(told).where(cpe_part("cpe") == "o").withColumn("cpe", as_cpe23("cpe"))
    w = W.partitionBy("file", "cpe").orderBy("branch", "i", "j")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file", "cpe", F.coalesce("name", humanized("cpe")).alias("os_name"))


def discovered(host_rows: DataFrame) -> DataFrame:
    one = lambda kinds, field: F.get(F.filter("address", lambda a: a["_addrtype"].isin(*kinds)), F.lit(0))[field]
    return host_rows.select(
        "file", one(("ipv4", "ipv6"), "_addr").alias("ip"), one(("mac",), "_addr").alias("mac"), one(("mac",), "_vendor").alias("vendor"),
        F.get("hostnames.hostname", F.lit(0))["_name"].alias("hostname"), F.coalesce("status._state", F.lit("unknown")).alias("status"),
    )


PACKAGES = "Results array<struct<Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,Description:string>>>>"


def packages(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema(PACKAGES).json(path).select(_file(), F.posexplode("Results").alias("i", "r"))
    v = raw.select("file", "i", F.posexplode("r.Vulnerabilities").alias("j", "v"))
    w = W.partitionBy("file").orderBy("i", "j")
    or_ = lambda c, d: F.coalesce(f"v.{c}", F.lit(d))
    return v.select(
        "file", (F.row_number().over(w) - 1).alias("pos"), or_("PkgName", "Unknown Package").alias("package"), or_("InstalledVersion", "N/A").alias("version"),
        or_("VulnerabilityID", "UNKNOWN-CVE").alias("cve_id"), F.upper(or_("Severity", "UNKNOWN")).alias("severity"),
        or_("FixedVersion", "No Patch Available").alias("fixed_version"), F.coalesce("v.Description", "v.Title", F.lit("")).alias("description"),
    )


WEB = "`template-id` string, host string, `matched-at` string, info struct<name:string,severity:string,description:string,reference:variant,classification:struct<`cve-id`:variant,`cvss-score`:variant>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (from 0), line: places within each file, the same however the files are split.

    Lines are counted for each piece of a file that a task reads; a line's place is the sum of the pieces before and its place in its own. There is a row for each piece.
    """
    lines = spark.read.text(path).select(_file(), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    pieces = lines.groupBy("file", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("file").alias("of"), F.col("piece").alias("of_piece"), before.alias("before"), "first")
    met = lines.join(pieces, (F.col("file") == F.col("of")) & (F.col("piece") == F.col("of_piece")))
    return met.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("pos"), "line")


def web_hits(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, with its place in the file; blank and malformed lines are skipped. References and ids may be a text or a list."""
    parsed = numbered_lines(spark, path).withColumn("x", F.from_json("line", WEB + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    raw = parsed.where("x._corrupt is null").select("file", "pos", "x.*").where("`template-id` is not null or host is not null")
    texts = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<string>")).when(~F.is_variant_null(v), F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.array().cast("array<string>"))
    or_none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return raw.select(
        "file", "pos", F.col("template-id").alias("template_id"), F.coalesce("info.name", F.col("template-id")).alias("name"), "host",
        F.col("matched-at").alias("matched_at"), F.upper(F.coalesce("info.severity", F.lit("unknown"))).alias("severity"), F.coalesce("info.description", F.lit("")).alias("description"),
        F.slice(or_none(texts(F.col("info.reference"))), 1, 3).alias("references"), or_none(texts(F.col("info.classification.cve-id"))).alias("cve_ids"),
        F.try_variant_get("info.classification.cvss-score", "$", "string").try_cast("double").alias("cvss_score"),
    )


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """Lines of host-audit reports: file, line_no, key, value; comments, blanks and lines without "=" are skipped."""
    raw = spark.read.text(path, wholetext=True).select(_file(), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    kept = raw.where(F.contains("line", F.lit("=")) & ~F.startswith(F.trim("line"), F.lit("#")))
    return kept.select("file", "line_no", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))


def audit_tests(lines: DataFrame) -> DataFrame:
    part = lambda i: F.coalesce(F.trim(F.get(F.split("value", r"\|"), F.lit(i))), F.lit(""))
    rows = lines.where(F.col("key").isin("warning[]", "suggestion[]"))
    return rows.select("file", F.col("line_no").alias("pos"), F.when(F.col("key") == "warning[]", "HIGH").otherwise("MEDIUM").alias("severity"), part(0).alias("test_id"), part(1).alias("description"), part(2).alias("details"), part(3).alias("solution"))


def audit_metadata(lines: DataFrame, names: list[str]) -> DataFrame:
    """A column for each name, the last line winning."""
    return lines.groupBy("file").agg(*[F.max_by("value", F.when(F.col("key") == n, F.col("line_no"))).alias(n) for n in names])


def malware_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Infected files (path, signature, severity) and, for each log, its summary counters, scan mode and whether it was cut off.

    A path may hold ": "; the last one before the signature divides. Counters follow the summary line.
    """
    lines = spark.read.text(path, wholetext=True).select(_file(), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    hit = r"^(.*): (.*) FOUND\s*$"
    found = lines.where(F.col("line").rlike(hit)).select("file", F.col("line_no").alias("pos"), F.regexp_extract("line", hit, 1).alias("path"), F.regexp_extract("line", hit, 2).alias("signature"))
    at = F.min(F.when(F.contains("line", F.lit("SCAN SUMMARY")), F.col("line_no"))).over(W.partitionBy("file"))
    name = F.regexp_replace(F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), r"\s+", "_")
    number = F.regexp_extract("line", r":\s*(\d+)\s*$", 1)
    of = lines.withColumn("_at", at).withColumn("_counter", (F.col("line_no") > F.col("_at")) & (number != ""))
    pair = F.when(F.col("_counter"), F.struct(name.alias("k"), number.try_cast("bigint").alias("v")))
    summary = of.groupBy("file").agg(
        F.map_from_entries(F.collect_list(pair)).alias("summary"),
        F.max(F.nullif(F.regexp_extract("line", r"^SCAN_MODE:\s*(\S+)", 1), F.lit(""))).alias("scan_mode"),
        F.bool_or(F.contains("line", F.lit("WARNING: scan timed out"))).alias("truncated"),
    )
    return found.withColumn("severity", signature_severity("signature")), summary


WINDOWS_FACTS = (
    "hostname string, os string, defender_realtime boolean, firewall_domain boolean, firewall_private boolean, firewall_public boolean, smb1 boolean, rdp_deny int, "
    "rdp_nla int, uac int, bitlocker string, au_option int, days_since_update int, guest_enabled boolean, exec_policy string"
)


def windows_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(WINDOWS_FACTS).json(path).select("*", _file())


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Antivirus history: one detection or a list of them, or none."""
    raw = spark.read.text(path, wholetext=True).select(_file(), F.try_parse_json("value").alias("v"))
    d = raw.select("file", F.try_variant_get("v", "$.detections", "variant").alias("d"))
    row = "struct<file_path:string,signature:string,severity_id:int>"
    many = F.when(F.startswith(F.schema_of_variant("d"), F.lit("ARRAY")), F.try_variant_get("d", "$", f"array<{row}>")).otherwise(F.array_compact(F.array(F.try_variant_get("d", "$", row))))
    return d.select("file", F.posexplode(many).alias("pos", "x")).select("file", "pos", F.col("x.file_path").alias("path"), F.col("x.signature").alias("signature"), detection_severity("x.severity_id").alias("severity"))


CVES = (
    "totalResults int, vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,"
    "metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>,cvssMetricV30:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>>,"
    "references:array<struct<url:string>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string,versionStartIncluding:string,versionEndIncluding:string>>>>>>>>>"
)


def cve_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each product range of a vulnerability. Excluding bounds and other score versions are not read."""
    c = spark.read.option("multiLine", True).schema(CVES).json(path).select(F.explode("vulnerabilities.cve").alias("c"))
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    score = F.coalesce(F.get("c.metrics.cvssMetricV31", F.lit(0))["cvssData"], F.get("c.metrics.cvssMetricV30", F.lit(0))["cvssData"])
    m = c.select(
        F.col("c.id").alias("cve_id"), F.coalesce(english, F.lit("No description.")).alias("description"), F.coalesce(score["baseScore"], F.lit(0.0)).alias("cvss_score"),
        F.coalesce(score["baseSeverity"], F.lit("UNKNOWN")).alias("severity"), F.transform("c.references", lambda r: r["url"]).alias("patch_links"), F.explode("c.configurations").alias("g"),
    )
    m = m.select("cve_id", "description", "cvss_score", "severity", "patch_links", F.explode("g.nodes").alias("n")).withColumn("m", F.explode("n.cpeMatch"))
    out = m.select(cpe_base("m.criteria").alias("cpe_base"), cpe_version("m.criteria").alias("vulnerable_version"), F.col("m.versionStartIncluding").alias("version_start_including"), F.col("m.versionEndIncluding").alias("version_end_including"), "cve_id", "cvss_score", "severity", "description", "patch_links")
    return out.where("cpe_base is not null")


def kev(spark: SparkSession, path: str) -> DataFrame:
    schema = "vulnerabilities array<struct<cveID:string,dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string>>"
    v = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("vulnerabilities").alias("v"))
    return v.select(F.col("v.cveID").alias("cve_id"), F.col("v.dateAdded").try_cast("date").alias("date_added"), F.col("v.dueDate").try_cast("date").alias("due_date"), F.col("v.knownRansomwareCampaignUse").alias("ransomware_use")).where("cve_id is not null")


def epss(spark: SparkSession, path: str) -> DataFrame:
    """Scores with the model's date from the comment line, if there is one; rows with unreadable numbers are left out."""
    raw = spark.read.option("comment", "#").option("header", True).schema("cve string, epss string, percentile string").csv(path).select("*", _file())
    rows = raw.select("file", F.col("cve").alias("cve_id"), F.col("epss").try_cast("double").alias("score"), F.col("percentile").try_cast("double").alias("percentile")).where("score is not null and percentile is not null")
    dates = spark.read.text(path).where(F.startswith("value", F.lit("#"))).select(_file(), F.nullif(F.regexp_extract("value", r"score_date:([^,\s]+)", 1), F.lit("")).alias("model_date"))
    return rows.join(dates.groupBy("file").agg(F.max("model_date").alias("model_date")), "file", "left").drop("file")


def contributions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contributed files: (file, ordered_facts, meta as VARIANT), and the files that can't be used."""
    raw = spark.read.text(path, wholetext=True).select(_file(), F.try_parse_json("value").alias("v"))
    rows = raw.withColumn("ordered_facts", F.try_variant_get("v", "$.ordered_facts", "variant")).withColumn("meta", F.try_variant_get("v", "$._meta", "variant"))
    good = F.col("ordered_facts").isNotNull()
    return rows.where(good).select("file", "ordered_facts", "meta"), rows.where(~good).select("file")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    return spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").schema(schema).json(path)


def rule_documents(rules: DataFrame, most: int = 2000) -> DataFrame:
    """rule_id, text of rendered rules: the parts that are there, a fix cut at `most` characters. rules: rule_id, title, description, rationale, severity, refs, fix_a, fix_b."""
    fix = F.coalesce(F.nullif(F.trim("fix_a"), F.lit("")), F.nullif(F.trim("fix_b"), F.lit("")))
    cut = F.when(F.length(fix) > most, F.concat(F.substring(fix, 1, most), F.lit(" ...[truncated]"))).otherwise(fix)
    named = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    return rules.select("rule_id", F.concat_ws("\n\n", named("Rule", F.col("rule_id")), named("Title", F.col("title")), named("Description", F.col("description")), named("Rationale", F.col("rationale")), named("Severity", F.col("severity")), named("References", F.col("refs")), cut).alias("text"))


#: Folders that a malware scan leaves out; fixed values.
EXCLUDED = ["/proc", "/sys", "/dev", "/run", "/snap"]
EXCLUDED_NAMES = [r"\.cache", r"\.git", "node_modules", "__pycache__", r"\.venv", "venv", r"\.tox", r"\.mypy_cache", r"\.pytest_cache"]


def scanned_paths(files: DataFrame) -> DataFrame:
    """Files with no excluded folder above them. A name in the list counts as the end of a folder's name."""
    return files.where(~F.col("path").rlike("^(" + "|".join(EXCLUDED) + ")(/|$)|(" + "|".join(EXCLUDED_NAMES) + ")/"))
