"""Explainable priority: six weighted terms, a bonus for findings on one asset, hard escalations, a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.scalars import mapped, severity_of_rank, severity_rank

from .drift import as_drift_map
from .findings import default_credentials
from .state import open_table

#: Weights, term values and thresholds; fixed values.
WEIGHTS = {"S": 0.30, "E": 0.25, "X": 0.20, "D": 0.15, "A": 0.05, "F": 0.05}
EXPOSURE = {"network": 1.0, "iot_defaults": 1.0, "web": 1.0, "malware": 1.0, "host_os": 0.6, "host_audit": 0.5, "filesystem": 0.4}
DRIFT = {"REAPPEARED": 1.0, "WORSENED": 0.85, "NEW": 0.6, "PERSISTING": 0.35, "IMPROVED": 0.2}
AGE_CAP_DAYS, BONUS_EACH, BONUS_CAP, FIX_NOW, SOON = 90, 5.0, 15.0, 70.0, 40.0
REACHABLE = ("network", "iot_defaults", "web")
TERM_NAMES = {"S": "severity", "E": "exploitability", "X": "exposure", "D": "drift", "A": "age", "F": "fixability"}


def clamp(x: Column, top: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(top), x))


def terms() -> dict[str, Column]:
    """Over the columns source, cvss, kev, epss_percentile, drift_status, age_days, remediation_refs."""
    return {
        "S": clamp(F.coalesce("cvss", F.lit(0.0)) / 10),
        "E": F.when(F.coalesce("kev", F.lit(False)), 1.0).otherwise(clamp(F.coalesce("epss_percentile", F.lit(0.0)))),
        "X": mapped("source", EXPOSURE, 0.5),
        "D": mapped(F.coalesce("drift_status", F.lit("NEW")), DRIFT, DRIFT["NEW"]),
        "A": clamp(F.coalesce("age_days", F.lit(0)) / AGE_CAP_DAYS),
        "F": F.when(F.coalesce(F.size("remediation_refs"), F.lit(0)) > 0, 1.0).otherwise(0.3),
    }


def with_asset(rows: DataFrame) -> DataFrame:
    """rows with _asset, what a finding sits on: a port (services, web addresses) or a directory (malware); null for others. Texts are read step by step, each once a row."""
    source = F.col("source")
    at = F.when(source == "web", F.regexp_extract("finding_key", r"(?s)^[^:]*:[^:]*:(.+)$", 1))
    path = F.when(source == "malware", F.trim(F.regexp_replace(F.coalesce("affected", F.lit("")), r"(?s)^.*?File: ", "")))
    out = rows.withColumns({"_port": F.when(source.isin("network", "iot_defaults"), F.regexp_extract("finding_key", r"^net:(\d+)/", 1)), "_at": at, "_path": path})
    out = out.withColumn("_url", F.when(F.contains("_at", F.lit("://")), F.col("_at")).when(F.col("_at") != "", F.concat(F.lit("http://"), "_at")))
    out = out.withColumns({
        "_host": F.regexp_extract("_url", r"^\w[\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), "_given": F.regexp_extract("_url", r"^\w[\w+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1),
        "_folder": F.regexp_extract("_path", r"(?s)^(.*)/[^/]*$", 1),
    })
    web = F.when(F.col("_given") != "", F.col("_given")).when(F.startswith("_url", F.lit("https://")), "443").otherwise("80")
    asset = (
        F.when(F.col("_port") != "", F.concat(F.lit("port:"), "_port"))
        .when(F.col("_host") != "", F.concat(F.lit("port:"), web))
        .when(F.col("_folder") != "", F.concat(F.lit("dir:"), "_folder"))
    )
    return out.withColumn("_asset", asset).drop("_port", "_at", "_path", "_url", "_host", "_given", "_folder")


def correlation_bonus(keys: list[str], on: Column) -> Column:
    """For each of n >= 2 findings on one asset, 5 for each other one, 15 at most."""
    n = F.count(on).over(W.partitionBy(*keys, on))
    return F.when(on.isNotNull() & (n >= 2), F.least(F.lit(BONUS_CAP), BONUS_EACH * (n - 1))).otherwise(0.0)


def with_default_creds(findings: DataFrame) -> DataFrame:
    """findings with default_creds: as given, else by the scripts' output, else null."""
    if "default_creds" in findings.columns:
        return findings
    return findings.withColumn("default_creds", default_credentials() if "script_findings" in findings.columns else F.lit(None).cast("boolean"))


#: The texts of the escalations are fixed values too.
def escalations() -> Column:
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.array_compact(F.array(
        F.when((F.col("source") == "malware") & F.col("severity").isin("critical", "high"), "active malware detection"),
        F.when(has("kev") & F.col("source").isin(*REACHABLE), "CVE in CISA KEV on a reachable service"),
        F.when(has("default_creds"), "factory-default credentials exposed"),
        F.when((F.col("drift_status") == "REAPPEARED") & (F.coalesce("reappearance_count", F.lit(0)) >= 2), "reappeared 2+ times — a fix keeps being undone"),
    ))


def scored(findings: DataFrame, keys: list[str], on: Column | None = None) -> DataFrame:
    """findings with terms, correlation_bonus, score, escalations, band, priority_explanation. Columns that are missing count as null."""
    kinds = {"kev": "boolean", "epss_percentile": "double", "drift_status": "string", "age_days": "bigint", "remediation_refs": "array<string>", "reappearance_count": "bigint", "affected": "string"}
    findings = with_default_creds(findings)
    rows = findings.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in findings.columns})
    t = terms()
    # the asset as a column: it is read from its texts once a row, not again after the window
    rows = (with_asset(rows) if on is None else rows.withColumn("_asset", on)).withColumn("terms", F.struct(*[x.alias(k) for k, x in t.items()]))
    rows = rows.withColumn("correlation_bonus", correlation_bonus(keys, F.col("_asset"))).drop("_asset")
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + F.lit(w) * F.col(f"terms.{k}")
    rows = rows.withColumn("score", clamp(100 * total + F.col("correlation_bonus"), 100.0)).withColumn("escalations", escalations())
    band = F.when((F.size("escalations") > 0) | (F.col("score") >= FIX_NOW), "FIX NOW").when(F.col("score") >= SOON, "SOON").otherwise("WATCH")
    ranked = F.sort_array(F.array(*[F.struct((-F.lit(w) * F.col(f"terms.{k}")).alias("w"), F.lit(i).alias("i"), F.lit(TERM_NAMES[k]).alias("name")) for i, (k, w) in enumerate(WEIGHTS.items())]))
    top = F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["name"]), " and ")
    said = F.concat(F.col("band"), F.lit(" (score "), F.bround("score", 0).cast("int").cast("string"), F.lit(") — top factors: "), top, F.lit("."))
    why = F.when(F.size("escalations") > 0, F.concat(F.lit(" Escalated: "), F.array_join("escalations", "; "), F.lit("."))).otherwise("")
    return rows.withColumn("band", band).withColumn("priority_explanation", F.concat(said, why))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """scored() rows with rank: escalated first, then by score, then by ref."""
    w = W.partitionBy(*keys).orderBy((F.size("escalations") > 0).desc(), F.desc("score"), "ref")
    return rows.withColumn("rank", F.row_number().over(w))


def fix_now() -> Column:
    return F.col("band") == "FIX NOW"


def split_by_band(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(fix_now()), rows.where(~fix_now())


def risk_columns(findings: DataFrame) -> DataFrame:
    """findings with what worst_of reads: _worst, the severity's rank, and _rising, whether the row alone makes a set critical."""
    findings = with_default_creds(findings)
    findings = findings.withColumns({c: F.lit(None).cast(t) for c, t in (("kev", "boolean"), ("epss_percentile", "double")) if c not in findings.columns})
    rank = severity_rank("severity")
    rising = (
        ((F.col("source") == "malware") & (rank >= 2)) | F.coalesce("default_creds", F.lit(False))
        | (F.col("source").isin(*REACHABLE) & (F.coalesce("kev", F.lit(False)) | (F.coalesce("epss_percentile", F.lit(0.0)) >= 0.9)))
    )
    return findings.withColumns({"_worst": rank, "_rising": rising})


def worst_of(here: Column | None = None) -> Column:
    """An aggregate over risk_columns: the overall risk of the group's rows, or of those where here holds; of none it is that of a null rank."""
    of = lambda c: F.col(c) if here is None else F.when(here, F.col(c))
    critical = F.bool_or(of("_rising")) | (F.count_if(of("_worst") >= 2) >= 3)
    return F.when(critical, "critical").otherwise(severity_of_rank(F.max(of("_worst"))))


def overall_risk(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The worst severity of a set of findings, or critical: malware of high or more, default credentials, a reachable known or likely exploit, or three findings of high or more."""
    return risk_columns(findings).groupBy(*keys).agg(worst_of().alias("overall_risk"))


def open_ranked(state: DataFrame, diff: DataFrame, intel: DataFrame) -> DataFrame:
    """Open findings of each target without a new scan, ranked: the open table, the last diff's verdicts where they are live ones, and exploit intel.

    state: the state table; diff: target, finding_key, status; intel: target, finding_key, kev, epss_percentile.
    """
    marked = as_drift_map(diff, open_table(state))
    rows = marked.join(intel.select("target", "finding_key", "kev", "epss_percentile"), ["target", "finding_key"], "left")
    return ranked(scored(rows, ["target"]), ["target"])
