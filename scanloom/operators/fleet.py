"""Fleets: host inventory, roll-ups over hosts, coverage, windowed risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scalars import host_class, severity_of_rank, severity_rank, spark_bar, web_target

from .matching import in_networks


def open_ports(ports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, open_ports: distinct, sorted. ports: keys, port, state."""
    return ports.where("state = 'open'").groupBy(*keys).agg(F.array_sort(F.collect_set("port")).alias("open_ports"))


def inventory(hosts: DataFrame, networks: DataFrame, ports: DataFrame) -> DataFrame:
    """Hosts with an address; those outside the networks are out_of_scope without ports, the others classified by ports and vendor."""
    rows = in_networks(hosts.where("ip is not null"), networks).join(open_ports(ports, ["ip"]), "ip", "left")
    found = F.when(F.col("in_scope"), F.coalesce("open_ports", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("open_ports", found).withColumn("_c", host_class("open_ports", "vendor"))
    return rows.withColumns({
        "status": F.when(F.col("in_scope"), F.col("status")).otherwise("out_of_scope"),
        "os_guess": F.when(F.col("in_scope"), F.col("_c.os_guess")).otherwise("unknown"),
        "transport": F.when(F.col("in_scope"), F.col("_c.transport")),
    }).drop("_c")


def host_results(hosts: DataFrame, tracks: DataFrame) -> DataFrame:
    """A status for each host and source: what a track reported, not_assessed for what no track covers; filesystem is never assessed remotely."""
    every = hosts.select("ip").withColumn("source", F.explode(F.array(*map(F.lit, ("network", "host_audit", "malware", "filesystem")))))
    out = every.join(tracks.select("ip", "source", F.col("status").alias("_s")), ["ip", "source"], "left")
    return out.withColumn("status", F.when(F.col("source") == "filesystem", "not_assessed").otherwise(F.coalesce("_s", F.lit("not_assessed")))).drop("_s")


def summary(hosts: DataFrame, keys: list[str], with_hosts: bool = True) -> DataFrame:
    """Per fleet: hosts, assessed, errored, the worst risk (unknown if none was assessed) and hosts by risk: their lists, or without them their numbers, as a very large fleet's list is one row.

    hosts: keys, ip, status, overall_risk; an unknown risk counts as low.
    """
    ok, rank = F.col("status") == "ok", severity_rank("overall_risk")
    at = lambda n: F.array_sort(F.collect_list(F.when(ok & (rank == n), F.col("ip"))))
    agg = hosts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_hosts"), F.count_if(ok).alias("assessed"), F.count_if(F.col("status") == "error").alias("errored"),
        F.max(F.when(ok, rank)).alias("_w"), *[at(n).alias(f"{s}_hosts") if with_hosts else F.count_if(ok & (rank == n)).alias(s) for n, s in enumerate(("low", "medium", "high", "critical"))],
    )
    return agg.withColumn("worst_risk", F.coalesce(severity_of_rank("_w"), F.lit("unknown"))).drop("_w")


def coverage(hosts: DataFrame) -> DataFrame:
    """ip, scanner, status, one row a cell; a host in error has the single cell _sweep. hosts: ip, status, scanner_status (map)."""
    cells = F.when(F.col("status") == "error", F.create_map(F.lit("_sweep"), F.lit("error"))).otherwise(F.coalesce("scanner_status", F.create_map().cast("map<string,string>")))
    return hosts.select("ip", F.explode(cells).alias("scanner", "status"))


def coverage_matrix(cells: DataFrame, scanners: list[str]) -> DataFrame:
    return cells.groupBy("ip").pivot("scanner", scanners).agg(F.first("status"))


def totals(findings: DataFrame) -> DataFrame:
    """Findings and the worst score for each fleet and target, each fleet, and all (null where it is a total)."""
    return findings.rollup("fleet", "target").agg(F.count(F.lit(1)).alias("findings"), F.max("cvss").alias("worst_cvss"), F.grouping_id().alias("level"))


def risk_history(scans: DataFrame, observations: DataFrame, with_empty: bool = False) -> DataFrame:
    """The highest score seen in each scan, 0 if none; scans without observations only if asked for. observations: target, scan_id, seen, cvss."""
    how = "left" if with_empty else "inner"
    agg = observations.groupBy("target", "scan_id").agg(F.coalesce(F.max(F.when(F.col("seen"), F.col("cvss"))), F.lit(0.0)).alias("risk"))
    return scans.select("target", "scan_id", "started_at").join(agg, ["target", "scan_id"], how).withColumn("risk", F.coalesce("risk", F.lit(0.0)))


def sparkline(history: DataFrame) -> DataFrame:
    """A target's risks as bars in the order of its scans."""
    pair = F.struct("started_at", "scan_id", spark_bar("risk").alias("bar"))
    return history.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["bar"]), "").alias("sparkline"))


def windowed_risk(rows: DataFrame, time: str, value: str, keys: list[str], length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and the highest value by time window; the same for batch and stream."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    agg = rows.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("highest"))
    return agg.select(F.col("window.start").alias("window_start"), *keys, "n", "highest")


def web_targets(ports: DataFrame, host: str) -> DataFrame:
    """target, address: what to scan of each target, by all the ports seen of it, whatever their state. ports: target, port and the host's column."""
    seen = ports.groupBy("target").agg(F.any_value(host).alias("_host"), F.bool_or(F.col("port") == 443).alias("_tls"), F.bool_or(F.col("port") == 80).alias("_plain"))
    known = F.array_compact(F.array(F.when(F.col("_tls"), 443), F.when(F.col("_plain"), 80)))
    return seen.select("target", web_target("_host", known).alias("address"))
