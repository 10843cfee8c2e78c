"""The given tables read as scans, observations and feeds, once for Spark and once as SQL text for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scans(t: Tables) -> DataFrame:
    """target, scan_id, started_at, status: an order is a scan of its customer."""
    status = F.create_map(
        F.lit("network"), F.when(F.col("o_orderkey") % 7 == 0, "error").otherwise("ok"),
        F.lit("filesystem"), F.when(F.col("o_orderkey") % 5 == 0, "unavailable").otherwise("ok"),
    )
    return t("orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


def seen(t: Tables, on: DataFrame | None = None) -> DataFrame:
    """target, scan_id, started_at, finding_key, source, cvss, cve_ids: an order's lines by supplier group are its findings.

    Lines are grouped by order before they meet the orders, both dealt to as many tasks as there are shuffle partitions: tasks made by shuffled bytes would hold and sort many more rows.
    on: a row a scan (target, scan_id, started_at) with more columns, which stand beside, in place of the orders.
    """
    line = t("lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("finding_key"), "l_quantity", "l_partkey")
    order = t("orders").select("o_orderkey", F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("started_at")) if on is None else on.withColumnRenamed("scan_id", "o_orderkey")
    more = [] if on is None else [c for c in on.columns if c not in ("target", "scan_id", "started_at")]
    parts = int(line.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = order.repartition(parts, "o_orderkey")
    found = line.repartition(parts, "l_orderkey").groupBy("l_orderkey", "finding_key").agg(F.max("l_quantity").alias("_most"), F.collect_set("l_partkey").alias("_parts"))
    rows = found.join(order.distinct() if on is None else order, F.col("l_orderkey") == F.col("o_orderkey"))
    cves = F.sort_array(F.transform("_parts", lambda p: F.concat(F.lit("CVE-"), p.cast("string"))))
    return rows.select(
        "target", F.col("o_orderkey").alias("scan_id"), "started_at", "finding_key", (F.floor(F.col("_most") / 12.5) * 2.5).cast("double").alias("cvss"), cves.alias("cve_ids"),
        F.when(F.col("finding_key") % 2 == 0, "network").otherwise("filesystem").alias("source"), *more,
    )


def kev(t: Tables) -> DataFrame:
    return t("part").where("p_partkey % 40 = 0").select(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"))


def epss(t: Tables) -> DataFrame:
    return t("part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"), (F.col("p_size") / 100.0).alias("score"), (F.col("p_partkey") % 100 / 100.0).alias("percentile"))


def _version(n: str) -> str:
    return f"concat(cast(cast(floor(({n}) / 10.0) as bigint) as string), '.', cast(({n}) % 10 as string))"


def vulnerabilities(t: Tables) -> DataFrame:
    """Records by product brand, with a range of versions written as text."""
    brand = "lower(replace(p_brand, '#', '_'))"
    severity = F.when(F.col("cvss_score") >= 90, "CRITICAL").when(F.col("cvss_score") >= 70, "HIGH").otherwise("MEDIUM")
    rows = t("part").selectExpr(
        f"concat('cpe:2.3:a:tpch:', {brand}) as cpe_base", "'*' as vulnerable_version", f"{_version('p_size')} as version_start_including",
        f"{_version('p_size + 15')} as version_end_including", "concat('CVE-2024-', cast(p_partkey as string)) as cve_id", "cast((p_retailprice - 900) / 10 as double) as cvss_score",
        "array(concat('https://x/', cast(p_partkey as string))) as patch_links",
    )
    return rows.withColumn("severity", severity)


def suppliers(t: Tables) -> DataFrame:
    return t("supplier").selectExpr("s_suppkey", f"concat('cpe:2.3:a:tpch:', lower(concat('brand_', cast(s_suppkey % 25 + 1 as string))), ':', {_version('s_suppkey % 60')}) as cpe")


SCANS = """scans as (
  select o_custkey as target, o_orderkey as scan_id, o_orderdate as started_at,
         case when o_orderkey % 7 = 0 then 'error' else 'ok' end as network_status,
         case when o_orderkey % 5 = 0 then 'unavailable' else 'ok' end as filesystem_status,
         row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
  from orders)"""
SEEN = """seen as (
  select o_custkey as target, o_orderkey as scan_id, o_orderdate as started_at, l_suppkey % 4 as finding_key,
         case when l_suppkey % 2 = 0 then 'network' else 'filesystem' end as source,
         cast(2.5 * floor(max(l_quantity) / 12.5) as double) as cvss,
         list_sort(list_distinct(list('CVE-' || l_partkey))) as cve_ids
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4, 5)"""
FEEDS = """kev as (select 'CVE-' || p_partkey as cve_id from part where p_partkey % 40 = 0),
epss as (select 'CVE-' || p_partkey as cve_id, p_size / 100.0 as score, (p_partkey % 100) / 100.0 as percentile from part where p_partkey % 3 <> 0)"""
SEVERITY = "case when {0} >= 9 then 'critical' when {0} >= 7 then 'high' when {0} >= 4 then 'medium' else 'low' end"
RANK = "case {0} when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end"
RAN_OK = "case {0} when 'network' then network_status = 'ok' else filesystem_status = 'ok' end"
