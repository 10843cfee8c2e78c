"""Joins that enrich findings: versions against vulnerability records, exploit feeds, catalogs, address ranges, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.scalars import address_hex, address_prefix, severity_bucket
from scanloom.functions.versions import cpe_base, cpe_part, cpe_version, in_parsed_range, parsed_range, parsed_version, version_key

#: Bytes of a side that is joined by broadcast, at most, by Spark's estimate of its plan; above that Spark shuffles both sides. Of files the estimate is their compressed size, which memory may exceed INFLATION times.
BROADCAST_BYTES, INFLATION = 64 << 20, 16


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if Spark's estimate of its size is at most `most` bytes, as it is otherwise. Nothing is run for it."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * INFLATION <= most else df


#: Columns that say all that a record's range is matched by; rows of each side that meet in one cell of a pair join, about.
RANGE, CELL = ["cpe_base", "_exact", "_low", "_high"], 2048


def _versioned(services: DataFrame, allow_non_app: bool) -> DataFrame:
    s = services.where((cpe_part("cpe") == "a") | F.lit(allow_non_app)).withColumn("cpe_base", cpe_base("cpe")).where("cpe_base is not null")
    return s.withColumn("_text", parsed_version(cpe_version("cpe"))["text"])


def _ranged(records: DataFrame) -> DataFrame:
    bound = {"_exact": "vulnerable_version", "_low": "version_start_including", "_high": "version_end_including"}
    return records.withColumns({k: F.coalesce(v, F.lit("")) for k, v in bound.items()})


def _candidates(s: DataFrame, r: DataFrame, depth: int | None) -> DataFrame:
    """Pairs of s (cpe_base, _text) and r (RANGE) with _version and _range: all of a product, or with a depth those by block_candidates."""
    s, r = s.withColumn("_version", parsed_version("_text")), r.withColumn("_range", parsed_range("_exact", "_low", "_high"))
    if depth is None:
        return s.join(r, "cpe_base")
    block = lambda key: F.slice(key, 1, depth)
    s, r = s.withColumn("_block", block(F.col("_version.key"))), r.withColumn("_exact_key", block(version_key("_exact")))
    b, x = F.col("_block"), F.col("_range")
    low, high = block(x["low_key"]), block(x["high_key"])
    above = (x["low"] == "") | ((low <= b) & ((x["high"] != "") | (F.get(b, F.lit(0)) <= F.get(low, F.lit(0)) + 1)))
    below = (x["high"] == "") | (b <= high)
    # what an exact version goes on to has at least its numbers
    touches = F.when((x["exact"] != "") & (x["exact"] != "*"), F.slice(b, F.lit(1), F.size("_exact_key")) == F.col("_exact_key")).otherwise(above & below)
    blocks = s.select("cpe_base", "_block").distinct()
    placed = r.join(blocks, "cpe_base").where(F.coalesce(touches, F.lit(False))).drop("_exact_key")
    return s.join(placed, ["cpe_base", "_block"])


def _met(s: DataFrame, r: DataFrame, depth: int | None = None) -> DataFrame:
    """Distinct versions (cpe_base, _text, _services) with the distinct ranges (RANGE, _records) in which they lie."""
    texts = s.groupBy("cpe_base", "_text").agg(F.count(F.lit(1)).alias("_services"))
    ranges = r.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("_records"))
    return _candidates(texts, ranges, depth).where(in_parsed_range("_version", "_range")).select(*RANGE, "_text", "_services", "_records")


def _pairs(services: DataFrame, records: DataFrame, depth: int | None, allow_non_app: bool) -> DataFrame:
    """Versions are compared once for each distinct version and range; services and records then meet by equal keys, in cells of about CELL rows a side.

    Cells are dealt by hash to as many tasks as there are shuffle partitions, as tasks made by bytes would be few: a pair is far smaller read than written out.
    """
    s, r = _versioned(services, allow_non_app), _ranged(records)
    parts = int(services.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = lambda n: F.ceil(n / CELL).cast("int")
    met = _met(s, r, depth).select(*RANGE, "_text", cells(F.sum("_services").over(W.partitionBy(*RANGE))).alias("_is"), cells(F.col("_records")).alias("_js"))
    place = lambda df, n: F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # one text, as constant columns are left out of a join's keys and structs are cast for it, and the rows would then be dealt again
    cell = F.to_json(F.struct(*RANGE, "_i", "_j")).alias("_cell")
    own = lambda df: [c for c in df.columns if c not in ("_text", *RANGE)]
    here = s.join(met, ["cpe_base", "_text"]).select(*s.columns, *RANGE[1:], place(s, "_is").alias("_i"), every("_js").alias("_j")).select(cell, "cpe_base", *own(s))
    there = r.join(met.select(*RANGE, "_is", "_js").distinct(), RANGE).select(*r.columns, place(r, "_js").alias("_j"), every("_is").alias("_i")).select(cell, *own(r))
    return here.repartition(parts, "_cell").join(there.repartition(parts, "_cell"), "_cell").drop("_cell")


def match_versions(services: DataFrame, records: DataFrame, allow_non_app: bool = False) -> DataFrame:
    """A row for each service (with cpe) and vulnerability record in whose version range it lies.

    Each distinct version of a product is compared with each distinct range of it; rows then meet by version and range, so that work beyond that grows
    with the rows found. A vulnerability that matches by two ranges stands twice.
    """
    return _pairs(services, records, None, allow_non_app)


def block_candidates(services: DataFrame, records: DataFrame, depth: int = 2, allow_non_app: bool = False) -> DataFrame:
    """Pairs of services and records of a product whose versions can meet: an interval join by blocks of the first `depth` numbers.

    A record is laid to those blocks of its product in which there is a service at all and that its range touches, and meets services there only. So a product with many services and
    many records compares about the pairs that match and those in the blocks at a range's ends, where match_versions compares all; and its pairs are dealt out by block.
    """
    return _candidates(_versioned(services, allow_non_app), _ranged(records), depth).drop("_text", *RANGE[1:])


def match_versions_by_block(services: DataFrame, records: DataFrame, depth: int = 2, allow_non_app: bool = False) -> DataFrame:
    """As match_versions, for products with many versions and many ranges."""
    return _pairs(services, records, depth, allow_non_app)


def useful(matches: DataFrame) -> DataFrame:
    return matches.where((F.col("cvss_score") > 0) & (F.col("severity") != "UNKNOWN"))


def _row(links_a_cve: int) -> Column:
    return F.struct("cve_id", "cvss_score", "severity", F.slice(F.coalesce("patch_links", F.array().cast("array<string>")), 1, links_a_cve).alias("patch_links")).alias("_row")


def _counts(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.groupBy(*keys).agg(F.max("cvss_score").alias("highest_cvss"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"), F.count_if(F.col("severity") == "HIGH").alias("high_count"))


def _added(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.max("highest_cvss").alias("highest_cvss"), F.sum("critical_count").alias("critical_count"), F.sum("high_count").alias("high_count"))


def _worst(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k worst records (_row) of each key, numbered; a task keeps k of a key before the shuffle."""
    order = [F.desc("_row.cvss_score"), F.col("_row.cve_id"), F.col("_row.patch_links"), F.col("_row.severity")]
    return rows.select(*keys, "_row").withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k)


def _with_summary(services: DataFrame, counts: DataFrame, worst: DataFrame, keys: list[str], links: int, keep_unmatched: bool) -> DataFrame:
    top = worst.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_row"))), lambda x: x["_row"]).alias("cves"))
    agg = counts.join(top, keys)
    out = services.join(agg, keys, "left" if keep_unmatched else "inner")
    flat = F.flatten(F.transform(F.coalesce("cves", F.array().cast(agg.schema["cves"].dataType)), lambda c: c["patch_links"]))
    return out.withColumns({
        "highest_cvss": F.coalesce("highest_cvss", F.lit(0.0)),
        "critical_count": F.coalesce("critical_count", F.lit(0)),
        "high_count": F.coalesce("high_count", F.lit(0)),
        "remediation_links": F.slice(F.array_distinct(flat), 1, links),
    })


def condensed(services: DataFrame, matches: DataFrame, keys: list[str], k: int = 5, links: int = 4, links_a_cve: int = 2, keep_unmatched: bool = True) -> DataFrame:
    """Per service: highest score, critical and high counts, its k worst records and up to `links` distinct links in the order of the records.

    Records are ranked first, so that a task keeps k of a service before the shuffle and no more than k are collected.
    """
    return _with_summary(services, _counts(matches, keys), _worst(matches.select(*keys, _row(links_a_cve)), keys, k), keys, links, keep_unmatched)


def condensed_records(services: DataFrame, records: DataFrame, keys: list[str], k: int = 5, links: int = 4, links_a_cve: int = 2, keep_unmatched: bool = True, allow_non_app: bool = False) -> DataFrame:
    """condensed over the useful matches of services and records, without a row a match: records are condensed by range, ranges by version, versions by service."""
    s, r = _versioned(services, allow_non_app), _ranged(useful(records))
    version = ["cpe_base", "_text"]
    met = _met(s, r).select(*RANGE, "_text")
    counts = _added(met.join(_counts(r, RANGE), RANGE), version)
    worst = _worst(met.join(_worst(r.select(*RANGE, _row(links_a_cve)), RANGE, k).drop("_n"), RANGE), version, k).drop("_n")
    own = s.select(*keys, *[c for c in version if c not in keys])
    return _with_summary(services, _added(own.join(counts, version), keys), _worst(own.join(worst, version), keys, k), keys, links, keep_unmatched)


def host_os_findings(systems: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Condensed findings of host systems; those without a record are left out."""
    return condensed_records(systems, records, keys, keep_unmatched=False, allow_non_app=True).withColumn("severity", severity_bucket("highest_cvss"))


def exploit_intel(finding_cves: DataFrame, kev: DataFrame, epss: DataFrame, keys: list[str]) -> DataFrame:
    """Per finding: kev (any id is listed), epss and epss_percentile (the highest of each, on their own). finding_cves: keys, cve_id."""
    rows = finding_cves.join(small(kev.select("cve_id").distinct().withColumn("listed", F.lit(True))), "cve_id", "left")
    rows = rows.join(small(epss.select("cve_id", "score", "percentile")), "cve_id", "left")
    return rows.groupBy(*keys).agg(
        F.coalesce(F.bool_or("listed"), F.lit(False)).alias("kev"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("epss"),
        F.coalesce(F.max("percentile"), F.lit(0.0)).alias("epss_percentile"),
    )


def enriched_tests(findings: DataFrame, catalog: DataFrame, category: Column) -> DataFrame:
    """Test ids with the catalog's category; description and solution only where they are blank or "-"."""
    blank = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    c = catalog.select("test_id", *[F.col(x).alias(f"catalog_{x}") for x in ("category", "description", "solution")])
    out = findings.join(small(c), "test_id", "left")
    return out.withColumns({
        "category": F.coalesce("catalog_category", category),
        "description": F.coalesce(blank(F.col("description")), F.col("catalog_description"), F.col("description")),
        "solution": F.coalesce(blank(F.col("solution")), F.col("catalog_solution"), F.col("solution")),
    }).drop("catalog_category", "catalog_description", "catalog_solution")


def overlaid(authored: DataFrame, generated: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Entries of two catalogs by key: the generated one's columns win, except for those in kept."""
    both = [c for c in authored.columns if c != key]
    g = generated.select(key, *[F.col(c).alias(f"g_{c}") for c in both if c in generated.columns])
    out = authored.join(g, key, "full_outer")
    return out.select(key, *[F.coalesce(f"g_{c}", c).alias(c) if f"g_{c}" in out.columns and c not in kept else F.col(c) for c in both])


def preferred(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of each key with the lowest rank; null ranks are left out."""
    cols = [c for c in rows.columns if c not in keys]
    best = rows.withColumn("_rank", rank).where("_rank is not null").groupBy(*keys).agg(F.min_by(F.struct(*cols), "_rank").alias("_x"))
    return best.select(*keys, "_x.*")


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """listing with state: new, changed (time, size or inode differ) or same."""
    old = manifest.select("path", F.struct("mtime", "size", "inode").alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(~F.struct("mtime", "size", "inode").eqNullSafe(F.col("_old")), "changed").otherwise("same")
    return listing.join(old, "path", "left").withColumn("state", state).drop("_old")


def in_networks(hosts: DataFrame, networks: DataFrame) -> DataFrame:
    """hosts (ip) with in_scope: whether some network (cidr, IPv4 or IPv6; host bits may be set) holds the address.

    Addresses meet networks by equal prefixes, of the lengths that occur in the networks only (162 at most, so those are broadcast).
    """
    whole = F.split(F.trim("cidr"), "/")
    nets = networks.select(address_hex(F.get(whole, F.lit(0))).alias("digits"), F.get(whole, F.lit(1)).try_cast("int").alias("given"), (F.size(whole) == 2).alias("said"))
    nets = nets.where("digits is not null and (given is not null or not said) and coalesce(given, 0) between 0 and length(digits) * 4")
    nets = nets.select(F.length("digits").alias("width"), F.coalesce("given", F.length("digits") * 4).alias("bits"), "digits")
    nets = nets.select("width", "bits", address_prefix("digits", "bits").alias("prefix")).distinct()
    rows = hosts.withColumn("_digits", address_hex("ip"))
    seen = rows.select("ip", "_digits", F.length("_digits").alias("width")).distinct().join(F.broadcast(nets.select("width", "bits").distinct()), "width")
    held = seen.select("ip", "width", "bits", address_prefix("_digits", "bits").alias("prefix")).join(nets, ["width", "bits", "prefix"], "left_semi").select("ip").distinct()
    return rows.drop("_digits").join(held.withColumn("in_scope", F.lit(True)), "ip", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def nearest_ancestor(paths: DataFrame, groups: DataFrame, root: str) -> DataFrame:
    """Each path with the deepest group directory above it and below the root, else its parent."""
    parts = F.split(F.expr(f"substring(path, {len(root) + 2})"), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.struct(i.alias("depth"), F.concat(F.lit(f"{root}/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("group_dir")))
    rows = paths.select("path", F.explode(above).alias("a")).select("path", "a.*").join(groups.select("group_dir").distinct(), "group_dir")
    best = rows.groupBy("path").agg(F.max_by("group_dir", "depth").alias("group_dir"))
    return paths.join(best, "path", "left").withColumn("group_dir", F.coalesce("group_dir", F.regexp_replace("path", "/[^/]*$", "")))


def first_profile(products: DataFrame, profiles: DataFrame, tiers: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first tier that each product has, and the products with none."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")), F.lit(0))
    found = preferred(profiles.join(products.select("product").distinct(), "product", "left_semi"), ["product"], rank)
    return found, products.join(found, "product", "left_anti")


def with_markers(reported: DataFrame, findings: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """Report rows with the columns `marks` of the finding of equal `affected`; of several the last by ref. Unknown ones get nulls."""
    last = findings.groupBy(*keys, "affected").agg(F.max_by(F.struct(*marks), "ref").alias("_m"))
    return reported.join(last, [*keys, "affected"], "left").select(*reported.columns, *[F.col(f"_m.{c}").alias(c) for c in marks])


def severity_mismatches(reported: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Reported rows whose `affected` is unknown or whose severity differs."""
    known = findings.groupBy(*keys, "affected").agg(F.max_by("severity", "ref").alias("_known"))
    out = reported.join(known, [*keys, "affected"], "left")
    return out.where(~F.col("_known").eqNullSafe(F.col("severity")) | F.col("_known").isNull()).drop("_known")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order; a filter on the rank, so that each task keeps one row of a key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
