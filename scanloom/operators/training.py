"""Training data: merging by content, leak-free stratified splits, batches, seeded samples, scoring of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.text import leaks, parsed_report
from scanloom.functions.versions import bumped, humanized, plausible_version

from .shared import with_running_sum
from .state import batched


def merged(store: DataFrame, incoming: DataFrame, content: str = "ordered_facts") -> tuple[DataFrame, DataFrame]:
    """The new rows (first file of equal content wins, status pending, source real), and inserted and skipped counts."""
    hashed = incoming.withColumn("content_hash", F.sha2(content, 256))
    first = hashed.groupBy("content_hash").agg(F.min_by(F.struct(*incoming.columns), "file").alias("x"), F.count(F.lit(1)).alias("_n"))
    known = store.select(F.sha2(content, 256).alias("content_hash")).distinct()
    new = first.join(known, "content_hash", "left_anti")
    rows = new.select("content_hash", "x.*", F.lit("real").alias("source"), F.lit("pending").alias("status"))
    counts = first.join(known.withColumn("_k", F.lit(True)), "content_hash", "left").agg(
        F.count_if(F.col("_k").isNull()).alias("inserted"), (F.sum("_n") - F.count_if(F.col("_k").isNull())).alias("skipped")
    )
    return rows, counts


def shape_of(tiers: Column) -> Column:
    """empty, all_good (only low), critical (any) or mixed. tiers: array of severities."""
    return F.when(F.size(tiers) == 0, "empty").when(F.array_contains(tiers, "critical"), "critical").when(F.forall(tiers, lambda t: t == "low"), "all_good").otherwise("mixed")


def input_shape(tiers: Column) -> Column:
    bad = F.size(F.filter(tiers, lambda t: t != "low"))
    return F.when(F.size(tiers) == 0, "empty").when(bad == 0, "all_good").when(bad == 1, "single_issue").otherwise("mixed")


def tier_histogram(tiers: Column) -> Column:
    # a lambda with two parameters would get the place as the second
    of = lambda s: F.size(F.filter(tiers, lambda t: t == s))
    return F.struct(*[of(s).alias(s) for s in ("critical", "high", "medium", "low")])


def stratified_split(rows: DataFrame, stratum: list[str], content: str, fraction: float = 0.1, order: Column | None = None, seed: int = 0) -> DataFrame:
    """rows with split: whole content units of each stratum, in a seeded order, go to eval until it has max(1, round half even(n * fraction)) rows.

    Equal content stays together within a stratum. Rows are first summed by unit; running counts go by ranges of units, so that no task holds a stratum.
    Null contents are one unit, null strata a stratum.
    """
    unit = F.coalesce(F.sha2(F.col(content), 256), F.lit(""))
    keyed = rows.withColumn("_unit", unit)
    units = keyed.groupBy(*stratum, "_unit").agg(F.count(F.lit(1)).alias("_rows"), (F.min(order) if order is not None else F.min(F.xxhash64(F.lit(seed), F.col("_unit")))).alias("_order"))
    summed = with_running_sum(units, stratum, ["_order", "_unit"], "_rows", "_before")
    target = F.greatest(F.lit(1), F.bround(F.col("_before_total") * fraction, 0).cast("bigint"))
    sides = summed.select(*[F.col(c).alias(f"_of_{c}") for c in (*stratum, "_unit")], F.when(F.col("_before") < target, "eval").otherwise("train").alias("split"))
    same = F.col("_unit") == F.col("_of__unit")
    for c in stratum:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return keyed.join(sides, same).select(*rows.columns, "split")


def split_report(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.groupBy(*group).pivot("split", ["train", "eval"]).agg(F.count(F.lit(1))).na.fill(0, ["train", "eval"])


def superseded(rows: DataFrame, facts: str = "ordered_facts") -> DataFrame:
    """Rows whose facts (a JSON list) hold one without the key fix_facts; empty lists stay."""
    parsed = F.from_json(facts, "array<map<string,string>>")
    old = F.coalesce(F.exists(parsed, lambda m: ~F.map_contains_key(m, "fix_facts")), F.lit(False))
    return rows.withColumn("status", F.when(old, "superseded").otherwise(F.col("status")))


def with_platform(rows: DataFrame) -> DataFrame:
    return rows.withColumn("platform", F.coalesce("platform", F.lit("linux")) if "platform" in rows.columns else F.lit("linux"))


def pending_rows(rows: DataFrame, without_source: str, limit: int | None = None) -> DataFrame:
    out = rows.where((F.col("status") == "pending") & (F.col("source") != without_source)).orderBy("id")
    return out if limit is None else out.limit(limit)


def scored_outputs(outputs: DataFrame, reported: DataFrame, mismatched: DataFrame) -> DataFrame:
    """index with parsed, text_ok, severities_ok, passed. outputs: index, raw_output; mismatched: indexes whose severities were changed."""
    v = parsed_report("raw_output")
    text = F.concat_ws("\n", F.get_json_object(F.to_json(v), "$.summary"), F.get_json_object(F.to_json(v), "$.good_news"), F.regexp_replace(F.coalesce(F.get_json_object(F.to_json(v), "$.findings"), F.lit("")), r'"references":\[[^\]]*\]', ""))
    rows = outputs.select("index", v.isNotNull().alias("parsed"), (v.isNotNull() & ~leaks(text)).alias("text_ok"))
    bad = mismatched.select("index").distinct().withColumn("_bad", F.lit(True))
    out = rows.join(bad, "index", "left").withColumn("severities_ok", F.col("parsed") & F.col("_bad").isNull()).drop("_bad")
    return out.withColumn("passed", F.col("parsed") & F.col("text_ok") & F.col("severities_ok"))


def score_totals(scored: DataFrame) -> DataFrame:
    """The pass rate and each failure's first cause: parsing, then text, then severities."""
    p, t, s = F.col("parsed"), F.col("text_ok"), F.col("severities_ok")
    return scored.agg(F.count(F.lit(1)).alias("total"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), *([F.avg("latency").alias("mean_latency")] if "latency" in scored.columns else []), F.count_if(~p).alias("parse_failures"), F.count_if(p & ~t).alias("text_failures"), F.count_if(p & t & ~s).alias("severity_failures"))


def seeded(value: Column, seed: int) -> Column:
    """An order without meaning that a seed repeats, in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def seeded_top(rows: DataFrame, keys: list[str], value: Column, n: int, order: Column | None = None, seed: int = 0) -> DataFrame:
    """n rows of each key in a seeded hash order (or the one given): a sample that repeats."""
    w = W.partitionBy(*keys).orderBy(order if order is not None else seeded(value, seed), value)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def product_versions(records: DataFrame, n: int = 5, order: Column | None = None, seed: int = 0) -> DataFrame:
    """At most n plausible distinct versions of each product, "1.0" if there is none, and the version after each."""
    good = records.where(plausible_version("vulnerable_version")).select("cpe_base", F.col("vulnerable_version").alias("version")).distinct()
    some = seeded_top(good, ["cpe_base"], F.col("version"), n, order, seed)
    every = records.select("cpe_base").distinct().join(some, "cpe_base", "left").withColumn("version", F.coalesce("version", F.lit("1.0")))
    return every.withColumn("next_version", bumped("version"))


def one_service_a_port(rows: DataFrame, without_ports: list[int], n: int, seed: int = 0) -> DataFrame:
    """One row in seeded order for each port that isn't left out, n ports at most."""
    one = seeded_top(rows.where(~F.col("port").isin(without_ports)), ["port"], F.col("service"), 1, seed=seed)
    return one.orderBy(seeded(F.col("port"), seed), "port").limit(n)


def chat_records(rows: DataFrame, system: str, user: str = "ordered_facts", answer: str = "label") -> DataFrame:
    """One JSON line for each validated row: system, user and assistant messages."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.where("status = 'validated'").select(F.to_json(F.struct(F.array(m("system", F.lit(system)), m("user", F.col(user)), m("assistant", F.col(answer))).alias("messages"))).alias("value"))


def rows_by_prefix(records: DataFrame, prefixes: list[str], n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """At most n scored records for each product prefix in seeded order, with the prefix; a record stands under each prefix that it begins with."""
    held = F.array_compact(F.array(*[F.when(F.startswith("cpe_base", F.lit(p)), F.lit(p)) for p in prefixes]))
    rows = records.where("cvss_score > 0").withColumn("prefix", F.explode(held))
    return seeded_top(rows, ["prefix"], F.concat_ws("|", "cpe_base", "cve_id"), n, order, seed)


def batch_prep(rows: DataFrame, done: DataFrame, size: int, first: int, skeleton: DataFrame | None = None, without_source: str = "synthetic") -> DataFrame:
    """Pending rows that no earlier batch holds, numbered by id into batches from `first` on, with the row's skeleton (id, skeleton) if given."""
    todo = rows.where((F.col("status") == "pending") & (F.col("source") != without_source))
    out = batched(todo, done, "id", size, first)
    return out if skeleton is None else out.join(skeleton, "id", "left")


def collection_record(runs: DataFrame) -> DataFrame:
    """What is kept of a collected run: content hash, shape, counts by severity, and for each source its status, or its number of records.

    runs: ordered_facts, tiers (array of severities), results (map of source to struct<status,records>).
    """
    told = F.transform_values("results", lambda k, v: F.when(v.isNull(), "missing").when(v["records"].isNotNull(), v["records"].cast("string")).otherwise(F.coalesce(v["status"], F.lit("ok"))))
    return runs.select("*", F.sha2("ordered_facts", 256).alias("content_hash"), input_shape(F.col("tiers")).alias("shape"), tier_histogram(F.col("tiers")).alias("histogram"), told.alias("sources"))


def vocabulary_pools(records: DataFrame, n: int = 5, order: Column | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Service and package pools: readable names with versions and the version after each, for products that serve a port (records with service) and for the others (with package)."""
    named = product_versions(records, n, order, seed).withColumn("name", humanized("cpe_base"))
    kinds = records.groupBy("cpe_base").agg(F.max("service").alias("service"), F.max("package").alias("package"))
    rows = named.join(kinds, "cpe_base")
    return rows.where("service is not null").drop("package"), rows.where("package is not null").drop("service")
