"""How findings change between scans, as joins and windows over whole histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.scalars import age_days, severity_bucket, severity_rank

#: Which workers' success says that a source was scanned; fixed values.
SOURCE_OWNERS = {
    "network": ["network"], "host_os": ["network", "iot"], "iot_defaults": ["iot"], "filesystem": ["filesystem"],
    "host_audit": ["host_audit"], "malware": ["malware"], "web": ["web"],
}
LIVE = ("NEW", "REAPPEARED", "WORSENED", "IMPROVED", "PERSISTING")


def ran_ok(source: Column, status: Column) -> Column:
    """Whether a worker that owns the source is "ok" in the status map."""
    out = F.lit(False)
    for name, workers in SOURCE_OWNERS.items():
        good = F.lit(False)
        for w in workers:
            good = good | (F.coalesce(F.try_element_at(status, F.lit(w)), F.lit("")) == "ok")
        out = F.when(source == name, good).otherwise(out)
    return F.coalesce(out, F.lit(False))


def new_cves(current: Column, prior: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.coalesce(current, none), F.coalesce(prior, none)))


def delta(prior_cvss: Column, cvss: Column, prior_severity: Column, severity: Column, added: Column) -> Column:
    """WORSENED wins over IMPROVED. A null score counts as 0, an unknown severity as the lowest."""
    a, b = F.coalesce(prior_cvss, F.lit(0.0)), F.coalesce(cvss, F.lit(0.0))
    ra, rb = severity_rank(prior_severity), severity_rank(severity)
    return F.when((b > a) | (F.size(added) > 0) | (rb > ra), "WORSENED").when((b < a) | (rb < ra), "IMPROVED").otherwise("PERSISTING")


def recent_scans(scans: DataFrame, n: int | None = 1) -> DataFrame:
    """The last n scans of each target, rn = 1 the latest; equal times go by scan_id."""
    w = W.partitionBy("target").orderBy(F.desc("started_at"), F.desc("scan_id"))
    ranked = scans.withColumn("rn", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("rn") <= n)


def observations_of(scans: DataFrame, observations: DataFrame, key: str | None = None) -> DataFrame:
    """Observations with their scan's time; those without a scan are left out."""
    rows = observations if key is None else observations.where(F.col("finding_key") == key)
    return rows.join(scans.select("target", "scan_id", "started_at"), ["target", "scan_id"])


def diff_last_two(scans: DataFrame, observations: DataFrame, keep_persisting: bool = False) -> DataFrame:
    """What changed between the last two scans of each target that has two.

    scans: target, scan_id, started_at, status (map). observations: target, scan_id, finding_key, source, cvss, cve_ids (seen ones).
    One aggregation by key, not a self-join. A key that is gone is RESOLVED or UNOBSERVED by the latest scan and has no score.
    """
    last = recent_scans(scans, 2)
    two = last.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.max_by("status", -F.col("rn")).alias("latest_status")).where("n = 2").drop("n")
    pair = last.join(two, "target").select("target", "scan_id", "rn", "latest_status")
    obs = observations.select("target", "scan_id", "finding_key", "source", "cvss", "cve_ids").join(pair, ["target", "scan_id"])
    of = lambda rn: F.max(F.when(F.col("rn") == rn, F.struct("cvss", "source", "cve_ids")))
    rows = obs.groupBy("target", "finding_key").agg(F.any_value("latest_status").alias("st"), of(1).alias("cur"), of(2).alias("old"))
    cur, old = F.col("cur"), F.col("old")
    added = new_cves(cur["cve_ids"], old["cve_ids"])
    gone = F.when(ran_ok(old["source"], F.col("st")), "RESOLVED").otherwise("UNOBSERVED")
    both = delta(old["cvss"], cur["cvss"], severity_bucket(old["cvss"]), severity_bucket(cur["cvss"]), added)
    status = F.when(old.isNull(), "NEW").when(cur.isNull(), gone).otherwise(both)
    out = rows.select("target", "finding_key", status.alias("status"), cur["cvss"].alias("cvss"), old["cvss"].alias("prior_cvss"), F.when(cur.isNotNull(), severity_bucket(cur["cvss"])).alias("severity"), F.when(cur.isNotNull(), added).alias("new_cve_ids"))
    return out if keep_persisting else out.where("status <> 'PERSISTING'")


def diff_order(diff: DataFrame) -> DataFrame:
    return diff.orderBy("target", "status", F.coalesce("cvss", F.lit(0.0)).desc(), "finding_key")


def unchanged_since(observations: DataFrame, current: DataFrame) -> DataFrame:
    """target, finding_key, unchanged_since: the start of the run of seen observations, back from the newest, that equal the current row.

    A scan that didn't see the key doesn't break the run. Null if already the newest one differs (callers fall back on the first sight).
    observations: target, finding_key, started_at, scan_id, seen, cvss, severity, cve_ids. current: target, finding_key, cvss, severity, cve_ids.
    """
    as_set = lambda c: F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    now = current.select("target", "finding_key", F.struct("cvss", "severity", as_set(F.col("cve_ids")).alias("cves")).alias("now"))
    rows = observations.where("seen").join(now, ["target", "finding_key"]).withColumn("same", F.struct("cvss", "severity", as_set(F.col("cve_ids")).alias("cves")).eqNullSafe(F.col("now")))
    back = W.partitionBy("target", "finding_key").orderBy(F.desc("started_at"), F.desc("scan_id")).rowsBetween(W.unboundedPreceding, 0)
    runs = rows.withColumn("run", F.bool_and("same").over(back))
    return runs.groupBy("target", "finding_key").agg(F.min(F.when(F.col("run"), F.col("started_at"))).alias("unchanged_since"))


def compute_drift(current: DataFrame, state: DataFrame, status: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """Verdicts on the union of current and known keys, for all targets at once.

    current: target, finding_key, source, cvss, severity, cve_ids (one row a key). state: target, finding_key, source, status, cvss,
    severity, cve_ids, first_seen, last_seen, occurrences, reappearance_count, solved. status: target, status (map).
    """
    cur = current.select("target", "finding_key", F.struct("source", "cvss", "severity", "cve_ids").alias("cur"))
    old = state.select("target", "finding_key", F.struct(*[c for c in state.columns if c not in ("target", "finding_key")]).alias("old"))
    c, o = F.col("cur"), F.col("old")
    rows = cur.join(old, ["target", "finding_key"], "full_outer")
    known = rows.select("target", "finding_key", *[F.when(c.isNotNull(), c[x]).otherwise(o[x]).alias(x) for x in ("cvss", "severity", "cve_ids")])
    # first what goes by target and key, then what goes by target alone: rows are dealt once for each
    rows = rows.join(unchanged_since(observations, known), ["target", "finding_key"], "left").join(status, "target", "left")
    added = F.when(c.isNull(), F.array().cast("array<string>")).otherwise(new_cves(c["cve_ids"], o["cve_ids"]))
    verdict = (
        F.when(o.isNull(), "NEW")
        .when(c.isNull(), F.when(ran_ok(o["source"], F.coalesce("status", F.create_map().cast("map<string,string>"))), "RESOLVED").otherwise("UNOBSERVED"))
        .when(o["status"] == "resolved", "REAPPEARED")
        .otherwise(delta(o["cvss"], c["cvss"], o["severity"], c["severity"], added))
    )
    changed = F.coalesce("unchanged_since", o["first_seen"])
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("verdict", verdict).withColumn("added", added)
    v, here = F.col("verdict"), c.isNotNull()
    return rows.select(
        "target", "finding_key", v.alias("status"),
        F.when(here, c["cvss"]).otherwise(o["cvss"]).alias("cvss"),
        F.when(here, c["severity"]).otherwise(o["severity"]).alias("severity"),
        F.when(here, F.when(o.isNull(), F.array_sort(F.coalesce(c["cve_ids"], F.array().cast("array<string>")))).otherwise(F.col("added"))).otherwise(F.col("added")).alias("new_cve_ids"),
        o["first_seen"].alias("first_seen"), o["last_seen"].alias("last_seen"),
        F.when(v == "NEW", zero).when(v == "UNOBSERVED", age_days(o["first_seen"], o["last_seen"])).otherwise(age_days(o["first_seen"], now)).alias("age_days"),
        F.when(v == "UNOBSERVED", age_days(changed, o["last_seen"])).when(v == "PERSISTING", age_days(changed, now)).otherwise(zero).alias("days_since_change"),
        (F.coalesce(o["occurrences"], F.lit(0)) + here.cast("int")).cast("bigint").alias("occurrences"),
        (F.coalesce(o["reappearance_count"], F.lit(0)) + (v == "REAPPEARED").cast("int")).cast("bigint").alias("reappearance_count"),
        (here & F.coalesce(o["solved"], F.lit(False))).alias("fix_attempted"),
    )


def history(scans: DataFrame, observations: DataFrame) -> DataFrame:
    """Every target, key and scan from the key's first sight on, with its verdict and the state after the scan.

    seen -> open; absent and its source ran -> resolved; absent otherwise -> as before. Keys meet only the scans after their first one.
    """
    obs = observations.select("target", "scan_id", "finding_key", "source", "cvss").join(scans.select("target", "scan_id", "started_at"), ["target", "scan_id"])
    first = obs.groupBy("target", "finding_key").agg(F.min(F.struct("started_at", "scan_id")).alias("first"))
    grid = first.join(scans, "target").where(F.struct("started_at", "scan_id") >= F.col("first")).select("target", "finding_key", "scan_id", "started_at", F.col("status").alias("scan_status"))
    rows = grid.join(obs.select("target", "scan_id", "finding_key", "source", "cvss"), ["target", "scan_id", "finding_key"], "left").withColumn("seen", F.col("source").isNotNull())
    w = W.partitionBy("target", "finding_key").orderBy("started_at", "scan_id")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    own = F.last("source", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("decided", F.when(F.col("seen"), "open").when(ran_ok(own, F.col("scan_status")), "resolved"))
    rows = rows.withColumn("state", F.last("decided", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.last("decided", ignorenulls=True).over(past))
    verdict = (
        F.when(F.col("seen") & F.col("before").isNull(), "NEW").when(F.col("seen") & (F.col("before") == "resolved"), "REAPPEARED").when(F.col("seen"), "PRESENT")
        .when(F.col("decided") == "resolved", "RESOLVED").otherwise("UNOBSERVED")
    )
    return rows.withColumn("verdict", verdict).select("target", "finding_key", "scan_id", "started_at", "seen", "cvss", "verdict", "state")


def scan_lines(scans: DataFrame, keep: tuple[str, ...] = (), counted: Column | None = None, whole: bool = False) -> DataFrame:
    """target, scan_id, keep, at (pos, started_at), after: the target's next scan, ran: the next one that ran for each source. Of these only pos is told, or with `whole` all of it and scan_id too.

    counted: which scans may stand after another (all).
    """
    later = W.partitionBy("target").orderBy(F.desc("started_at"), F.desc("scan_id"))
    at = F.struct("pos", "started_at", *(["scan_id"] if whole else []))
    mark = at if whole else F.struct("pos")
    mark = mark if counted is None else F.when(counted, mark)
    line = scans.withColumn("pos", -F.row_number().over(later))
    ran = {name: F.last(F.when(ran_ok(F.lit(name), F.col("status")), mark), ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, -1)) for name in SOURCE_OWNERS}
    return line.select("target", "scan_id", *keep, at.alias("at"), F.lag(mark).over(later).alias("after"), F.struct(*[c.alias(name) for name, c in ran.items()]).alias("ran"))


def with_run(rows: DataFrame) -> DataFrame:
    """Observations on scan_lines with run in place of ran: the next scan that ran for their own source."""
    return rows.withColumn("run", F.coalesce(*[F.when(F.col("source") == name, F.col(f"ran.{name}")) for name in SOURCE_OWNERS])).drop("ran")


def _sights(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Observations on scan_lines (with_run) with the key's next sight (next), whether scans without it lie between (gap) and the one that resolved it (closed)."""
    key = W.partitionBy("target", "finding_key").orderBy("at.pos")
    rows = rows.select("target", "finding_key", "source", "cvss", *keep, "at", "after", F.lead("at").over(key).alias("next"), "run")
    gap = F.col("after").isNotNull() & (F.col("next").isNull() | (F.col("next.pos") > F.col("after.pos")))
    closed = F.when(gap & (F.col("next").isNull() | (F.col("run.pos") < F.col("next.pos"))), F.col("run"))
    return rows.withColumns({"gap": gap, "closed": closed}).drop("run")


def _placed(scans: DataFrame, observations: DataFrame, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    return with_run(observations.select("target", "scan_id", "finding_key", "source", "cvss", *keep).join(scan_lines(scans, whole=whole), ["target", "scan_id"]))


def state_of(scans: DataFrame, observations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What state_from_history(history()) gives, from the sights alone: absences are not laid out. keep: columns of a key's last sight that stand beside (source and cvss always)."""
    return state_of_placed(_placed(scans, observations, keep), keep)


def state_of_placed(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """state_of for observations that stand on scan_lines already (with_run)."""
    rows = _sights(rows, keep)
    back = F.lag("closed").over(W.partitionBy("target", "finding_key").orderBy("at.pos")).isNotNull()
    last = F.max_by(F.struct("source", "cvss", *keep, F.col("closed").isNotNull().alias("gone")), "at.pos")
    state = rows.withColumn("back", back).groupBy("target", "finding_key").agg(
        F.min("at.started_at").alias("first_seen"), F.max("at.started_at").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"), F.count_if("back").alias("reappearance_count"), last.alias("x"),
    )
    return state.select("target", "finding_key", "first_seen", "last_seen", F.when(F.col("x.gone"), "resolved").otherwise("open").alias("status"), "occurrences", "reappearance_count", *[F.col(f"x.{c}").alias(c) for c in ("source", "cvss", *keep)])


def change_intervals(scans: DataFrame, observations: DataFrame) -> DataFrame:
    """What history() says, as a row for each change: how long a key was seen with one score, absent and still open, or resolved.

    target, finding_key, state, seen, cvss, source, verdict (of the first scan), valid_from, from_scan, valid_to, to_scan: the scan from which on, and the first one of which it is
    no longer so (null: until now). Absences are not laid out scan by scan: each scan knows the next one that ran for each source, so that a gap between two sights is one or two rows,
    and rows grow with sights and changes and not with keys x scans. unfolded() gives the history back.
    """
    rows, key = _sights(_placed(scans, observations, whole=True)), W.partitionBy("target", "finding_key").orderBy("at.pos")
    old = lambda c: F.lag(c).over(key)
    begins = old("at").isNull() | old("gap") | ~old("cvss").eqNullSafe(F.col("cvss")) | ~old("source").eqNullSafe(F.col("source"))
    verdict = F.when(old("at").isNull(), "NEW").when(old("closed").isNotNull(), "REAPPEARED").otherwise("PRESENT")
    rows = rows.withColumns({"run": F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(key), "verdict": verdict})
    runs = rows.groupBy("target", "finding_key", "run").agg(
        F.min("at").alias("first"), F.min_by("verdict", "at.pos").alias("verdict"), F.any_value("source").alias("source"), F.any_value("cvss").alias("cvss"),
        F.max_by(F.struct("after", "next", "gap", "closed"), "at.pos").alias("x"),
    )
    x = F.col("x")
    part = lambda state, seen, verdict, begin, end: F.struct(F.lit(state).alias("state"), F.lit(seen).alias("seen"), verdict.alias("verdict"), begin.alias("begin"), end.alias("end"))
    none = F.lit(None)
    open_until = F.coalesce(x["closed"], x["next"])
    parts = F.array(
        part("open", True, F.col("verdict"), F.col("first"), x["after"]),
        F.when(x["gap"] & (x["closed"].isNull() | (x["closed"]["pos"] > x["after"]["pos"])), part("open", False, F.lit("UNOBSERVED"), x["after"], open_until)).otherwise(none),
        F.when(x["closed"].isNotNull(), part("resolved", False, F.lit("RESOLVED"), x["closed"], x["next"])).otherwise(none),
    )
    out = runs.select("target", "finding_key", "source", "cvss", F.explode(F.array_compact(parts)).alias("p"))
    return out.select(
        "target", "finding_key", "p.state", "p.seen", F.when(F.col("p.seen"), F.col("cvss")).alias("cvss"), "source", "p.verdict",
        F.col("p.begin.started_at").alias("valid_from"), F.col("p.begin.scan_id").alias("from_scan"), F.col("p.end.started_at").alias("valid_to"), F.col("p.end.scan_id").alias("to_scan"),
    )


def unfolded(intervals: DataFrame, scans: DataFrame) -> DataFrame:
    """The rows of history() for intervals and their scans."""
    begin, end, at = F.struct("valid_from", "from_scan"), F.struct("valid_to", "to_scan"), F.struct("started_at", "scan_id")
    rows = intervals.join(scans, "target").where((at >= begin) & (F.col("to_scan").isNull() | (at < end)))
    later = F.when(F.col("seen"), "PRESENT").when((F.col("state") == "resolved") & ran_ok(F.col("source"), F.col("status")), "RESOLVED").otherwise("UNOBSERVED")
    verdict = F.when(F.col("scan_id") == F.col("from_scan"), F.col("verdict")).otherwise(later)
    return rows.select("target", "finding_key", "scan_id", "started_at", "seen", "cvss", verdict.alias("verdict"), "state")


def state_from_history(hist: DataFrame) -> DataFrame:
    """The state table that folding the scans one by one would leave."""
    return hist.groupBy("target", "finding_key").agg(
        F.min(F.when(F.col("seen"), F.col("started_at"))).alias("first_seen"),
        F.max(F.when(F.col("seen"), F.col("started_at"))).alias("last_seen"),
        F.max_by("state", F.struct("started_at", "scan_id")).alias("status"),
        F.count_if("seen").alias("occurrences"),
        F.count_if(F.col("verdict") == "REAPPEARED").alias("reappearance_count"),
    )


def header(drift: DataFrame, previous: DataFrame) -> DataFrame:
    """One line per target: what changed since its last scan; null on its first. previous: target, previous_at."""
    n = lambda s: F.count_if(F.col("status") == s)
    c = drift.groupBy("target").agg(n("NEW").alias("new"), n("WORSENED").alias("worsened"), n("REAPPEARED").alias("back"), n("RESOLVED").alias("resolved"))
    part = lambda k, text: F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(text)))
    said = F.coalesce(F.nullif(F.concat_ws(", ", part("new", " new"), part("worsened", " worsened"), part("back", " back again"), part("resolved", " resolved")), F.lit("")), F.lit("no changes"))
    line = F.concat(F.lit("Since your last scan on "), F.date_format("previous_at", "MMM d"), F.lit(": "), said, F.lit("."))
    return previous.join(c, "target", "left").na.fill(0, ["new", "worsened", "back", "resolved"]).select("target", "new", "worsened", "back", "resolved", line.alias("drift_header"))


def resolved_list(drift: DataFrame, state: DataFrame) -> DataFrame:
    """target, resolved: what each target's last scan has found gone, as the state knew it, in key order. Targets without any are left out."""
    columns = ["source", *(["affected"] if "affected" in state.columns else []), "cvss", "severity", "first_seen", "last_seen"]
    gone = drift.where("status = 'RESOLVED'").select("target", "finding_key").join(state.select("target", "finding_key", *columns), ["target", "finding_key"])
    return gone.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("finding_key", *columns))).alias("resolved"))


def as_drift_map(diff: DataFrame, open_state: DataFrame) -> DataFrame:
    """Open findings with the last diff's status where it is a live one, else PERSISTING."""
    d = diff.select("target", "finding_key", F.col("status").alias("_s"))
    live = F.when(F.col("_s").isin(*LIVE), F.col("_s")).otherwise("PERSISTING")
    return open_state.join(d, ["target", "finding_key"], "left").withColumn("drift_status", live).drop("_s")
