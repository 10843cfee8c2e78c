"""Registered queries over the given tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import scalars, text, versions
from scanloom.operators import drift, findings, fleet, matching, priority, remediation, retrieval, state, training
from scanloom.operators.shared import dealt, written

from . import adapters as A

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the tables under its name."""

    def keep(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(A.tables(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


SEV = A.SEVERITY.format
RNK = A.RANK.format
CVSS_RANK = lambda c: A.RANK.format("(" + A.SEVERITY.format(c) + ")")

# drift

_DIFF = f"""
with {A.SCANS}, {A.SEEN},
two as (select target from scans where rn <= 2 group by target having count(*) = 2),
cur as (select s.* from seen s join scans c on s.target = c.target and s.scan_id = c.scan_id and c.rn = 1),
old as (select s.* from seen s join scans c on s.target = c.target and s.scan_id = c.scan_id and c.rn = 2),
j as (
  select coalesce(cur.target, old.target) as target, coalesce(cur.finding_key, old.finding_key) as finding_key, cur.cvss as c, old.cvss as o, old.source as src,
         cur.target is not null as here, old.target is not null as there,
         list_sort(list_filter(coalesce(cur.cve_ids, []), lambda x: not list_contains(coalesce(old.cve_ids, []), x))) as added
  from cur full join old on cur.target = old.target and cur.finding_key = old.finding_key),
v as (
  select j.target, finding_key, c as cvss, o as prior_cvss, here, added,
         case when not there then 'NEW'
              when not here then case when {A.RAN_OK.format("src")} then 'RESOLVED' else 'UNOBSERVED' end
              when c > o or len(added) > 0 or {CVSS_RANK("c")} > {CVSS_RANK("o")} then 'WORSENED'
              when c < o or {CVSS_RANK("c")} < {CVSS_RANK("o")} then 'IMPROVED' else 'PERSISTING' end as status
  from j join two on j.target = two.target join scans on scans.target = j.target and scans.rn = 1)
"""


def _diff(t, with_cves: bool, keep: bool = False) -> DataFrame:
    obs = A.seen(t)
    if not with_cves:
        obs = obs.withColumn("cve_ids", F.array().cast("array<string>"))
    return drift.diff_last_two(A.scans(t), obs, keep)


@query(_DIFF.replace("list_sort(list_distinct(list('CVE-' || l_partkey)))", "cast([] as varchar[])") + f"select target, finding_key, status, cvss, prior_cvss, case when here then {SEV('cvss')} end as severity from v where status <> 'PERSISTING'")
def drift_diff_last_two(t):
    return _diff(t, with_cves=False).drop("new_cve_ids")


@query(_DIFF + "select target, finding_key, status, array_to_string(added, ',') as new_cve_ids from v where here")
def new_cves(t):
    return _diff(t, with_cves=True, keep=True).where("cvss is not null").select("target", "finding_key", "status", F.array_join("new_cve_ids", ",").alias("new_cve_ids"))


@query(_DIFF.replace("list_sort(list_distinct(list('CVE-' || l_partkey)))", "cast([] as varchar[])") + """
, c as (select target, count(*) filter (status = 'NEW') as n, count(*) filter (status = 'WORSENED') as w, count(*) filter (status = 'RESOLVED') as r from v group by target),
p as (select target, started_at as previous_at from scans where rn = 2)
select p.target, coalesce(n, 0) as new, coalesce(w, 0) as worsened, 0::bigint as back, coalesce(r, 0) as resolved,
       'Since your last scan on ' || strftime(previous_at, '%b %-d') || ': ' || coalesce(nullif(concat_ws(', ',
         case when n > 0 then n || ' new' end, case when w > 0 then w || ' worsened' end, case when r > 0 then r || ' resolved' end), ''), 'no changes') || '.' as drift_header
from p left join c on p.target = c.target""")
def drift_header(t):
    previous = drift.recent_scans(A.scans(t), 2).where("rn = 2").select("target", F.col("started_at").alias("previous_at"))
    return drift.header(_diff(t, with_cves=False), previous)


_HISTORY = f"""
with {A.SCANS}, {A.SEEN},
firsts as (select target, finding_key, min(row(started_at, scan_id)) as f from seen group by 1, 2),
grid as (
  select scans.*, finding_key from firsts join scans on scans.target = firsts.target and row(started_at, scan_id) >= f),
g as (
  select grid.*, seen.cvss, seen.source is not null as was_seen,
         last_value(seen.source ignore nulls) over (partition by grid.target, grid.finding_key order by grid.started_at, grid.scan_id rows between unbounded preceding and current row) as src
  from grid left join seen on seen.target = grid.target and seen.scan_id = grid.scan_id and seen.finding_key = grid.finding_key),
d as (select *, case when was_seen then 'open' when {A.RAN_OK.format("src")} then 'resolved' end as decided from g),
h as (
  select *, last_value(decided ignore nulls) over (w rows between unbounded preceding and current row) as state,
         last_value(decided ignore nulls) over (w rows between unbounded preceding and 1 preceding) as before
  from d window w as (partition by target, finding_key order by started_at, scan_id)),
hist as (
  select target, finding_key, scan_id, started_at, was_seen as seen, cvss, state,
         case when was_seen and before is null then 'NEW' when was_seen and before = 'resolved' then 'REAPPEARED' when was_seen then 'PRESENT'
              when decided = 'resolved' then 'RESOLVED' else 'UNOBSERVED' end as verdict
  from h)
"""


@query(_HISTORY + "select * from hist")
def drift_history(t):
    return drift.history(A.scans(t), A.seen(t))


@query(_HISTORY + """select target, finding_key, min(started_at) filter (seen) as first_seen, max(started_at) filter (seen) as last_seen,
       arg_max(state, row(started_at, scan_id)) as status, count(*) filter (seen) as occurrences, count(*) filter (verdict = 'REAPPEARED') as reappearance_count
from hist group by 1, 2""")
def finding_state_rebuild(t):
    return drift.state_from_history(drift.history(A.scans(t), A.seen(t)))


@query(_HISTORY + """, marked as (
  select *, case when lag(seen) over w is distinct from seen or lag(state) over w is distinct from state or lag(cvss) over w is distinct from cvss then 1 else 0 end as b
  from hist window w as (partition by target, finding_key order by started_at, scan_id)),
numbered as (select *, sum(b) over (partition by target, finding_key order by started_at, scan_id rows between unbounded preceding and current row) as run from marked),
spans as (select target, finding_key, run, any_value(state) as state, any_value(seen) as seen, any_value(cvss) as cvss, arg_min(verdict, row(started_at, scan_id)) as verdict, min(row(started_at, scan_id)) as f from numbered group by 1, 2, 3)
select target, finding_key, state, seen, cvss, verdict, f[1] as valid_from, f[2] as from_scan, lead(f[1]) over w as valid_to, lead(f[2]) over w as to_scan
from spans window w as (partition by target, finding_key order by run)""")
def drift_intervals(t):
    return drift.change_intervals(A.scans(t), A.seen(t)).drop("source")


@query(_HISTORY + "select * from hist")
def drift_unfolded(t):
    return drift.unfolded(drift.change_intervals(A.scans(t), A.seen(t)), A.scans(t))


@query(_HISTORY + """, k as (select target, finding_key, min(started_at) filter (seen) as first_seen, max(started_at) filter (seen) as last_seen,
       arg_max(state, row(started_at, scan_id)) as status, count(*) filter (seen) as occurrences, count(*) filter (verdict = 'REAPPEARED') as reappearance_count, arg_max(cvss, row(started_at, scan_id)) filter (seen) as cvss from hist group by 1, 2)
select *, case when finding_key % 2 = 0 then 'network' else 'filesystem' end as source from k""")
def finding_state(t):
    """The state of every key from its sights, without a row for each scan that it was absent from."""
    return drift.state_of(A.scans(t), A.seen(t))


_NOW = "timestamp '2000-01-01 00:00:00'"


_PLACE = ["at", "after", "run"]


def _with_rank(t) -> DataFrame:
    """The observations with severity, rn, the place of their scan among the target's (1: the last), and where it stands among those before the last. Orders know their place before lines meet them, and rows are dealt by key, as all that follows goes by it."""
    scans = drift.recent_scans(A.scans(t), None).where("target is not null")
    lines = drift.scan_lines(scans, ("started_at", "rn"), F.col("rn") > 1)
    return dealt(drift.with_run(A.seen(t, lines)).withColumn("severity", scalars.severity_bucket("cvss")), "seen", ["target", "finding_key"])


def _before_last(ranked: DataFrame) -> DataFrame:
    """The observations of _with_rank before each target's last scan."""
    return ranked.where("rn > 1").drop("rn", *_PLACE).withColumn("seen", F.lit(True))


def _state_before_last(t, ranked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state before each target's last scan (written, as it enters twice and is far smaller than what it is made of), the findings of that scan, and its status. ranked: what _with_rank gives."""
    ranked = _with_rank(t) if ranked is None else ranked
    st = drift.state_of_placed(ranked.where("rn > 1"), ("severity", "cve_ids")).withColumn("solved", F.col("finding_key") == 3)
    last = drift.recent_scans(A.scans(t)).select("target", "status", "started_at", "scan_id")
    return dealt(st, "state", ["target", "finding_key"]), ranked.where("rn = 1").drop("rn", *_PLACE), last


_DRIFT = _HISTORY.replace("firsts as (", "past_seen as (select s.* from seen s join scans c on s.target = c.target and s.scan_id = c.scan_id and rn > 1),\nfirsts as (").replace(
    "as f from seen group", "as f from past_seen group").replace("firsts join scans on scans.target = firsts.target and", "firsts join scans on rn > 1 and scans.target = firsts.target and") + f"""
, st as (
  select hist.target, hist.finding_key, min(hist.started_at) filter (seen) as first_seen, max(hist.started_at) filter (seen) as last_seen,
         arg_max(state, row(hist.started_at, hist.scan_id)) as status, count(*) filter (seen) as occurrences, count(*) filter (verdict = 'REAPPEARED') as back
  from hist group by 1, 2),
snap as (select target, finding_key, arg_max(row(source, cvss, cve_ids), row(started_at, scan_id)) as x from past_seen group by 1, 2),
old as (select st.*, x[1] as source, x[2] as cvss, x[3] as cve_ids, st.finding_key = 3 as solved from st join snap on st.target = snap.target and st.finding_key = snap.finding_key),
cur as (select s.* from seen s join scans c on s.target = c.target and s.scan_id = c.scan_id and rn = 1),
known as (select target, finding_key, cvss, cve_ids from cur union all select target, finding_key, cvss, cve_ids from old where not exists (select 1 from cur where cur.target = old.target and cur.finding_key = old.finding_key)),
runs as (
  select p.target, p.finding_key, p.started_at, bool_and(p.cvss = k.cvss and p.cve_ids = k.cve_ids) over (partition by p.target, p.finding_key order by p.started_at desc, p.scan_id desc rows between unbounded preceding and current row) as same
  from past_seen p join known k on p.target = k.target and p.finding_key = k.finding_key),
since as (select target, finding_key, min(started_at) filter (same) as u from runs group by 1, 2),
j as (
  select coalesce(c.target, o.target) as target, coalesce(c.finding_key, o.finding_key) as finding_key, c.target is not null as here, o.target is not null as there,
         c.cvss as cc, o.cvss as oc, o.status as ost, o.source as src, o.first_seen, o.last_seen, o.occurrences, o.back, o.solved,
         list_sort(list_filter(coalesce(c.cve_ids, []), lambda x: not list_contains(coalesce(o.cve_ids, []), x))) as added
  from cur c full join old o on c.target = o.target and c.finding_key = o.finding_key),
v as (
  select j.*, case when not there then 'NEW'
      when not here then case when {A.RAN_OK.format("src")} then 'RESOLVED' else 'UNOBSERVED' end
      when ost = 'resolved' then 'REAPPEARED'
      when cc > oc or len(added) > 0 or {CVSS_RANK("cc")} > {CVSS_RANK("oc")} then 'WORSENED'
      when cc < oc or {CVSS_RANK("cc")} < {CVSS_RANK("oc")} then 'IMPROVED' else 'PERSISTING' end as status,
      coalesce(u, first_seen) as unchanged
  from j join scans on scans.target = j.target and rn = 1 left join since on since.target = j.target and since.finding_key = j.finding_key)
select target, finding_key, status, case when here then cc else oc end as cvss, {SEV("(case when here then cc else oc end)")} as severity, array_to_string(added, ',') as new_cve_ids, first_seen, last_seen,
       cast(case status when 'NEW' then 0 when 'UNOBSERVED' then greatest(0, date_diff('day', first_seen, last_seen)) else greatest(0, date_diff('day', first_seen, {_NOW})) end as bigint) as age_days,
       cast(case status when 'UNOBSERVED' then greatest(0, date_diff('day', unchanged, last_seen)) when 'PERSISTING' then greatest(0, date_diff('day', unchanged, {_NOW})) else 0 end as bigint) as days_since_change,
       coalesce(occurrences, 0) + cast(here as int) as occurrences, coalesce(back, 0) + cast(status = 'REAPPEARED' as int) as reappearance_count, here and coalesce(solved, false) as fix_attempted
from v"""


@query(_DRIFT)
def drift_verdicts(t):
    ranked = _with_rank(t)
    st, cur, last = _state_before_last(t, ranked)
    return drift.compute_drift(cur, st, last.select("target", "status"), _before_last(ranked), F.expr(_NOW)).withColumn("new_cve_ids", F.array_join("new_cve_ids", ","))


@query(f"""
with {A.SCANS}, {A.SEEN}, latest as (select target, finding_key, arg_max(row(cvss, cve_ids), row(started_at, scan_id)) as x from seen group by 1, 2),
runs as (
  select s.target, s.finding_key, s.started_at,
         bool_and(s.cvss = x[1] and s.cve_ids = x[2]) over (partition by s.target, s.finding_key order by s.started_at desc, s.scan_id desc rows between unbounded preceding and current row) as same
  from seen s join latest l on s.target = l.target and s.finding_key = l.finding_key)
select target, finding_key, min(started_at) filter (same) as unchanged_since from runs group by 1, 2""")
def unchanged_since(t):
    obs = A.seen(t).withColumns({"seen": F.lit(True), "severity": scalars.severity_bucket("cvss")})
    now = obs.groupBy("target", "finding_key").agg(F.max_by(F.struct("cvss", "severity", "cve_ids"), F.struct("started_at", "scan_id")).alias("x")).select("target", "finding_key", "x.*")
    return drift.unchanged_since(obs, now)


@query(f"""
with {A.SCANS}, {A.SEEN}, known as (select distinct s.target, s.finding_key, s.source from seen s join scans c on s.target = c.target and s.scan_id = c.scan_id and rn > 1)
, cur as (select s.* from seen s join scans c on s.target = c.target and s.scan_id = c.scan_id and rn = 1)
select scans.target, scan_id, finding_key, seen, cvss, cves from scans join (
  select target, finding_key, true as seen, cvss, array_to_string(cve_ids, ',') as cves from cur
  union all
  select target, finding_key, false, null, null from known k where not exists (select 1 from cur where cur.target = k.target and cur.finding_key = k.finding_key)) x on x.target = scans.target and rn = 1""")
def observations_with_gaps(t):
    st, cur, last = _state_before_last(t)
    rows = state.scan_rows(cur.withColumn("version", F.lit(None).cast("string")), st, last.select("target", "scan_id", "started_at"))
    return rows.select("target", "scan_id", "finding_key", "seen", "cvss", F.array_join("cve_ids", ",").alias("cves"))


@query(f"""with {A.SCANS}, {A.SEEN} select scans.target, scans.scan_id, scans.started_at, coalesce(max(cvss), 0.0) as risk
from scans left join seen on seen.target = scans.target and seen.scan_id = scans.scan_id group by 1, 2, 3""")
def risk_history(t):
    return fleet.risk_history(A.scans(t), A.seen(t).withColumn("seen", F.lit(True)), with_empty=True)


@query(f"""with {A.SCANS}, {A.SEEN}, h as (select scans.target, scans.scan_id, scans.started_at, max(cvss) as risk from scans join seen on seen.target = scans.target and seen.scan_id = scans.scan_id group by 1, 2, 3)
select target, string_agg(substr('▁▂▃▄▅▆▇█', cast(least(7, greatest(0, trunc(risk / 10.0 * 7))) as bigint) + 1, 1), '' order by started_at, scan_id) as sparkline from h group by target""")
def risk_sparkline(t):
    return fleet.sparkline(fleet.risk_history(A.scans(t), A.seen(t).withColumn("seen", F.lit(True))))


# matching, intel, priority

_VULN = """vuln as (
  select 'tpch:' || lower(replace(p_brand, '#', '_')) as base, [p_size // 10, p_size % 10] as lo, [(p_size + 15) // 10, (p_size + 15) % 10] as hi, 'CVE-2024-' || p_partkey as cve_id,
         cast((p_retailprice - 900) / 10 as double) as cvss_score, p_partkey from part),
svc as (select s_suppkey, 'tpch:brand_' || (s_suppkey % 25 + 1) as base, [(s_suppkey % 60) // 10, (s_suppkey % 60) % 10] as ver from supplier)"""


@query(f"with {_VULN} select s_suppkey, cve_id, cvss_score from svc join vuln on svc.base = vuln.base and ver >= lo and ver <= hi")
def cve_match(t):
    return matching.match_versions(A.suppliers(t), A.vulnerabilities(t)).select("s_suppkey", "cve_id", "cvss_score")


@query(f"with {_VULN} select s_suppkey, cve_id, cvss_score from svc join vuln on svc.base = vuln.base and ver >= lo and ver <= hi")
def cve_match_by_block(t):
    return matching.match_versions_by_block(A.suppliers(t), A.vulnerabilities(t)).select("s_suppkey", "cve_id", "cvss_score")


@query(f"""with {_VULN}, m as (select s_suppkey, cve_id, cvss_score, p_partkey, case when cvss_score >= 90 then 'CRITICAL' when cvss_score >= 70 then 'HIGH' else 'MEDIUM' end as severity
  from svc join vuln on svc.base = vuln.base and ver >= lo and ver <= hi where cvss_score > 0),
a as (select s_suppkey, max(cvss_score) as h, count(*) filter (severity = 'CRITICAL') as c, count(*) filter (severity = 'HIGH') as g,
        list(cve_id order by cvss_score desc, cve_id)[1:5] as cves, list('https://x/' || p_partkey order by cvss_score desc, cve_id)[1:4] as links from m group by 1)
select svc.s_suppkey, coalesce(h, 0.0) as highest_cvss, coalesce(c, 0) as critical_count, coalesce(g, 0) as high_count, coalesce(array_to_string(cves, ','), '') as cves, coalesce(array_to_string(links, ','), '') as links
from svc left join a on svc.s_suppkey = a.s_suppkey""")
def cve_summary_top5(t):
    s = A.suppliers(t)
    out = matching.condensed_records(s, A.vulnerabilities(t), ["s_suppkey"])
    ids = F.coalesce(F.array_join(F.transform("cves", lambda c: c["cve_id"]), ","), F.lit(""))
    return out.select("s_suppkey", "highest_cvss", "critical_count", "high_count", ids.alias("cves"), F.array_join("remediation_links", ",").alias("links"))


_INTEL = f"""fc as (select target, scan_id, finding_key, unnest(cve_ids) as cve_id from seen),
intel as (
  select target, scan_id, finding_key, coalesce(bool_or(kev.cve_id is not null), false) as kev, coalesce(max(score), 0.0) as epss, coalesce(max(percentile), 0.0) as epss_percentile
  from fc left join kev on fc.cve_id = kev.cve_id left join epss on fc.cve_id = epss.cve_id group by 1, 2, 3)"""


@query(f"with {A.SEEN}, {A.FEEDS}, {_INTEL} select target, scan_id, finding_key, kev, cast(epss as double) as epss, cast(epss_percentile as double) as epss_percentile from intel")
def exploit_intel(t):
    return _intel(t, A.seen(t))


def _intel(t, seen: DataFrame) -> DataFrame:
    cves = seen.select("target", "scan_id", "finding_key", F.explode("cve_ids").alias("cve_id"))
    return matching.exploit_intel(cves, A.kev(t), A.epss(t), ["target", "scan_id", "finding_key"]).withColumns({c: F.col(c).cast("double") for c in ("epss", "epss_percentile")})


def _table(t) -> DataFrame:
    """The findings of all scans with intel and severity; two findings of a source share an asset."""
    seen = written(A.seen(t), "seen")
    rows = seen.withColumn("severity", scalars.severity_bucket("cvss")).withColumn("ref", F.col("finding_key"))
    return rows.join(_intel(t, seen), ["target", "scan_id", "finding_key"])


_SCORE = f"""
with {A.SEEN}, {A.FEEDS}, {_INTEL},
f as (select seen.*, kev, epss, epss_percentile, {SEV("cvss")} as severity, count(*) over (partition by seen.target, seen.scan_id, seen.source) as n
      from seen join intel on seen.target = intel.target and seen.scan_id = intel.scan_id and seen.finding_key = intel.finding_key),
b as (select *, case when n >= 2 then least(15.0, 5.0 * (n - 1)) else 0.0 end as correlation_bonus, kev and source = 'network' as escalated from f),
s as (
  select *, greatest(0, least(100, 100 * (0.30 * least(1, greatest(0, cvss / 10)) + 0.25 * case when kev then 1 else epss_percentile end
      + 0.20 * case source when 'network' then 1.0 else 0.4 end + 0.15 * 0.6 + 0.05 * 0 + 0.05 * 0.3) + correlation_bonus)) as score from b),
r as (select *, case when escalated or score >= 70 then 'FIX NOW' when score >= 40 then 'SOON' else 'WATCH' end as band,
      row_number() over (partition by target, scan_id order by escalated desc, round(score, 6) desc, finding_key) as rank from s)
"""


def _ranked(t) -> DataFrame:
    rows = priority.scored(_table(t), ["target", "scan_id"], on=F.col("source"))
    return priority.ranked(rows.withColumn("score", F.round("score", 6)), ["target", "scan_id"])


@query(_SCORE + "select target, scan_id, finding_key, cast(round(score, 6) as double) as score, cast(correlation_bonus as double) as correlation_bonus, escalated, band, rank from r")
def priority_rank(t):
    return _ranked(t).select("target", "scan_id", "finding_key", "score", "correlation_bonus", (F.size("escalations") > 0).alias("escalated"), "band", F.col("rank").cast("bigint").alias("rank"))


@query(_SCORE + "select band, severity, count(*) as findings from r group by 1, 2")
def priority_bands(t):
    return _ranked(t).groupBy("band", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query(_SCORE + f"""select target, scan_id, case when bool_or(source = 'network' and (kev or epss_percentile >= 0.9)) or count(*) filter (severity in ('high', 'critical')) >= 3 then 'critical'
  else ['low', 'medium', 'high', 'critical'][cast(max({RNK("severity")}) as bigint) + 1] end as overall_risk from f group by 1, 2""")
def overall_risk(t):
    return priority.overall_risk(_table(t), ["target", "scan_id"])


@query(f"""with {A.SCANS}, {A.SEEN}, o as (select target, finding_key, arg_max(cvss, row(started_at, scan_id)) as cvss, max(row(started_at, scan_id)) as at from seen group by 1, 2)
select target, finding_key, cvss, row_number() over (partition by target order by finding_key) - 1 as ref from o where finding_key <> 3""")
def open_table(t):
    obs = A.seen(t)
    last = obs.groupBy("target", "finding_key").agg(F.max_by("cvss", F.struct("started_at", "scan_id")).alias("cvss"))
    return state.open_table(last.withColumns({"status": F.lit("open"), "solved": F.col("finding_key") == 3})).select("target", "finding_key", "cvss", F.col("ref").cast("bigint").alias("ref"))


# findings builder

@query("""with k as (select l_orderkey, l_linenumber as pos, l_partkey % 5 as port, l_suppkey, row_number() over (partition by l_orderkey, l_partkey % 5 order by l_linenumber, l_suppkey) as n from lineitem)
select l_orderkey as scan_id, pos, port, l_suppkey from k where n = 1""")
def findings_dedup_first_wins(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 5).alias("port"), "l_suppkey")
    return findings.first_wins(rows, ["scan_id", "port"], [F.col("pos"), F.col("l_suppkey")])


_PKG_SEV = "case when l_quantity >= 40 then 'CRITICAL' when l_quantity >= 25 then 'HIGH' when l_quantity >= 10 then 'MEDIUM' else 'LOW' end"
#: Lines of an order repeat numbers, so the place in a source needs more to be unique.
_POS = "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey"


def _packages(t) -> DataFrame:
    return t("lineitem").select(
        (F.col("l_orderkey") % 100).alias("target"), F.col("l_orderkey").alias("scan_id"), F.expr(_POS).alias("pos"), F.concat(F.lit("pkg "), (F.col("l_partkey") % 3).cast("string")).alias("package"),
        F.lit("1.0").alias("version"), F.concat(F.lit("CVE-"), F.col("l_partkey").cast("string")).alias("cve_id"), F.expr(_PKG_SEV).alias("severity"), F.col("l_returnflag").alias("fixed_version"), F.col("l_linestatus").alias("description"),
    )


@query(f"""with p as (select l_orderkey as scan_id, {_POS} as pos, 'pkg ' || (l_partkey % 3) as package, 'CVE-' || l_partkey as cve, l_returnflag as fix, l_linestatus as d,
  case {_PKG_SEV} when 'CRITICAL' then 9.5 when 'HIGH' then 7.5 when 'MEDIUM' then 5.0 else 3.0 end as cvss from lineitem),
c as (select scan_id, package, string_agg(cve, ',' order by m) as ids from (select scan_id, package, cve, min(pos) as m from p group by 1, 2, 3) group by 1, 2),
x as (select scan_id, package, string_agg(fix, ',' order by m) as fixes from (select scan_id, package, fix, min(pos) as m from p group by 1, 2, 3) group by 1, 2),
a as (select scan_id, package, max(cvss) as cvss, arg_max(d, row(cvss, -pos)) as d, min(pos) as pos from p group by 1, 2)
select a.scan_id, 'pkg:' || replace(a.package, ' ', '_') as finding_key, cast(cvss as double) as cvss, {SEV("cvss")} as severity, ids as cve_ids, fixes as remediation_refs, d as description,
       row_number() over (partition by a.scan_id order by pos) - 1 as ref
from a join c on a.scan_id = c.scan_id and a.package = c.package join x on a.scan_id = x.scan_id and a.package = x.package""")
def package_merge(t):
    rows = findings.build(findings.package_rows(_packages(t)))
    return rows.select(F.col("scan_id").cast("bigint").alias("scan_id"), "finding_key", "cvss", "severity", F.array_join("cve_ids", ",").alias("cve_ids"), F.array_join("remediation_refs", ",").alias("remediation_refs"), "description", F.col("ref").cast("bigint").alias("ref"))


@query(f"""with p as (select l_orderkey as scan_id, {_POS} as pos, {_PKG_SEV} as severity from lineitem),
r as (select *, row_number() over (partition by scan_id order by case severity when 'CRITICAL' then 3 when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end desc, pos) as n from p where severity <> 'LOW')
select scan_id, pos, severity from r where n <= 2""")
def top_of_source(t):
    rows = findings.kept_severities(_packages(t)).withColumn("source", F.lit("filesystem"))
    return findings.top_of_source(rows, 2).select("scan_id", "pos", "severity")


@query(f"""with {A.SEEN}, f as (select *, {SEV("cvss")} as severity from seen)
select target, scan_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low, count(*) as total from f group by 1, 2""")
def severity_counts(t):
    return findings.severity_counts(A.seen(t).withColumn("severity", scalars.severity_bucket("cvss")), ["target", "scan_id"])


@query("""with h as (select o_custkey as ip, case when o_orderkey % 11 = 0 then 'error' else 'ok' end as status, case when o_orderkey % 7 = 0 then 'error' else 'ok' end as n, case when o_orderkey % 5 = 0 then 'unavailable' else 'ok' end as f,
  row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
select ip, case when status <> 'error' then n end as network, case when status <> 'error' then f end as filesystem, case when status = 'error' then 'error' end as _sweep from h where rn = 1""")
def coverage_matrix(t):
    last = drift.recent_scans(A.scans(t)).select(F.col("target").alias("ip"), F.when(F.col("scan_id") % 11 == 0, "error").otherwise("ok").alias("status"), F.col("status").alias("scanner_status"))
    return fleet.coverage_matrix(fleet.coverage(last), ["network", "filesystem", "_sweep"])


@query(f"""with {A.SCANS}, {A.SEEN}, r as (select target, max(cvss) as worst from seen group by 1),
h as (select c_nationkey as fleet, c_custkey as ip, case when c_custkey % 13 = 0 then 'error' else 'ok' end as status, {SEV("coalesce(worst, 0)")} as risk from customer left join r on r.target = c_custkey)
select fleet, count(*) as total_hosts, count(*) filter (status = 'ok') as assessed, count(*) filter (status = 'error') as errored,
  coalesce(['low', 'medium', 'high', 'critical'][cast(max({RNK("risk")}) filter (status = 'ok') as bigint) + 1], 'unknown') as worst_risk,
  count(*) filter (status = 'ok' and risk = 'critical') as critical, count(*) filter (status = 'ok' and risk = 'low') as low from h group by 1""")
def fleet_summary(t):
    worst = A.seen(t).groupBy("target").agg(F.max("cvss").alias("worst"))
    h = t("customer").join(worst, F.col("c_custkey") == F.col("target"), "left").select(F.col("c_nationkey").alias("fleet"), F.col("c_custkey").alias("ip"), F.when(F.col("c_custkey") % 13 == 0, "error").otherwise("ok").alias("status"), scalars.severity_bucket(F.coalesce("worst", F.lit(0.0))).alias("overall_risk"))
    return fleet.summary(h, ["fleet"], with_hosts=False).select("fleet", "total_hosts", "assessed", "errored", "worst_risk", "critical", "low")


@query(f"""with {A.SEEN} select c_nationkey as fleet, target, count(*) as findings, max(cvss) as worst_cvss, grouping_id(c_nationkey, target) as level from seen join customer on target = c_custkey group by rollup (c_nationkey, target)""")
def fleet_totals(t):
    rows = A.seen(t).join(t("customer").select(F.col("c_custkey").alias("target"), F.col("c_nationkey").alias("fleet")), "target")
    return fleet.totals(rows)


@query("""select s_suppkey as ip, list_sort(list_distinct(list(l_linenumber)))::varchar as open_ports from lineitem join supplier on s_suppkey = l_suppkey where l_linestatus = 'O' group by 1""")
def open_ports(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("ip"), F.col("l_linenumber").alias("port"), F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("state"))
    return fleet.open_ports(rows, ["ip"]).select("ip", F.concat(F.lit("["), F.array_join(F.transform("open_ports", lambda x: x.cast("string")), ", "), F.lit("]")).alias("open_ports"))


# state and sinks

@query("""select p_partkey as k, case when p_partkey % 4 = 0 then p_size + 100 else p_size end as v from part where p_partkey % 2 = 0 or p_partkey % 4 <> 0""")
def upsert_latest(t):
    old = t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    new = old.where("k % 4 = 0").withColumns({"v": F.col("v") + 100, "at": F.col("k")})
    return state.upserted(old, new, ["k"], "at").select("k", "v")


@query("""select p_partkey as path, case when p_partkey % 10 = 0 then 'new' when p_partkey % 15 = 1 then 'changed' else 'same' end as state from part""")
def manifest_diff(t):
    old = t("part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("double").alias("mtime"), F.col("p_size").alias("size"), F.col("p_partkey").alias("inode"))
    new = t("part").select(F.col("p_partkey").alias("path"), F.when((F.col("p_partkey") % 15 == 1), F.col("p_size") + 1).otherwise(F.col("p_size")).cast("double").alias("mtime"), F.col("p_size").alias("size"), F.col("p_partkey").alias("inode"))
    return matching.changed_files(new, old).select("path", "state")


@query("""select doc_id as source_id, case when doc_id % 5 = 0 then 'new' when doc_id % 7 = 0 then 'changed' else 'same' end as change, sha256(coalesce(text, '') || case when doc_id % 7 = 0 then '!' else '' end) as checksum from documents""")
def checksum_upsert(t):
    docs = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    key = [F.lit("corpus").alias("corpus"), F.col("doc_id").cast("string").alias("title"), F.lit(None).cast("string").alias("platform")]
    stored = docs.where("doc_id % 5 <> 0").select(*key, F.col("doc_id").alias("source_id"), scalars.checksum("text").alias("checksum"))
    incoming = docs.select(*key, F.col("doc_id").alias("source_id"), scalars.checksum(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))).alias("checksum"))
    return state.source_changes(stored, incoming).select("source_id", "change", "checksum")


@query(f"""with {A.SCANS}, r as (select o_custkey as target, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as payload, max(o_orderdate) as completed_at from orders group by 1)
select c_custkey as target, payload, case when payload is null then 'pending' else 'ok' end as status, round(date_diff('hour', completed_at, {_NOW}) / 1.0, 1) as age_hours from customer left join r on r.target = c_custkey""")
def last_results(t):
    r = t("orders").groupBy(F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("completed_at")).agg(F.max("o_orderkey").alias("payload"))
    return state.last_results(t("customer").select(F.col("c_custkey").alias("target")), r, F.expr(_NOW)).select("target", "payload", "status", "age_hours")


@query("""with t as (select doc_id, row_number() over (order by doc_id) - 1 as n from documents where doc_id % 3 <> 0) select doc_id, 7 + n // 10 as batch_no from t""")
def batch_assign(t):
    docs = t("documents").select("doc_id")
    return state.batched(docs, docs.where("doc_id % 3 = 0"), "doc_id", 10, 7)


# retrieval and training

_TOPK = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"""select e.vec_id, round({_TOPK}, 4) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where label = 3 order by {_TOPK} desc, vec_id limit 8""")
def retrieve_topk(t):
    rows = t("embeddings").withColumns({"finding_class_hint": F.col("label"), "platform": F.lit(None).cast("string")})
    vector = t("embeddings").where("vec_id = 0").first()["embedding"]
    return retrieval.top_k(retrieval.candidates(rows, F.lit(3), "linux"), vector, 8, "vec_id").select("vec_id", "score")


@query(f"""with s as (select q.vec_id as query_id, e.vec_id, {_TOPK} as c from embeddings e, (select * from embeddings where vec_id % 100 = 0) q),
r as (select *, row_number() over (partition by query_id order by c desc, vec_id) as rank from s) select query_id, vec_id, round(c, 4) as score, rank from r where rank <= 8""")
def retrieve_batch(t):
    e = t("embeddings")
    queries_ = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.top_k_for_each(e, queries_, 8, "vec_id").withColumn("rank", F.col("rank").cast("bigint"))


_SPLIT = """with u as (select d.lang, coalesce(sha256(text), '') as unit, count(*) as n, min(doc_id) as o from documents d group by 1, 2),
w as (select *, coalesce(sum(n) over (partition by lang order by o, unit rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over (partition by lang) as total from u),
s as (select lang, unit, case when before < greatest(1, cast(round_even(total * 0.1, 0) as bigint)) then 'eval' else 'train' end as split from w),
r as (select doc_id, d.lang, split from documents d join s on d.lang is not distinct from s.lang and coalesce(sha256(d.text), '') = s.unit)
"""


def _split(t) -> DataFrame:
    return training.stratified_split(t("documents"), ["lang"], "text", 0.1, order=F.col("doc_id"))


@query(_SPLIT + "select doc_id, lang, split from r")
def train_split(t):
    return _split(t).select("doc_id", "lang", "split")


@query(_SPLIT + "select lang, count(*) filter (split = 'train') as train, count(*) filter (split = 'eval') as eval from r group by 1")
def split_report(t):
    return training.split_report(_split(t), ["lang"])


@query("""select sha256(text) as content_hash, min(doc_id) as file from documents where text is not null and doc_id % 2 = 1
and sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0 and text is not null) group by 1""")
def content_dedup(t):
    d = t("documents").where("text is not null")
    rows, _ = training.merged(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("file"), "text"), "text")
    return rows.select("content_hash", "file")


@query("""select case when quality is null then 'empty' when toxic = 1 then 'critical' when quality = 1 then 'all_good' else 'mixed' end as shape, count(*) as n from documents left join labels using (doc_id) group by 1""")
def label_shapes(t):
    tiers = F.when(F.col("quality").isNull(), F.array().cast("array<string>")).when(F.col("toxic") == 1, F.array(F.lit("critical"), F.lit("low"))).when(F.col("quality") == 1, F.array(F.lit("low"))).otherwise(F.array(F.lit("high"), F.lit("medium")))
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").groupBy(training.shape_of(tiers).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select p_brand, p_size, row_number() over (partition by p_brand order by p_size) as n from (select distinct p_brand, p_size from part)) select p_brand, p_size from r where n <= 3""")
def seeded_sample(t):
    return training.seeded_top(t("part").select("p_brand", "p_size").distinct(), ["p_brand"], F.col("p_size"), 3, order=F.col("p_size"))


@query("""with t as (select doc_id, text || case when doc_id % 3 = 0 then ' see cve-2024-' || doc_id when doc_id % 7 = 0 then ' CPE:2.3:a' else '' end as text from documents)
select doc_id, coalesce(regexp_matches(text, '(?i)CVE-\\d{4}-\\d+|cpe:2\\.3:'), false) as leak, regexp_matches(text, '(?i)licensed under') as mentions from t""")
def leak_check(t):
    """A third of the texts is given an id and a seventh a product name, as none holds one itself."""
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" see cve-2024-"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 7 == 0, " CPE:2.3:a").otherwise("")
    rows = t("documents").select("doc_id", F.concat("text", more).alias("text"))
    return rows.select("doc_id", text.leaks("text").alias("leak"), F.col("text").rlike("(?i)licensed under").alias("mentions"))


# functions over a column of each row

@query("""select s_suppkey, 'cpe:2.3:a:tpch:brand_' || (s_suppkey % 25 + 1) as base, ((s_suppkey % 60) // 10) || '.' || (s_suppkey % 10) as version,
  case when s_suppkey % 2 = 0 then 'key_' || s_suppkey else 'unknown' end as part, ((s_suppkey % 60) // 10) || '.' || (s_suppkey % 10 + 1) as next_version from supplier""")
def product_names(t):
    s = A.suppliers(t)
    return s.select("s_suppkey", versions.cpe_base("cpe").alias("base"), versions.cpe_version("cpe").alias("version"), scalars.key_part(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("\t Key  "), F.col("s_suppkey").cast("string"), F.lit("\n")))).alias("part"), versions.bumped(versions.cpe_version("cpe")).alias("next_version"))


@query("""select doc_id, case when length(text) > 400 then regexp_replace(text[1:400], ' [^ ]*$', '') else text end as short, sha256(text) as checksum from documents""")
def truncated_texts(t):
    return t("documents").select("doc_id", scalars.clean_truncate("text").alias("short"), scalars.checksum("text").alias("checksum"))


@query("""select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n, max(value) as highest from events group by 1, 2""")
def event_windows(t):
    kind, value = "event_type", "value"
    return fleet.windowed_risk(t("events"), "ts", value, [kind]).select("window_start", kind, "n", "highest")


def _report_findings(t) -> DataFrame:
    rows = _ranked(t).withColumns({"affected": F.concat(F.lit("Port "), F.col("finding_key").cast("string"), F.lit(" — http")), "description": F.lit(""), "fix_facts": F.lit(None).cast("struct<fix_summary:string,steps:array<string>,references:array<string>>")})
    rows = rows.withColumn("section", F.when(F.col("band") == "FIX NOW", "fix_now").otherwise("still_open"))
    # what reports read, written: they read it up to five times
    return written(rows.drop("terms", "priority_explanation", "escalations", "cve_ids", "started_at", "finding_key", "cvss", "score", "band"), "report-findings")


@query(_SCORE + """, x as (select target, scan_id, case when band = 'FIX NOW' then 'fix_now' else 'still_open' end as section, severity from r),
e as (select distinct target, scan_id, section from x cross join (values ('fix_now'), ('still_open')) v(s)),
sections as (select target, scan_id, unnest(['fix_now', 'still_open']) as section from (select distinct target, scan_id from x))
select s.target, s.scan_id, s.section, count(x.severity) filter (x.severity <> 'low') as issues, count(x.severity) as items from sections s left join x on s.target = x.target and s.scan_id = x.scan_id and s.section = x.section group by 1, 2, 3""")
def report_sections(t):
    rows = _report_findings(t)
    sections = rows.select("target", "scan_id").distinct().withColumn("section", F.explode(F.array(F.lit("fix_now"), F.lit("still_open"))))
    out = remediation.section_summaries(rows, sections, priority.overall_risk(rows, ["target", "scan_id", "section"]))
    return out.select("target", "scan_id", "section", "issues", "items")


@query()
def report_documents(t):
    rows = _report_findings(t)
    sections = rows.select("target", "scan_id").distinct().withColumn("section", F.explode(F.array(F.lit("fix_now"), F.lit("still_open"))))
    issues, good = remediation.report_rows(rows)
    return remediation.reports(issues, good, remediation.section_summaries(rows, sections, priority.overall_risk(rows, ["target", "scan_id", "section"])))


from . import catalog_rules as _more  # noqa: E402, F401  (registers its queries)
from . import catalog_varied as _varied  # noqa: E402, F401
from . import catalog_corpus as _corpus  # noqa: E402, F401
