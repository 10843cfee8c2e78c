"""Operators on small tables with known answers, and the properties that must hold between them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import drift, findings, fleet, hosts, matching, priority, remediation, retrieval, shared, state, training

D = [dt.datetime(2024, 1, i) for i in range(1, 10)]
OBS = "target string, scan_id bigint, finding_key string, source string, cvss double, cve_ids array<string>"
SCANS = "target string, scan_id bigint, started_at timestamp, status map<string,string>"
OK, BAD = {"network": "ok"}, {"network": "error"}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_diff_last_two(spark):
    scans = spark.createDataFrame([("t", 1, D[0], OK), ("t", 2, D[1], OK), ("one", 3, D[0], OK), ("u", 4, D[0], OK), ("u", 5, D[1], BAD)], SCANS)
    obs = spark.createDataFrame(
        [("t", 1, "gone", "network", 5.0, []), ("t", 1, "up", "network", 5.0, []), ("t", 2, "up", "network", 6.0, []), ("t", 1, "cve", "network", 5.0, ["a"]), ("t", 2, "cve", "network", 4.0, ["a", "b"]),
         ("t", 1, "same", "network", 5.0, []), ("t", 2, "same", "network", 5.0, []), ("t", 2, "new", "network", 1.0, []), ("one", 3, "x", "network", 9.0, []), ("u", 4, "hidden", "network", 9.0, [])], OBS)
    got = drift.diff_last_two(scans, obs)
    assert rows(got, "target", "finding_key", "status") == [("t", "cve", "WORSENED"), ("t", "gone", "RESOLVED"), ("t", "new", "NEW"), ("t", "up", "WORSENED"), ("u", "hidden", "UNOBSERVED")]
    assert got.where("finding_key = 'gone'").first()["severity"] is None


def test_fold_of_drift_and_state_equals_history(spark):
    """Scan after scan through compute_drift and next_state leaves the state that the windows over history give."""
    scans_rows = [("t", i + 1, D[i], BAD if i == 2 else OK) for i in range(6)]
    seen = {"a": [0, 1, 4], "b": [1, 5], "c": [0, 1, 2, 3, 4, 5]}
    obs_rows = [("t", i + 1, k, "network", 5.0 + i % 2, ["x"]) for k, at in seen.items() for i in at]
    scans, obs = spark.createDataFrame(scans_rows, SCANS), spark.createDataFrame(obs_rows, OBS)
    hist = drift.state_from_history(drift.history(scans, obs))
    st = spark.createDataFrame([], "target string, finding_key string, source string, cvss double, severity string, version string, cve_ids array<string>, first_seen timestamp, last_seen timestamp, status string, occurrences bigint, resolved_at timestamp, reappearance_count bigint, solved boolean, solved_at timestamp")
    known = spark.createDataFrame([], "target string, finding_key string, started_at timestamp, scan_id bigint, seen boolean, cvss double, severity string, cve_ids array<string>")
    for i, (_, scan_id, at, status) in enumerate(scans_rows):
        cur = spark.createDataFrame([(t, k, s, c, "medium", "1", ids) for t, sid, k, s, c, ids in obs_rows if sid == scan_id], "target string, finding_key string, source string, cvss double, severity string, version string, cve_ids array<string>")
        verdicts = drift.compute_drift(cur, st, spark.createDataFrame([("t", status)], "target string, status map<string,string>"), known, F.lit(at))
        st = state.next_state(st, cur, verdicts.where("status = 'RESOLVED'"), F.lit(at))
        st = spark.createDataFrame(st.collect(), st.schema)
        new = cur.select("target", "finding_key", F.lit(at).alias("started_at"), F.lit(scan_id).cast("bigint").alias("scan_id"), F.lit(True).alias("seen"), "cvss", "severity", "cve_ids")
        known = spark.createDataFrame(known.unionByName(new).collect(), known.schema)
        if i == 2:
            assert "UNOBSERVED" in {r["status"] for r in verdicts.collect()} and "RESOLVED" not in {r["status"] for r in verdicts.collect()}
    cols = ("finding_key", "first_seen", "last_seen", "status", "occurrences", "reappearance_count")
    assert rows(st, *cols) == rows(hist, *cols)


def test_match_versions_and_summary(spark):
    services = spark.createDataFrame([("h", 1, "cpe:2.3:a:v:p:1.5"), ("h", 2, "cpe:2.3:o:v:p:1.5"), ("h", 3, "cpe:2.3:a:v:q:1")], "target string, port int, cpe string")
    records = spark.createDataFrame([("cpe:2.3:a:v:p", "*", "1.0", "2.0", "CVE-1", 9.8, "CRITICAL", "d", ["u1", "u2", "u3"]), ("cpe:2.3:a:v:p", "1.5", None, None, "CVE-1", 9.8, "CRITICAL", "d", ["u1"]), ("cpe:2.3:a:v:p", "*", "2.0", None, "CVE-2", 5.0, "HIGH", "d", [])],
                                    "cpe_base string, vulnerable_version string, version_start_including string, version_end_including string, cve_id string, cvss_score double, severity string, description string, patch_links array<string>")
    hits = matching.match_versions(services, records)
    assert rows(hits, "port", "cve_id") == [(1, "CVE-1"), (1, "CVE-1")]
    out = matching.condensed(services, matching.useful(hits), ["target", "port"])
    assert rows(out, "port", "highest_cvss", "critical_count") == [(1, 9.8, 2), (2, 0.0, 0), (3, 0.0, 0)]
    assert out.where("port = 1").first()["remediation_links"] == ["u1", "u2"]


def test_networks(spark):
    hosts = spark.createDataFrame([("10.0.0.5",), ("10.0.1.5",), (None,), ("192.168.1.1",)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/24",), ("192.168.1.1",)], "cidr string")
    assert {(r.ip, r.in_scope) for r in matching.in_networks(hosts, nets).collect()} == {("10.0.0.5", True), ("10.0.1.5", False), (None, False), ("192.168.1.1", True)}


def test_networks_of_both_kinds(spark):
    import ipaddress

    nets = ["10.0.0.5/24", "2001:db8::/33", "fe80::1/128", "::ffff:0:0/96", "172.16.0.0/12", "bad", "10.0.0.0/40", "2001:db8:ffff::/47"]
    ips = ["10.0.0.77", "10.0.1.1", "172.31.255.255", "172.32.0.0", "2001:db8:7fff::1", "2001:db8:8000::", "2001:DB8:FFFE:1::", "fe80::1", "fe80::2", "::ffff:1.2.3.4", "::1", "::", "1::2::3", "12345::", ":1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "256.1.1.1", "", None]
    known = []
    for n in nets:
        try:
            known.append(ipaddress.ip_network(n, strict=False))
        except ValueError:
            pass

    def held(ip):
        try:
            return any(ipaddress.ip_address(ip) in n for n in known)
        except ValueError:
            return False

    got = matching.in_networks(spark.createDataFrame([(x,) for x in ips], "ip string"), spark.createDataFrame([(x,) for x in nets], "cidr string")).collect()
    assert {r["ip"]: r["in_scope"] for r in got} == {x: held(x) if x else False for x in ips}


def test_catalog_joins(spark):
    tests = spark.createDataFrame([("T-1", "-", "keep"), ("T-2", "own", "")], "test_id string, description string, solution string")
    cat = spark.createDataFrame([("T-1", "Cat", "said", "solve")], "test_id string, category string, description string, solution string")
    got = matching.enriched_tests(tests, cat, F.lit("General"))
    assert rows(got, "test_id", "category", "description", "solution") == [("T-1", "Cat", "said", "keep"), ("T-2", "General", "own", "")]
    a = spark.createDataFrame([("x", "old", "all"), ("y", "keep", "all")], "class string, fix string, applies_to string")
    g = spark.createDataFrame([("x", "new", "gen")], "class string, fix string, applies_to string")
    assert rows(matching.overlaid(a, g, "class", ["applies_to"]), "class", "fix", "applies_to") == [("x", "new", "all"), ("y", "keep", "all")]
    found, none = matching.first_profile(spark.createDataFrame([("p",), ("q",)], "product string"), spark.createDataFrame([("p", "basic"), ("p", "standard")], "product string, tier string"), ["standard", "basic"])
    assert rows(found, "product", "tier") == [("p", "standard")] and rows(none, "product") == [("q",)]
    paths = spark.createDataFrame([("/r/a/b/c/rule",), ("/r/z/rule",)], "path string")
    groups = spark.createDataFrame([("/r/a",), ("/r/a/b",)], "group_dir string")
    assert rows(matching.nearest_ancestor(paths, groups, "/r"), "path", "group_dir") == [("/r/a/b/c/rule", "/r/a/b"), ("/r/z/rule", "/r/z")]


def test_findings_builder(spark):
    none = [("default-accounts-x", "hit")]
    services = spark.createDataFrame(
        [("t", "s", "network", 0, 0, 80, "tcp", "http", "c", "1", 5.0, ["CVE-1"], "d", ["u"], []), ("t", "s", "iot_defaults", 1, 0, 80, "udp", "HTTP alt", None, None, 9.9, [], "d", [], none), ("t", "s", "network", 0, 1, None, "tcp", "x", None, None, 0.0, [], "", [], [])],
        "target string, scan_id string, source string, source_no int, pos bigint, port int, protocol string, service string, cpe string, version string, highest_cvss double, cve_ids array<string>, description string, remediation_links array<string>, script_findings array<struct<id:string,output:string>>")
    packages = spark.createDataFrame(
        [("t", "s", 0, "curl", "7", "CVE-1", "LOW", "8", "first"), ("t", "s", 1, "curl", "7", "CVE-2", "HIGH", "9", ""), ("t", "s", 2, "curl", "7", "CVE-1", "HIGH", "8", "late"), ("t", "s", 3, "curl", "8", "CVE-1", "LOW", "8", "x")],
        "target string, scan_id string, pos bigint, package string, version string, cve_id string, severity string, fixed_version string, description string")
    tests = spark.createDataFrame([("t", "s", 0, "A-1", "HIGH", "d", "do")], "target string, scan_id string, pos bigint, test_id string, severity string, description string, solution string")
    table = findings.build(findings.service_rows(services), findings.package_rows(packages), findings.audit_rows(tests))
    got = {r["finding_key"] + str(r["version"]): r for r in table.collect()}
    web = got["net:80/tcp:http1"]
    assert web["severity"] == "critical" and web["cvss"] == 5.0 and web["script_findings"][0]["id"] == "default-accounts-x"
    assert got["pkg:curl7"]["cve_ids"] == ["CVE-1", "CVE-2"] and got["pkg:curl7"]["cvss"] == 7.5 and got["pkg:curl7"]["remediation_refs"] == ["8", "9"]
    assert got["pkg:curl7"]["description"] == "first" and web["affected"] == "Port 80 — http 1"
    assert sorted(r["ref"] for r in got.values()) == list(range(5))
    one = findings.one_per_key(table)
    assert one.where("finding_key = 'pkg:curl'").count() == 1 and one.where("finding_key = 'pkg:curl'").first()["cvss"] == 7.5


def test_priority(spark):
    f = spark.createDataFrame([("t", "s", 0, "net:80/tcp:http", "network", 9.8, "critical", True), ("t", "s", 1, "web:x:http://h/p", "web", 5.0, "medium", False), ("t", "s", 2, "mal:x:y", "malware", 9.0, "critical", False), ("t", "s", 3, "audit:z", "host_audit", 3.0, "low", False)],
                              "target string, scan_id string, ref int, finding_key string, source string, cvss double, severity string, kev boolean")
    out = priority.ranked(priority.scored(f.withColumn("affected", F.lit("File: /a/b")), ["target", "scan_id"]), ["target", "scan_id"])
    got = {r["ref"]: r for r in out.collect()}
    assert got[0]["correlation_bonus"] == got[1]["correlation_bonus"] == 5.0 and got[2]["correlation_bonus"] == 0.0
    assert [got[i]["band"] for i in range(4)] == ["FIX NOW", "SOON", "FIX NOW", "WATCH"]
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4] and got[0]["rank"] == 1
    assert got[0]["priority_explanation"].startswith("FIX NOW (score ") and "Escalated: CVE in CISA KEV" in got[0]["priority_explanation"]
    assert priority.overall_risk(f, ["target"]).first()["overall_risk"] == "critical"


def test_default_credentials_of_built_findings(spark):
    """Scripts in the findings table escalate a finding and raise the overall risk, without a column of their own."""
    ddl = "target string, scan_id string, source string, source_no int, pos bigint, port int, protocol string, service string, cpe string, version string, highest_cvss double, cve_ids array<string>, description string, remediation_links array<string>, script_findings array<struct<id:string,output:string>>"
    rows_ = [("t", "s", "network", 0, 0, 80, "tcp", "http", None, None, 1.0, [], "", [], [("http-default-accounts", "admin")]), ("u", "s", "network", 0, 0, 80, "tcp", "http", None, None, 1.0, [], "", [], [("http-default-accounts", " ")])]
    table = findings.build(findings.service_rows(spark.createDataFrame(rows_, ddl)))
    out = {r["target"]: r for r in priority.scored(table, ["target", "scan_id"]).collect()}
    assert out["t"]["escalations"] == ["factory-default credentials exposed"] and out["t"]["band"] == "FIX NOW" and out["u"]["escalations"] == []
    assert rows(priority.overall_risk(table, ["target"]), "target", "overall_risk") == [("t", "critical"), ("u", "low")]


def test_open_ranking_without_a_scan(spark):
    st = spark.createDataFrame([("t", "net:80/tcp:http", "network", 5.0, "medium", "open", False), ("t", "net:81/tcp:http", "network", 9.0, "critical", "open", False), ("t", "x", "network", 9.0, "critical", "resolved", False), ("t", "y", "network", 9.0, "critical", "open", True)], "target string, finding_key string, source string, cvss double, severity string, status string, solved boolean")
    diff = spark.createDataFrame([("t", "net:80/tcp:http", "RESOLVED"), ("t", "net:81/tcp:http", "WORSENED")], "target string, finding_key string, status string")
    intel = spark.createDataFrame([("t", "net:81/tcp:http", True, 0.5)], "target string, finding_key string, kev boolean, epss_percentile double")
    got = priority.open_ranked(st, diff, intel)
    assert rows(got, "rank", "finding_key", "drift_status") == [(1, "net:81/tcp:http", "WORSENED"), (2, "net:80/tcp:http", "PERSISTING")]


def test_hosts_from_findings_to_reports(spark):
    """Two hosts in one job: one with a finding that is new and one that is gone, one on its first scan without any finding."""
    ddl = findings.SCHEMA + ", ref int"
    none = dict.fromkeys(x.strip().split(" ")[0] for x in findings.SCHEMA.replace("struct<id:string,output:string>", "s").split(","))
    row = none | {"target": "a", "scan_id": "2", "finding_key": "net:22/tcp:ssh", "source": "network", "affected": "Port 22 — ssh", "cvss": 9.5, "severity": "critical", "cve_ids": ["CVE-1"], "description": "a crash", "remediation_refs": [], "ref": 0}
    table = spark.createDataFrame([row], ddl)
    st = spark.createDataFrame([("a", "gone", "network", 5.0, "medium", [], D[0], D[0], "open", 1, 0, False)], "target string, finding_key string, source string, cvss double, severity string, cve_ids array<string>, first_seen timestamp, last_seen timestamp, status string, occurrences bigint, reappearance_count bigint, solved boolean")
    scans = spark.createDataFrame([("a", "2", OK, D[0]), ("b", "9", OK, None)], "target string, scan_id string, status map<string,string>, previous_at timestamp")
    past = spark.createDataFrame([], "target string, finding_key string, started_at timestamp, scan_id string, seen boolean, cvss double, severity string, cve_ids array<string>")
    kev = spark.createDataFrame([("CVE-1",)], "cve_id string")
    epss = spark.createDataFrame([("CVE-1", 0.5, 0.9)], "cve_id string, score double, percentile double")
    ranked, verdicts = hosts.ranked_hosts(table, scans, st, past, kev, epss, F.lit(D[1]))
    cat = spark.createDataFrame([("crash", "Update {service}.", [("Stop {service}", None)], "authored")], remediation.CATALOG)
    got = {r["target"]: json.loads(r["report"]) for r in hosts.host_reports(ranked, verdicts, scans, st, cat, F.lit("linux")).collect()}
    assert got["a"]["drift_header"] == "Since your last scan on Jan 1: 1 new, 1 resolved." and [x["finding_key"] for x in got["a"]["resolved"]["findings"]] == ["gone"] and got["a"]["resolved"]["good_news"] == ["gone: no longer found."]
    issue = got["a"]["fix_now"]["findings"][0]
    assert issue["drift_status"] == "NEW" and issue["drift_marker"] == "\U0001f195 NEW" and issue["how_to_fix"] == "1. Stop ssh" and got["a"]["fix_now"]["overall_risk"] == "critical"
    assert got["b"]["drift_header"] == "" and got["b"]["resolved"] == {"count": 0, "good_news": [], "findings": []} and got["b"]["fix_now"]["overall_risk"] == "low"
    raw = spark.createDataFrame([("a", None, None, None), ("b", "error", "timeout", None), ("c", None, None, "{")], "target string, status string, error string, _corrupt_record string")
    assert rows(hosts.failed_hosts(raw), "target", "status", "error") == [("a", "ok", None), ("b", "error", "timeout"), ("c", "error", "unreadable: {")]


FLEET = [("a", "ok", {"network": "ok", "host_audit": "not_assessed"}, "high"), ("b", "error", None, None), ("c", "ok", {"network": "ok"}, None)]


def test_fleet(spark):
    """A host in error is never counted as clean, and what was not assessed stays visible."""
    hosts = spark.createDataFrame([(1, *r) for r in FLEET] + [(2, "d", "error", None, None)], "fleet int, ip string, status string, scanner_status map<string,string>, overall_risk string")
    s = {r["fleet"]: r for r in fleet.summary(hosts, ["fleet"]).collect()}
    assert (s[1]["total_hosts"], s[1]["assessed"], s[1]["errored"], s[1]["worst_risk"]) == (3, 2, 1, "high") and s[1]["low_hosts"] == ["c"] and s[2]["worst_risk"] == "unknown"
    assert rows(fleet.coverage(hosts.where("fleet = 1")), "ip", "scanner", "status") == [("a", "host_audit", "not_assessed"), ("a", "network", "ok"), ("b", "_sweep", "error"), ("c", "network", "ok")]
    tracks = spark.createDataFrame([("a", "network", "ok")], "ip string, source string, status string")
    assert rows(fleet.host_results(hosts.where("ip = 'a'"), tracks), "source", "status") == [("filesystem", "not_assessed"), ("host_audit", "not_assessed"), ("malware", "not_assessed"), ("network", "ok")]


def test_fix_facts_and_report(spark):
    catalog = spark.createDataFrame([("crash", "Update {service}.", [("Stop {service}", {"linux_apt": "systemctl restart {service}"}), ("Use {fixed_version}", None)], "authored")], remediation.CATALOG)
    f = spark.createDataFrame([("t", "s", 0, "network", "Port 22 — ssh", "denial of service", ["http://x", "http://y", "http://z"], "high", "linux"), ("t", "s", 1, "filesystem", "Package: curl 7", "", ["8.0"], "low", "linux"), ("t", "s", 2, "host_audit", "x", "", [], "medium", "linux")],
                              "target string, scan_id string, ref int, source string, affected string, description string, remediation_refs array<string>, severity string, platform string").withColumn("script_findings", F.lit(None).cast("array<struct<id:string,output:string>>"))
    out = remediation.with_fix_facts(f, catalog)
    got = {r["ref"]: r["fix_facts"] for r in out.collect()}
    assert got[0]["steps"] == ["Stop ssh\n    $ systemctl restart ssh"] and got[0]["references"] == ["http://x", "http://y"] and got[0]["fix_summary"] == "Update ssh."
    assert got[1]["category"] == "network_client" and got[1]["fix_summary"] == "Update curl to version 8.0 or later." and got[2] is None
    issues, good = remediation.report_rows(out)
    assert rows(good, "good_news") == [("Package: curl 7: nothing of note was found.",)]
    fixes = dict(rows(issues, "ref", "how_to_fix"))
    assert fixes[0].startswith("1. Stop ssh") and fixes[2] == remediation.WORDING["generic_fix"]
    own, _ = remediation.report_rows(out, remediation.WORDING | {"title": "Look at {affected}", "why": "w"})
    assert dict(rows(own, "ref", "title"))[0] == "Look at Port 22 — ssh"


@pytest.mark.parametrize("elevated,hint", [(True, "could not be determined"), (False, "could not be determined — re-run the audit as Administrator")])
def test_windows_rules(spark, elevated, hint):
    ddl = "file string, defender_realtime boolean, firewall_domain boolean, firewall_private boolean, firewall_public boolean, smb1 boolean, rdp_deny int, rdp_nla int, uac int, bitlocker string, au_option int, days_since_update int, guest_enabled boolean, exec_policy string, elevated boolean"
    secure = ("s", True, True, True, True, False, 1, None, 1, "On", 4, 3, False, "RemoteSigned", elevated)
    bad = ("b", False, True, True, False, True, 0, None, 0, "Off", 1, 31, True, "Bypass", elevated)
    empty = ("e", *[None] * 13, elevated)
    got = remediation.windows_findings(spark.createDataFrame([secure, bad, empty], ddl)).collect()
    by = {f: [(r["test_id"], r["severity"], r["extra"]) for r in got if r["file"] == f] for f in "sbe"}
    assert by["s"] == [] and len(by["b"]) == 11 and ("RDP-NLA", "HIGH", None) in by["b"] and ("WU-STALE", "MEDIUM", "last update 31 days ago") in by["b"]
    assert [(x[1], x[2]) for x in by["e"]] == [("MEDIUM", hint)] * 6


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 0)], "k string, v int")
    new = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), (None, 9, 1)], "k string, v int, at int")
    assert {tuple(r) for r in state.upserted(old, new, ["k"], "at").collect()} == {("a", 6), ("b", 2), (None, 9)}
    ten = spark.createDataFrame([("a", 5, 9), ("a", 6, 10)], "k string, v int, at int")
    assert {tuple(r) for r in state.upserted(old, ten, ["k"], "at").collect()} == {("a", 6), ("b", 2), (None, 0)}
    assert {tuple(r) for r in state.replaced(old, ten, ["k"], "at").collect()} == {("a", 6), ("b", 2), (None, 0)}
    assert {tuple(r) for r in state.upserted(old, ten.withColumn("v", F.lit(9)), ["k"], "at", stable=["v"]).collect()} == {("a", 1), ("b", 2), (None, 0)}
    assert {tuple(r) for r in state.replaced(old, spark.createDataFrame([(None, 7), (None, 5)], "k string, v int"), ["k"], "v").collect()} == {("a", 1), ("b", 2), (None, 7)}
    store = state.Versioned(spark, str(tmp_path / "m"), "k string, v int")
    assert store.read().count() == 0 and store.write(old) == 1
    assert store.write(store.read().where("k = 'a'"), tag="b-7") == 2 and store.read().count() == 1 and store.tag() == "b-7"
    other = state.Versioned(spark, str(tmp_path / "m"), "k string, v int")
    other.version = lambda: 1  # looked before the other one published
    with pytest.raises(Exception):
        other.write(old)
    assert store.read().count() == 1 and store.version() == 2
    scans = spark.createDataFrame([("t", 1, D[0]), ("t", 2, D[1])], "target string, scan_id bigint, started_at timestamp")
    for _ in range(2):
        state.append_scans(scans, str(tmp_path / "obs"), F.to_date("started_at"))
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 2


def test_running_sums(spark):
    """Groups of one key and of a null key, equal orders, and repeats."""
    data = [(g, o, v) for g in ("a", None) for o in (1, 1, 2, 3, 3, 3) for v in (1, 2)]
    got = shared.with_running_sum(spark.createDataFrame(data * 5, "g string, o int, v int"), ["g"], ["o"], "v", "s").collect()
    for g in ("a", None):
        own = sorted((r["o"], r["s"], r["v"]) for r in got if r["g"] == g)
        assert len(own) == 60 and {r["s_total"] for r in got if r["g"] == g} == {90}
        at = 0
        for _, s, v in sorted(own, key=lambda x: x[1]):
            assert s == at
            at += v
        assert [o for o, _, _ in sorted(own, key=lambda x: x[1])] == sorted(o for o, _, _ in own)


def test_numbers_in_order(spark):
    ids = spark.range(0, 1000, 3).withColumnRenamed("id", "k").repartition(7)
    assert rows(state.numbered_in_order(ids, "k", "n"), "k", "n") == [(3 * i, i) for i in range(334)]


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], None), (3, None, None), (4, [1.0, 0.0], "b")], "chunk_id bigint, embedding array<float>, platform string")
    cands = retrieval.candidates(chunks, None, "a")
    assert rows(retrieval.top_k(cands, [1.0, 0.0], 2), "chunk_id", "score") == [(1, 1.0), (2, 0.0)]
    q = spark.createDataFrame([(7, [0.0, 2.0]), (8, [0.0, 0.0])], "query_id bigint, query_vector array<float>")
    assert rows(retrieval.top_k_for_each(chunks, q, 1), "query_id", "chunk_id", "score") == [(7, 2, 1.0), (8, 1, 0.0)]
    out, record = retrieval.embedded(chunks, spark.createDataFrame([(3, [1.0, 2.0]), (4, [1.0])], "chunk_id bigint, embedding array<float>"), "m")
    assert record.first()["failed"] == 1 and out.where("chunk_id = 3").first()["embedding"] == [1.0, 2.0]


def test_ingest_skips_unchanged_pages(spark):
    page = lambda n, x: (n, "c", f"t{n}", None, f"<p>{x * 50}</p><script>no</script>")
    ddl = "source_id bigint, corpus string, title string, platform string, html string"
    first = retrieval.page_sources(spark.createDataFrame([page(1, "a"), page(2, "b")], ddl))
    stored = first.select("corpus", "title", "platform", "source_id", "checksum")
    kept = retrieval.chunks(first, ["source_id"])
    again = retrieval.page_sources(spark.createDataFrame([page(1, "a"), page(2, "c"), page(3, "d")], ddl))
    changes, after = retrieval.ingested(stored, kept, again, [])
    assert rows(changes, "source_id", "change") == [(1, "same"), (2, "changed"), (3, "new")]
    assert rows(after, "source_id", "chunk") == [(1, "a" * 50), (2, "c" * 50), (3, "d" * 50)]
    found, none = spark.createDataFrame([("p", "standard"), ("q", "basic")], "product string, tier string"), spark.createDataFrame([("z",)], "product string")
    chosen = retrieval.profile_contributors(spark.createDataFrame([("r1", "p", "standard"), ("r1", "q", "basic"), ("r2", "p", "standard")], "rule_id string, product string, tier string"))
    got = json.loads(retrieval.selection_manifest(found, none, chosen).first()["value"])
    assert got == {"used": [{"product": "p", "tier": "standard"}, {"product": "q", "tier": "basic"}], "skipped": ["z"], "contributors": [{"product": "p", "tier": "standard", "rules": 2}, {"product": "q", "tier": "basic", "rules": 1}]}
    assert rows(retrieval.ignored_groups(spark.createDataFrame([("a",), ("b",), ("b",)], "group_id string"), spark.createDataFrame([("a",)], "group_id string")), "group_id", "n") == [("b", 2)]
    vectors = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    assert [r[0] for r in vectors.select(retrieval.floats_of_blob(retrieval.blob_of_floats(F.col("v")))).collect()] == [[1.0, -2.5], None]


def test_export_gate(spark):
    entries = spark.createDataFrame([(1, "FIREWALL-PROFILE"), (2, "crash"), (3, "rce"), (4, "nowhere"), (5, "UAC")], "entry_id int, finding_class string")
    reviews = spark.createDataFrame([(1, 1, "approved"), (2, 2, "approved"), (3, 3, "approved"), (4, 3, "rejected"), (5, 4, "approved"), (6, 5, "approved")], "review_id int, entry_id int, decision string")
    steps = spark.createDataFrame([(10, 2), (11, 5)], "step_id int, entry_id int")
    commands = spark.createDataFrame([(10, 1), (11, None)], "step_id int, ast_validated int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = retrieval.export_gate(entries, reviews, steps, commands, keys("UAC", "FIREWALL-DOMAIN"), keys("crash", "rce"), spark.createDataFrame([(2,)], "entry_id int"))
    assert {(r["key"], r["route"], r["provenance"]) for r in got.collect()} == {
        ("FIREWALL-DOMAIN", "windows", None), ("FIREWALL-PRIVATE", "windows", None), ("FIREWALL-PUBLIC", "windows", None),
        ("crash", "catalog", "verified:citation"), ("rce", "skipped", None), ("nowhere", "skipped", None), ("UAC", "skipped", None),
    }


def test_split_keeps_content_together(spark):
    data = [(i, "g" if i % 3 else "h", f"text {i % 40}") for i in range(200)]
    df = spark.createDataFrame(data, "id int, grp string, content string")
    out = training.stratified_split(df, ["grp"], "content", 0.1).collect()
    assert len(out) == 200
    sides = {}
    for r in out:
        assert sides.setdefault((r["grp"], r["content"]), r["split"]) == r["split"]
    for g, n in (("g", 133), ("h", 67)):
        assert sum(r["split"] == "eval" for r in out if r["grp"] == g) >= max(1, round(n * 0.1))


def test_training_rows(spark):
    store = spark.createDataFrame([("a",)], "ordered_facts string")
    new = spark.createDataFrame([("f2", "b"), ("f1", "b"), ("f3", "a")], "file string, ordered_facts string")
    kept, counts = training.merged(store, new)
    assert rows(kept, "file", "status") == [("f1", "pending")] and tuple(counts.first()) == (1, 2)
    old = spark.createDataFrame([('[{"a":"1"}]', "labeled"), ('[{"fix_facts":"1"}]', "labeled"), ("[]", "labeled")], "ordered_facts string, status string")
    assert [r["status"] for r in training.superseded(old).collect()] == ["superseded", "labeled", "labeled"]
    tiers = spark.createDataFrame([([],), (["low"],), (["low", "critical"],), (["high", "low"],)], "t array<string>")
    assert [r[0] for r in tiers.select(training.shape_of(F.col("t"))).collect()] == ["empty", "all_good", "critical", "mixed"]
    outputs = spark.createDataFrame([(1, '```json\n{"summary": "ok", "findings": [{"references": ["CVE-2024-1"]}]}\n```'), (2, '{"summary": "CVE-2024-1"}'), (3, "junk"), (4, '{"summary": "x"}')], "index int, raw_output string")
    got = training.scored_outputs(outputs, None, spark.createDataFrame([(4,)], "index int"))
    assert rows(got, "index", "parsed", "text_ok", "severities_ok", "passed") == [(1, True, True, True, True), (2, True, False, True, False), (3, False, False, False, False), (4, True, True, False, False)]
    t = training.score_totals(got).first()
    assert (t["total"], t["pass_rate"], t["parse_failures"], t["text_failures"], t["severity_failures"]) == (4, 0.25, 1, 1, 1)
    chat = training.chat_records(spark.createDataFrame([("validated", "u", "l"), ("pending", "u", "l")], "status string, ordered_facts string, label string"), "sys").collect()
    assert len(chat) == 1 and [m["role"] for m in json.loads(chat[0]["value"])["messages"]] == ["system", "user", "assistant"]


def test_batch_files_and_json_lines(spark, tmp_path):
    batches = spark.createDataFrame([(1, 3), (2, 3), (3, 4)], "id int, batch_no int")
    state.batch_files(batches.where("batch_no = 3"), str(tmp_path / "b"))
    state.batch_files(batches.where("batch_no = 4"), str(tmp_path / "b"))
    state.batch_files(batches.where("batch_no = 3"), str(tmp_path / "b"))  # once more
    assert rows(spark.read.json(str(tmp_path / "b")), "batch_no", "id") == [(3, 1), (3, 2), (4, 3)]
    state.write_json_lines(batches, str(tmp_path / "l"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"id":1,"batch_no":3}', '{"id":2,"batch_no":3}', '{"id":3,"batch_no":4}']


def test_observations_keep_their_scans_time(spark):
    scans = spark.createDataFrame([("t", 1, D[0])], "target string, scan_id bigint, started_at timestamp")
    obs = spark.createDataFrame([("t", 1, "a"), ("t", 1, "b"), ("t", 2, "a")], "target string, scan_id bigint, finding_key string")
    assert rows(drift.observations_of(scans, obs), "finding_key", "started_at") == [("a", D[0]), ("b", D[0])]
    assert rows(drift.observations_of(scans, obs, "b"), "finding_key") == [("b",)]


def test_views_for_readers_and_sources_of_hits(spark):
    table = spark.createDataFrame([("t", "s", 0, "k", "NEW", 3, D[0], 1, "x")], "target string, scan_id string, ref int, finding_key string, drift_status string, age_days int, first_seen timestamp, reappearance_count int, affected string")
    assert findings.reader_view(table).columns == ["target", "scan_id", "affected"]
    hits = spark.createDataFrame([(1, "s1", 0.5), (2, "zz", 0.4)], "chunk_id int, source_id string, score double")
    assert rows(retrieval.with_sources(hits, spark.createDataFrame([("s1", "u")], "source_id string, url string")), "chunk_id", "url") == [(1, "u")]
    chunks = spark.createDataFrame([(1, [1.0]), (2, None)], "chunk_id int, embedding array<double>")
    assert retrieval.pending(chunks).count() == 1 and retrieval.pending(chunks, force=True).count() == 2
    picks = spark.createDataFrame([("p", "r1", False), ("p", "r1", False), ("p", "r2", False), ("p", "r2", True)], "product string, rule_id string, excluded boolean")
    assert rows(retrieval.selected_rules(picks), "product", "rule_id") == [("p", "r1")]
    todo = spark.createDataFrame([(2, "pending", "real"), (1, "pending", "real"), (3, "pending", "synth"), (4, "done", "real")], "id int, status string, source string")
    assert [r["id"] for r in training.pending_rows(todo, "synth", 1).collect()] == [1]
    changed = spark.createDataFrame([(1, "same"), (2, "changed")], "source_id int, change string")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "source_id int, chunk string")
    assert rows(state.replaced_chunks(old, changed, old.where("source_id = 2").withColumn("chunk", F.lit("c"))), "source_id", "chunk") == [(1, "a"), (2, "c")]


def test_change_intervals_unfold_to_history(spark):
    import datetime as dt
    import random

    rng = random.Random(7)
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    scan_rows = [(t, i, at(i // 2), {"network": rng.choice(["ok", "error"]), "filesystem": rng.choice(["ok", "ok", "error"])}) for t in "ab" for i in range(14)]
    seen = [(t, i, k, rng.choice(["network", "filesystem"]) if k == "z" else ("network", "filesystem", "odd")[ord(k) % 3], float(rng.choice([5, 5, 7]))) for t in "ab" for i in range(14) for k in "uvwxyz" if rng.random() < 0.4]
    seen += [("a", 0, "once", "network", None), ("a", 3, "always", "network", 1.0)] + [("a", i, "always", "network", 1.0) for i in range(4, 14)]
    scans = spark.createDataFrame(scan_rows, "target string, scan_id bigint, started_at timestamp, status map<string,string>")
    obs = spark.createDataFrame(seen, "target string, scan_id bigint, finding_key string, source string, cvss double")
    intervals = drift.change_intervals(scans, obs)
    names = ("target", "finding_key", "scan_id", "started_at", "seen", "cvss", "verdict", "state")
    assert sorted(map(str, rows(drift.unfolded(intervals, scans), *names))) == sorted(map(str, rows(drift.history(scans, obs), *names)))
    got = [r for r in intervals.where("finding_key = 'always'").collect()]
    assert [(r["state"], r["from_scan"], r["to_scan"], r["verdict"]) for r in got] == [("open", 3, None, "NEW")]
    # no two neighbouring intervals say the same
    key = lambda r: (r["target"], r["finding_key"], r["valid_from"], r["from_scan"])
    every = sorted(intervals.collect(), key=key)
    for a, b in zip(every, every[1:]):
        if (a["target"], a["finding_key"]) == (b["target"], b["finding_key"]):
            assert (a["valid_to"], a["to_scan"]) == (b["valid_from"], b["from_scan"])
            assert (a["state"], a["seen"], a["cvss"], a["source"]) != (b["state"], b["seen"], b["cvss"], b["source"])
        else:
            assert a["to_scan"] is None


def test_hot_products_meet_by_blocks(spark):
    services = spark.createDataFrame([(i, f"cpe:2.3:a:v:p:{i // 30}.{i % 30}.{i % 4}") for i in range(600)] + [(900, "cpe:2.3:a:v:p:*"), (901, "cpe:2.3:a:v:p:beta-1"), (902, "cpe:2.3:o:v:p:1.0")], "id bigint, cpe string")
    ranges = [("*", f"{i % 20}.{i}", f"{i % 20}.{i + 2}.1") for i in range(28)] * 12 + [("*", "3.4", None), ("*", None, "1.2"), ("2.5", None, None), ("2", None, None), ("beta", None, None), ("*", "odd", "2.0"), ("", None, None)]
    records = spark.createDataFrame([("cpe:2.3:a:v:p", *r, f"CVE-{i}") for i, r in enumerate(ranges)], "cpe_base string, vulnerable_version string, version_start_including string, version_end_including string, cve_id string")
    whole, cut = matching.match_versions(services, records), matching.match_versions_by_block(services, records)
    assert whole.columns == cut.columns and rows(whole, "id", "cve_id") == rows(cut, "id", "cve_id") and whole.count() > 900
    before, after = services.where("id < 902").count() * records.count(), matching.block_candidates(services, records).count()
    assert after < whole.count() * 3 and after * 80 < before, (before, after, whole.count())


def test_any_number_of_queries_in_one_scan(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + rng.normal(size=8) * 0.05).tolist()) for i in range(900)] + [(2000 + i, v) for i, v in enumerate([[0.0] * 8, None, [1.0, 2.0]])] + [(3000 + i, [1.0] * 8) for i in range(12)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "v"))
    data = spark.read.parquet(str(tmp_path / "v"))
    asked = [(i, rng.normal(size=8).tolist()) for i in range(5000)] + [(9000, [0.0] * 8), (9001, None), (9002, [1.0] * 8), (9003, [1.0])]
    queries = spark.createDataFrame(asked, "query_id bigint, query_vector array<double>")
    x = np.array([[*(v or []), *[0.0] * (8 - len(v or []))] for _, v in vectors if v is not None])
    ids = np.array([i for i, v in vectors if v is not None])
    q = np.array([[*(v or []), *[0.0] * (8 - len(v or []))] for _, v in asked])
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
    score = np.round(np.divide(q @ x.T, norm, out=np.zeros((len(q), len(x))), where=norm > 0), 12) + 0.0
    want = {(asked[i][0], rank + 1): int(ids[j]) for i in range(len(asked)) for rank, j in enumerate(np.lexsort((ids, -score[i]))[:3])}
    for most in (retrieval.QUERY_BYTES, 5000 * 8 * 8 // 3):
        out = retrieval.top_k_for_each(data, queries, 3, "vec_id", most)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1, plan
        assert {(r["query_id"], r["rank"]): r["vec_id"] for r in out.collect()} == want


def test_hosts_from_raw_rows_to_stored_state_and_reports(spark, tmp_path):
    """Two nights of three hosts: rows of four scanners become findings, verdicts, state and reports; a host that failed and a repeated night change nothing."""
    from scanloom.operators.state import Versioned

    stored, folder = Versioned(spark, str(tmp_path / "state"), hosts.STATE), str(tmp_path / "hosts")
    kev, epss = spark.createDataFrame([("CVE-1",)], "cve_id string"), spark.createDataFrame([("CVE-1", 0.5, 0.9)], "cve_id string, score double, percentile double")
    cat = spark.createDataFrame([("crash", "Update {service}.", [("Stop {service}", {"linux_apt": "systemctl stop {service}"})], "authored")], remediation.CATALOG)
    service = "target string, scan_id string, source string, source_no int, pos int, port int, protocol string, service string, cpe string, version string, highest_cvss double, cve_ids array<string>, description string, remediation_links array<string>, script_findings array<struct<id:string,output:string>>"
    package = "target string, scan_id string, pos int, package string, version string, cve_id string, severity string, fixed_version string, description string"
    audit = "target string, scan_id string, pos int, test_id string, severity string, description string, solution string"
    malware = "target string, scan_id string, pos int, path string, sha256 string, signature string, severity string, engine string"
    ssh = lambda t, n, score=9.5: (t, n, "network", 0, 0, 22, "tcp", "ssh", None, "1", score, ["CVE-1"], "a crash", [], [])
    ok = {"network": "ok", "filesystem": "ok", "host_audit": "ok", "malware": "ok"}

    def night(n, at, services, packages, tests, hits, status):
        sources = {"services": spark.createDataFrame(services, service), "packages": spark.createDataFrame(packages, package), "audit": spark.createDataFrame(tests, audit), "malware": spark.createDataFrame(hits, malware)}
        scans = spark.createDataFrame([(t, n, at, s) for t, s in status.items()], "target string, scan_id string, started_at timestamp, status map<string,string>")
        out = hosts.process_hosts(sources, scans, stored, folder, kev, epss, cat, F.lit("linux"), f"night-{n}")
        return {r["target"]: json.loads(r["report"]) for r in out.collect()}

    curl, test, worm = ("a", "1", 0, "curl", "7", "CVE-2", "HIGH", "8.0", "old"), ("b", "1", 0, "SSH-1", "MEDIUM", "weak", "do it"), ("a", "1", 0, "/x", None, "Win.Worm", "HIGH", None)
    first = night("1", D[0], [ssh("a", "1"), ssh("broken", "1")], [curl, curl], [test], [worm], {"a": ok, "b": ok, "c": ok})
    assert set(first) == {"a", "b", "c"} and first["a"]["drift_header"] == "" and first["c"]["fix_now"]["overall_risk"] == "low" 
    assert {x["source"] for part in ("fix_now", "still_open") for x in first["a"][part]["findings"]} == {"network", "filesystem", "malware"}
    known = {(r["target"], r["finding_key"]): r for r in stored.read().collect()}
    assert len(known) == 4 and all(r["status"] == "open" and r["occurrences"] == 1 and r["first_seen"] == D[0] for r in known.values()) and known["a", "pkg:curl"]["affected"] == "Package: curl 7"
    second = night("2", D[3], [ssh("a", "2")], [], [("b", "2", 0, "SSH-1", "HIGH", "weak", "do it")], [], {"a": {**ok, "malware": "error"}, "b": ok})
    assert second["a"]["drift_header"] == "Since your last scan on Jan 1: 1 resolved." and second["a"]["resolved"]["good_news"] == ["Package: curl 7: no longer found."]
    open_ssh = [x for part in ("fix_now", "still_open") for x in second["a"][part]["findings"]]
    assert [(x["drift_status"], x["drift_marker"], x["how_to_fix"]) for x in open_ssh] == [("PERSISTING", "\u23f3 OPEN 3 DAYS", "1. Stop ssh\n    $ systemctl stop ssh")]
    assert [x["drift_marker"] for part in ("fix_now", "still_open") for x in second["b"][part]["findings"]] == ["\u26a0\ufe0f WORSENED"]
    after = {(r["target"], r["finding_key"]): (r["status"], r["occurrences"]) for r in stored.read().collect()}
    assert after["a", "pkg:curl"] == ("resolved", 1) and after["a", "net:22/tcp:ssh"] == ("open", 2) and [v for k, v in after.items() if k[1].startswith("mal:")] == [("open", 1)]
    seen = spark.read.parquet(f"{folder}/observations").groupBy("scan_id", "seen").count().collect()
    assert {(str(r["scan_id"]), r["seen"]): r["count"] for r in seen} == {("1", True): 4, ("2", True): 2, ("2", False): 2}
    version = stored.version()
    assert night("2", D[3], [], [], [], [], {"a": ok}) == second and stored.version() == version


def test_page_queries_equal_sql_on_cut_entities(spark, tmp_path):
    """Titles that are cut within an entity, and bare ones in the text."""
    import duckdb

    from scanloom.plans import catalog

    body = "a paragraph of more than forty characters &amp; one more &copy; sign"
    rows = [(i, f"http://h/{i}", f"<title>{body} ver&amp</title><p>{body} &copy {body}</p>") for i in range(1, 8)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("page_texts", "page_ingest"):
        got = catalog.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({catalog.oracle_sql()[name]})").fetchall())


def _hot_product(spark, n=600):
    services = spark.createDataFrame([(i, "cpe:2.3:a:v:p:1.5") for i in range(n)] + [(n, None), (n + 1, "cpe:2.3:a:v:p: 1.5")], "id bigint, cpe string")
    records = spark.createDataFrame([("cpe:2.3:a:v:p", None, "1.0", "2.0", f"CVE-{i}") for i in range(n)] + [("cpe:2.3:a:v:p", "1.5", "9", None, "CVE-x")], "cpe_base string, vulnerable_version string, version_start_including string, version_end_including string, cve_id string")
    return services, records


@pytest.mark.parametrize("match", [matching.match_versions, matching.match_versions_by_block])
def test_one_hot_range_is_dealt_to_all_tasks(spark, monkeypatch, match):
    """One version and one range with many rows a side: each pair once, and no task makes most of them."""
    monkeypatch.setattr(matching, "CELL", 64)
    services, records = _hot_product(spark)
    hits = match(services, records)
    assert hits.columns == ["cpe_base", "id", "cpe", "vulnerable_version", "version_start_including", "version_end_including", "cve_id"]
    n = {r["at"]: r["count"] for r in hits.groupBy(F.spark_partition_id().alias("at")).count().collect()}
    assert sum(n.values()) == 600 * 601 == hits.select("id", "cve_id").distinct().count() and max(n.values()) < 0.6 * 600 * 601, n


def test_versions_and_ranges_are_compared_once(spark):
    services, records = (x.unionByName(x) for x in _hot_product(spark, 40))
    met = matching._met(matching._versioned(services, False), matching._ranged(records)).collect()
    assert sorted((r["_exact"], r["_low"], r["_text"], r["_services"], r["_records"]) for r in met) == [("", "1.0", "1.5", 80, 80), ("1.5", "9", "1.5", 80, 2)]


@pytest.mark.parametrize("keep", [True, False])
def test_records_condensed_by_range_equal_matches_condensed(spark, keep):
    """Repeated services, keys with several products, equal scores and repeated records."""
    services = spark.createDataFrame([(i % 37, f"cpe:2.3:{'ao'[i % 5 == 0]}:v:p{i % 3}:{i % 4}.{i % 6}") for i in range(120)] + [(900, "cpe:2.3:a:v:none:1"), (901, None)], "id bigint, cpe string")
    one = [(f"cpe:2.3:{'ao'[i % 7 == 0]}:v:p{i % 3}", "*", f"{i % 3}.{i % 5}", None if i % 6 == 0 else f"{i % 4}.{i % 7}", f"CVE-{i % 50}", float(i % 11), ("CRITICAL", "HIGH", "LOW", "UNKNOWN")[i % 4], None if i % 9 == 0 else [f"u{i % 8}", "w", f"z{i % 5}"]) for i in range(160)]
    records = spark.createDataFrame(one + one[:40], "cpe_base string, vulnerable_version string, version_start_including string, version_end_including string, cve_id string, cvss_score double, severity string, patch_links array<string>")
    want = matching.condensed(services, matching.useful(matching.match_versions(services, records, True)), ["id"], keep_unmatched=keep)
    got = matching.condensed_records(services, records, ["id"], keep_unmatched=keep, allow_non_app=True)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("highest_cvss > 0").count() > 50


def test_lines_are_grouped_before_they_meet_orders(spark, tmp_path):
    """Orders that stand twice count once, lines without a part or order are kept out; no join is below the lines' grouping."""
    from scanloom.plans import adapters

    tables = {
        "orders": spark.createDataFrame([(1, 7, D[0]), (1, 7, D[0]), (2, 8, D[1])], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame([(1, 10, 4, 30.0), (1, 9, 8, 50.0), (1, None, 4, 1.0), (2, 5, 1, 1.0), (3, 5, 1, 1.0), (None, 5, 1, 1.0)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double"),
    }
    out = adapters.seen(tables.get)
    assert rows(out, "target", "scan_id", "finding_key", "source", "cvss", "cve_ids") == [(7, 1, 0, "network", 10.0, ["CVE-10", "CVE-9"]), (8, 2, 1, "filesystem", 0.0, ["CVE-5"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("collect_set")


def test_what_fix_facts_are_filled_with_is_worked_out_once(spark, tmp_path):
    """A row's port is read from its text in few places of the plan, and the query's rows are dealt to all tasks."""
    from pyspark.sql import functions as F

    from scanloom.operators import remediation
    from scanloom.plans import catalog

    catalog_rows = spark.createDataFrame([("crash", "Update {service}.", [("Restart {service} on {port}", {"linux_apt": "apt install {package}"})], "authored")], remediation.CATALOG)
    found = "target bigint, source string, affected string, description string, remediation_refs array<string>, script_findings array<struct<id:string,output:string>>, platform string"
    out = remediation.with_fix_facts(spark.createDataFrame([(1, "network", "Port 22 — SSH", "a crash", ["8.1"], None, "Linux"), (2, "network", "Port 1 — zzz", "a crash", None, None, "Linux")], found), catalog_rows)
    assert rows(out.select("target", F.col("fix_facts.fix_summary").alias("s"), F.col("fix_facts.steps").alias("steps")), "target", "s", "steps") == [
        (1, "Update SSH.", ["Restart SSH on 22\n    $ apt install openssh-server"]), (2, "Update zzz.", ["Restart zzz on 1"])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Port\\s+") <= 4
    spark.createDataFrame([(k, "a b", k % 50) for k in range(40)], "p_partkey bigint, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in range(5)], "r_regionkey int").write.parquet(f"{tmp_path}/region.parquet")
    assert len({x[0] for x in catalog.queries()["fix_facts"](spark, str(tmp_path)).select(F.spark_partition_id()).collect()}) > 1


def test_assets_are_read_once_and_bands_told_in_one_pass(spark):
    """The text of an asset is read below the window only; the query scores its rows once, as split_by_band divides them."""
    from scanloom.operators import priority
    from scanloom.plans import catalog, catalog_rules  # noqa: F401  (catalog comes first)

    line = spark.createDataFrame([(k // 4, k * 5 % 39, k % 6, k % 4, float(k % 50)) for k in range(400)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double")
    scored = priority.scored(catalog_rules._found({"lineitem": line}.get), ["target", "scan_id"])
    above = scored._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert "^net:" not in above and scored.where("correlation_bonus > 0").count() > 50 and "_asset" not in scored.columns
    out = catalog_rules.priority_terms({"lineitem": line}.get)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    first, rest = priority.split_by_band(scored)
    key = lambda df: rows(df, "target", "ref")
    assert key(out.where("fix_now")) == key(first) and key(out.where("not fix_now")) == key(rest) and first.count() and rest.count()


def test_the_state_before_the_last_scan_is_made_once(spark):
    """Verdicts read the state twice and the observations split at each target's last scan, without working either out again."""
    from scanloom.plans import catalog

    tables = {
        "orders": spark.createDataFrame([(k, k // 3, D[k % 3]) for k in range(1, 30)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame([(k % 30, k * 7 % 11, k % 4, float(k % 50)) for k in range(120)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double"),
    }
    seen = catalog._with_rank(tables.get)
    st, cur, last = catalog._state_before_last(tables.get, seen)
    before = catalog._before_last(seen)
    assert cur.count() + before.count() == seen.count() and cur.join(last, ["target", "scan_id"], "left_semi").count() == cur.count() > 0
    assert before.join(last, ["target", "scan_id"], "left_semi").count() == 0 and st.count() == before.select("target", "finding_key").distinct().count() > 0
    plan = catalog.drift_verdicts(tables.get)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan and "lag(" not in plan


def test_report_findings_are_ranked_once(spark):
    """Documents read the ranked findings five times, and rank them once."""
    from scanloom.plans import catalog

    tables = {
        "orders": spark.createDataFrame([(k, k // 3, D[k % 3]) for k in range(1, 10)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame([(k % 10, k * 7 % 11, k % 4, float(k % 50)) for k in range(40)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double"),
        "part": spark.createDataFrame([(k, k % 50) for k in range(11)], "p_partkey bigint, p_size int"),
    }
    out = catalog.report_documents(tables.get)
    assert "row_number()" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 18


def test_host_reports_read_their_findings_once(spark):
    """A scan's sections, texts, counts and risk come from one pass over its ranked findings; verdicts are not worked out again for the header and for what is resolved."""
    from scanloom.plans import catalog, catalog_rules  # noqa: F401  (catalog registers first)

    tables = {
        "orders": spark.createDataFrame([(k, k // 3, D[k % 3]) for k in range(1, 30)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame([(k % 30, k * 7 % 11, k % 4, float(k % 50)) for k in range(120)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double"),
        "part": spark.createDataFrame([(k, k % 50) for k in range(11)], "p_partkey bigint, p_size int"), "region": spark.createDataFrame([(1,)], "r_regionkey int"),
    }
    out = catalog_rules.host_reports(tables.get)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS rank#") == 1 and "FullOuter" not in plan
    reports = {r["target"]: json.loads(r["report"]) for r in out.collect()}
    assert len(reports) == 10 and sorted(reports[3]) == ["drift_header", "fix_now", "resolved", "still_open"]
    for r in reports.values():
        for part in (r["fix_now"], r["still_open"]):
            n = len(part["findings"]) + len(part["good_news"])
            assert part["summary"] == (f"{len(part['findings'])} of {n} reviewed item(s) need attention." if n else remediation.WORDING["empty"]) and (n or part["overall_risk"] == "low")


def test_observations_are_dealt_by_key_once(spark):
    """State and verdicts go by target and key and find the observations dealt so; a scan's place leaves out the last scan, which is not part of the state before it."""
    from scanloom.plans import catalog

    tables = {
        "orders": spark.createDataFrame([(k, k // 3, D[k % 3]) for k in range(1, 30)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame([(k % 30, k * 7 % 11, k % 4, float(k % 50)) for k in range(120)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double"),
    }
    seen = catalog._with_rank(tables.get)
    st, cur, last = catalog._state_before_last(tables.get, seen)
    shuffled = lambda df: "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()
    assert not shuffled(drift.unchanged_since(catalog._before_last(seen), cur))
    assert not shuffled(drift.state_of_placed(seen.where("rn > 1"), ("cve_ids",)))
    past = drift.recent_scans(catalog.A.scans(tables.get), None).where("rn > 1")
    plain = drift.state_of(past, catalog.A.seen(tables.get).withColumn("severity", F.lit("x")), ("cve_ids",))
    cols = ("target", "finding_key", "first_seen", "last_seen", "status", "occurrences", "reappearance_count", "cve_ids")
    assert rows(st, *cols) == rows(plain, *cols)
