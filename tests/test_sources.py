"""Landed files of each kind, with the broken and missing parts that they come with."""

import gzip
import json

from scanloom.sources import scans as src

XML = """<nmaprun>
<host><status state="up"/><address addr="10.0.0.5" addrtype="ipv4"/><address addr="AA:BB" addrtype="mac" vendor="Apple"/>
<hostnames><hostname name="box"/></hostnames>
<ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh" product="OpenSSH" version="8"><cpe>cpe:/o:linux:linux_kernel</cpe><cpe>cpe:/a:openbsd:openssh:8</cpe></service>
<script id="s" output="o"/><script id="s2" output="o2"/></port><port portid="80"><state state="closed"/></port></ports>
<os><osmatch name="Linux 5"><osclass><cpe>cpe:/o:linux:linux_kernel</cpe><cpe>cpe:/o:linux:linux_kernel:5</cpe></osclass></osmatch></os></host>
<host><status state="down"/><address addr="10.0.0.6" addrtype="ipv4"/></host>
</nmaprun>"""


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def put(path, name, text):
    (path / name).write_text(text)
    return str(path)


def test_service_scans(spark, tmp_path):
    hosts = src.hosts(spark, put(tmp_path, "a.xml", XML))
    assert rows(src.services(hosts), "port", "protocol", "state", "service", "cpe") == [(22, "tcp", "open", "ssh", "cpe:2.3:a:openbsd:openssh:8"), (80, "tcp", "closed", "unknown", None)]
    assert len(src.services(hosts).where("port = 22").first()["script_findings"]) == 2
    assert rows(src.host_systems(hosts), "cpe", "os_name") == [("cpe:2.3:o:linux:linux_kernel", "Linux 5"), ("cpe:2.3:o:linux:linux_kernel:5", "Linux 5")]
    assert rows(src.discovered(hosts), "ip", "mac", "vendor", "hostname", "status") == [("10.0.0.5", "AA:BB", "Apple", "box", "up"), ("10.0.0.6", None, None, None, "down")]


def test_package_and_web_scans(spark, tmp_path):
    doc = {"Results": [{"Vulnerabilities": None}, {"Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "curl", "InstalledVersion": "7", "Severity": "high"}, {}]}]}
    (tmp_path / "p").mkdir()
    assert rows(src.packages(spark, put(tmp_path / "p", "a.json", json.dumps(doc))), "pos", "package", "cve_id", "severity", "fixed_version") == [(0, "curl", "CVE-1", "HIGH", "No Patch Available"), (1, "Unknown Package", "UNKNOWN-CVE", "UNKNOWN", "No Patch Available")]
    (tmp_path / "w").mkdir()
    lines = [json.dumps({"template-id": "t1", "host": "h", "info": {"severity": "low", "reference": "http://a", "classification": {"cve-id": ["CVE-1"], "cvss-score": "7.5"}}}), "", "{broken", json.dumps({"template-id": "t2", "info": {"name": "n", "reference": ["1", "2", "3", "4"], "classification": {"cve-id": None, "cvss-score": 5}}})]
    got = rows(src.web_hits(spark, put(tmp_path / "w", "a.jsonl", "\n".join(lines))), "template_id", "name", "severity", "references", "cve_ids", "cvss_score")
    assert got == [("t1", "t1", "LOW", ["http://a"], ["CVE-1"], 7.5), ("t2", "n", "UNKNOWN", ["1", "2", "3"], [], 5.0)]


def test_audit_reports(spark, tmp_path):
    text = "# c\nos=Linux\nbad line\nwarning[]=A-1|d|-|do|\nsuggestion[]=B-1|x\nos=Linux 2\nindex=70\n"
    lines = src.key_values(spark, put(tmp_path, "r.dat", text))
    assert rows(src.audit_tests(lines), "test_id", "severity", "description", "details", "solution") == [("A-1", "HIGH", "d", "-", "do"), ("B-1", "MEDIUM", "x", "", "")]
    assert rows(src.audit_metadata(lines, ["os", "index", "none"]), "os", "index", "none") == [("Linux 2", "70", None)]


def test_malware_logs(spark, tmp_path):
    log = "SCAN_MODE: full\n/a: b FOUND: Win.Trojan-1 FOUND\n/c: ok\n/d: PUA.X FOUND\nWARNING: scan timed out\n--- SCAN SUMMARY ---\nInfected files: 2\nScanned files: 10\nTime: x\n"
    found, summary = src.malware_log(spark, put(tmp_path, "l.txt", log))
    assert rows(found, "path", "signature", "severity") == [("/a: b FOUND", "Win.Trojan-1", "HIGH"), ("/d", "PUA.X", "MEDIUM")]
    s = summary.first()
    assert s["summary"] == {"infected_files": 2, "scanned_files": 10} and s["scan_mode"] == "full" and s["truncated"]


def test_detections(spark, tmp_path):
    for i, d in enumerate(({"file_path": "p", "signature": "s", "severity_id": 5}, [{"file_path": "q", "signature": "s", "severity_id": 0}, {"file_path": "r", "signature": "s", "severity_id": 1}], None)):
        put(tmp_path, f"{i}.json", json.dumps({"detections": d}))
    assert rows(src.detections(spark, str(tmp_path)), "path", "severity") == [("p", "HIGH"), ("q", "MEDIUM"), ("r", "LOW")]


def test_vulnerability_feeds(spark, tmp_path):
    for d in ("c", "k", "e"):
        (tmp_path / d).mkdir()
    match = lambda c, **k: {"nodes": [{"cpeMatch": [{"criteria": c, **k}]}]}
    cve = {"id": "CVE-1", "descriptions": [{"lang": "es", "value": "hola"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "baseSeverity": "HIGH"}}]}, "references": [{"url": "u"}], "configurations": [match("cpe:2.3:a:v:p:1", versionEndIncluding="2"), match("bad"), match(None)]}
    got = src.cve_records(spark, put(tmp_path / "c", "p.json", json.dumps({"vulnerabilities": [{"cve": cve}], "totalResults": 1})))
    assert rows(got, "cpe_base", "vulnerable_version", "version_end_including", "cvss_score", "severity", "description") == [("cpe:2.3:a:v:p", "1", "2", 7.5, "HIGH", "No description.")]
    kev = {"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02"}, {"cveID": None}]}
    assert [str(r["date_added"]) for r in src.kev(spark, put(tmp_path / "k", "k.json", json.dumps(kev))).collect()] == ["2024-01-02"]
    with gzip.open(tmp_path / "e" / "x.csv.gz", "wt") as f:
        f.write("#model_version:v1,score_date:2024-01-01\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,x,0.1\n")
    assert rows(src.epss(spark, str(tmp_path / "e")), "cve_id", "score", "percentile", "model_date") == [("CVE-1", 0.5, 0.9, "2024-01-01")]


def test_contributions_and_paths(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps({"ordered_facts": [], "_meta": {}}))
    put(tmp_path, "b.json", "{}")
    put(tmp_path, "c.json", "junk")
    good, bad = src.contributions(spark, str(tmp_path))
    assert good.count() == 1 and bad.count() == 2
    paths = spark.createDataFrame([("/proc/1",), ("/home/x/.git/config",), ("/home/x/venv/lib",), ("/home/x/run.sh",), ("/process/a",)], "path string")
    assert rows(src.scanned_paths(paths), "path") == [("/home/x/run.sh",), ("/process/a",)]


def test_windows_facts_and_json_lines(spark, tmp_path):
    (tmp_path / "w").mkdir()
    put(tmp_path / "w", "a.json", json.dumps({"hostname": "h", "smb1": True, "rdp_deny": 0, "unknown": 1}))
    assert rows(src.windows_facts(spark, str(tmp_path / "w")), "hostname", "smb1", "rdp_deny", "uac") == [("h", True, 0, None)]
    (tmp_path / "j").mkdir()
    put(tmp_path / "j", "a.jsonl", '{"a": 1}\n{broken\n{"a": 2}\n')
    assert rows(src.json_lines(spark, str(tmp_path / "j"), "a int"), "a") == [(1,), (2,)]
    try:
        src.json_lines(spark, str(tmp_path / "j"), "a int", strict=True).collect()
        raise AssertionError("a broken line passed")
    except Exception as e:
        assert "MALFORMED" in str(e).upper()


def test_rule_documents(spark):
    ddl = "rule_id string, title string, description string, rationale string, severity string, refs string, fix_a string, fix_b string"
    df = spark.createDataFrame([("r", "T", None, "why", "high", None, " ", "x" * 30), ("s", None, None, None, None, None, "short", "other")], ddl)
    got = dict(rows(src.rule_documents(df, 20), "rule_id", "text"))
    assert got["r"] == "Rule: r\n\nTitle: T\n\nRationale: why\n\nSeverity: high\n\n" + "x" * 20 + " ...[truncated]" and got["s"] == "Rule: s\n\nshort"
