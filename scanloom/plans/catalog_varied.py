"""Registered queries of rules over columns that vary. Inputs are SQL expressions that both engines read; the SQL beside each query states the rule over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import scalars, versions
from scanloom.operators import fleet, matching, remediation, training

from .catalog import query


def pick(key: str, *values: str | None) -> str:
    """The value of a list at `key`, as an expression of both engines."""
    said = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    return f"case ({key}) % {len(values)} " + " ".join(f"when {i} then {said(v)}" for i, v in enumerate(values)) + " end"


def third(column: str, n: int) -> str:
    return f"cast(floor({column} / {n}.0) as bigint)"


def select(inputs: dict[str, str], table: str = "part") -> str:
    return "select " + ", ".join(f"{x} as {name}" for name, x in inputs.items()) + f" from {table}"


def first_class_sql(text: str, classes: list[tuple[str, list[str]]], other: str) -> str:
    """The first class of which a word stands in the text."""
    found = " ".join(f"when {' or '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})' for w in words)} then '{name}'" for name, words in classes)
    return f"case {found} else '{other}' end"


def mapped_sql(key: str, table: dict, other: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v!r}" for k, v in table.items()) + f" else {other} end"


# versions

_VERSIONS = {
    "p_partkey": "p_partkey",
    "version": f"""concat(case when p_partkey % 29 = 0 then '*' when p_partkey % 31 = 0 then '' else concat(cast(p_partkey % 4 as string), '.', cast({third("p_partkey", 4)} % 6 as string)) end,
      case p_size % 4 when 0 then '' when 1 then concat('.', cast(p_size % 7 as string)) when 2 then '-p1' else 'p2' end, case p_partkey % 9 when 0 then ' (x)' when 1 then 'beta' else '' end)""",
    "exact": f"case p_size % 6 when 0 then concat(cast({third('p_partkey', 3)} % 4 as string), '.', cast(p_partkey % 6 as string)) when 1 then cast(p_partkey % 4 as string) when 2 then null else '*' end",
    "low": "case when p_partkey % 5 = 0 then null when p_partkey % 37 = 0 then 'odd' when p_partkey % 5 < 3 then concat(cast((p_partkey + p_size) % 4 as string), '.', cast(p_size % 6 as string)) else cast(p_size % 4 as string) end",
    "high": "case p_partkey % 3 when 0 then null when 1 then concat(cast(1 + (p_partkey + p_size) % 4 as string), '.', cast(p_size % 3 as string), '.1') else cast(p_size % 5 as string) end",
}
_KEY = r"case when regexp_matches({0}, '^\d') then list_transform(string_split(regexp_extract({0}, '^(\d+(\.\d+)*)', 1), '.'), lambda x: cast(x as bigint)) else cast([] as bigint[]) end"


@query(f"""with i as ({select(_VERSIONS)}),
t as (select p_partkey, split_part(version, ' ', 1) as v, coalesce(exact, '') as x, coalesce(low, '') as lo, coalesce(high, '') as hi from i),
k as (select *, {_KEY.format("v")} as vk, {_KEY.format("lo")} as lk, {_KEY.format("hi")} as hk from t)
select p_partkey, v not in ('', '*') and case when x not in ('', '*') then v = x or (starts_with(v, x) and substr(v, length(x) + 1, 1) in ('.', '-', 'p', '_'))
  else (lo <> '' or hi <> '') and len(vk) > 0 and (lo = '' or (len(lk) > 0 and lk <= vk and (hi <> '' or vk[1] <= lk[1] + 1))) and (hi = '' or (len(hk) > 0 and vk <= hk)) end as hit from k""")
def version_cases(t):
    """Versions of 24 numbers with and without patches, tails and remarks, against exact versions and ranges of either kind."""
    rows = t("part").selectExpr(*[f"{x} as {name}" for name, x in _VERSIONS.items()])
    return rows.select("p_partkey", versions.version_in_range("version", "exact", "low", "high").alias("hit"))


# Windows facts

_FACTS = {
    "file": "p_partkey", "elevated": "p_partkey % 2 = 0", "defender_realtime": "case p_partkey % 5 when 0 then false when 1 then null else true end",
    "firewall_domain": "case p_size % 4 when 0 then false when 1 then null else true end", "firewall_private": "case (p_partkey + p_size) % 6 when 0 then false when 1 then null else true end",
    "firewall_public": "case (3 * p_partkey + p_size) % 7 when 0 then false when 1 then null else true end", "smb1": "case (5 * p_partkey + p_size) % 11 when 0 then true when 1 then null else false end",
    "rdp_deny": "cast((p_partkey + p_size) % 3 as int)", "rdp_nla": "case p_size % 3 when 0 then 1 when 1 then 0 end", "uac": "case p_partkey % 9 when 0 then 0 when 1 then null else 1 end",
    "bitlocker": pick("p_size", "On", "off", "ON", None, "Suspended"), "au_option": "cast(p_partkey % 6 as int)", "days_since_update": "case when p_partkey % 11 = 0 then null else cast(p_size + p_partkey % 7 as int) end",
    "guest_enabled": "case p_partkey % 8 when 0 then true when 1 then null else false end", "exec_policy": pick(third("p_partkey", 5), "Restricted", "Bypass", "UNRESTRICTED", "RemoteSigned", None),
}
_UNKNOWN = "case when elevated then 'could not be determined' else 'could not be determined — re-run the audit as Administrator' end"


def _gated(fact: str, test: str, bad: str, severity: str) -> str:
    return f"select file, '{test}', case when {fact} is null then 'MEDIUM' else '{severity}' end, case when {fact} is null then {_UNKNOWN} end from i where {fact} is null or {bad}"


_WINDOWS = " union all ".join([
    _gated("defender_realtime", "DEFENDER-RTP", "not defender_realtime", "HIGH"), *[_gated(f"firewall_{p}", f"FIREWALL-{p.upper()}", f"not firewall_{p}", "HIGH") for p in ("domain", "private", "public")],
    _gated("smb1", "SMB1-ENABLED", "smb1", "HIGH"), _gated("bitlocker", "BITLOCKER-OFF", "lower(bitlocker) <> 'on'", "MEDIUM"),
    "select file, 'RDP-ENABLED', 'MEDIUM', null from i where rdp_deny = 0", "select file, 'RDP-NLA', 'HIGH', null from i where rdp_deny = 0 and rdp_nla is distinct from 1",
    "select file, 'UAC-DISABLED', 'HIGH', null from i where uac = 0", "select file, 'WU-AUTOUPDATE', 'HIGH', null from i where au_option in (0, 1)",
    "select file, 'WU-STALE', 'MEDIUM', 'last update ' || days_since_update || ' days ago' from i where days_since_update > 30", "select file, 'GUEST-ENABLED', 'MEDIUM', null from i where guest_enabled",
    "select file, 'PS-EXECPOLICY', 'MEDIUM', 'currently ''' || exec_policy || '''' from i where lower(exec_policy) in ('unrestricted', 'bypass')",
])


@query(f"with i as ({select(_FACTS)}), r(p_partkey, test_id, severity, extra) as ({_WINDOWS}) select * from r")
def windows_rules(t):
    """All 13 rules over facts that vary one apart from the other, unknown ones with and without elevation among them."""
    facts = t("part").selectExpr(*[f"{x} as {name}" for name, x in _FACTS.items()])
    return remediation.windows_findings(facts).select(F.col("file").alias("p_partkey"), "test_id", "severity", "extra")


# rule directories

_PATH = f"""concat('/r/a', cast(p_partkey % 5 as string), case when p_partkey % 3 > 0 then concat('/b', cast(p_size % 7 as string)) else '' end,
  case when p_partkey % 3 > 1 then concat('/c', cast({third("p_partkey", 7)} % 3 as string)) else '' end, '/rule', cast(p_partkey as string))"""
_GROUPS = """select concat('/r/a', cast(p_partkey % 4 as string)) as group_dir from part where p_size % 10 = 0
union select concat('/r/a', cast(p_partkey % 5 as string), '/b', cast(p_size % 5 as string)) from part where p_partkey % 6 = 0
union select concat('/r/a', cast(p_partkey % 5 as string), '/b', cast(p_size % 7 as string), '/c1') from part where p_partkey % 15 = 0"""


@query(f"""with p as (select p_partkey, {_PATH} as path from part), g as ({_GROUPS}),
m as (select p_partkey, path, arg_max(group_dir, length(group_dir)) as best from p left join g on starts_with(path, group_dir || '/') group by 1, 2)
select p_partkey, coalesce(best, regexp_replace(path, '/[^/]*$', '')) as group_dir from m""")
def rule_groups(t):
    paths = t("part").selectExpr("p_partkey", f"{_PATH} as path")
    p = "p_partkey"
    text = lambda n, x: F.concat(F.lit(n), x.cast("string"))
    part = t("part")
    a, b = text("/r/a", F.col(p) % 5), lambda n: text("/b", F.col("p_size") % n)
    groups = part.where("p_size % 10 = 0").select(text("/r/a", F.col(p) % 4).alias("group_dir")).unionByName(part.where("p_partkey % 6 = 0").select(F.concat(a, b(5)).alias("group_dir")))
    groups = groups.unionByName(part.where("p_partkey % 15 = 0").select(F.concat(a, b(7), F.lit("/c1")).alias("group_dir"))).distinct()
    return matching.nearest_ancestor(paths.select("path"), groups, "/r").join(paths, "path").select("p_partkey", "group_dir")


# what a model answered

_ANSWER = """concat('{"summary": "', case doc_id % 7 when 0 then concat('see CVE-20', cast(10 + doc_id % 15 as string), '-', cast(1000 + doc_id as string)) when 1 then 'CPE:2.3:a' when 2 then 'CVE-20-1' else 'fine' end,
  ' ', coalesce(lang, ''), '", "good_news": ["', case when doc_id % 13 = 0 then 'cpe:2.3:o' else 'all well' end, '"], "findings": [{"references": ["CVE-2024-', cast(doc_id as string), '", "u"], "what": "', case when doc_id % 11 = 0 then 'cve-2020-1' else 'x' end, '"}]}')"""
_RAW = f"""case doc_id % 6 when 0 then concat('```json', chr(10), {_ANSWER}, chr(10), '``` and more') when 1 then {_ANSWER} when 2 then concat('So it is: ', {_ANSWER}) when 3 then concat({_ANSWER}, ' or so')
  when 4 then concat('no object ', cast(doc_id as string)) else concat('```', chr(10), {_ANSWER}, chr(10), '```') end"""
_SCORED = rf"""with o as (select doc_id, {_RAW} as raw from documents),
b as (select doc_id, case when regexp_matches(raw, '(?s)```(?:json)?\s*\n(.*?)\n\s*```') then regexp_extract(raw, '(?s)```(?:json)?\s*\n(.*?)\n\s*```', 1) else raw end as body from o),
j as (select doc_id, case when contains(body, '{{') and json_valid(substr(body, strpos(body, '{{'))) then json(substr(body, strpos(body, '{{'))) end as v from b),
x as (select doc_id, v is not null as parsed, concat_ws(chr(10), v->>'$.summary', v->>'$.good_news', regexp_replace(coalesce(v->>'$.findings', ''), '"references":\[[^\]]*\]', '', 'g')) as said from j),
s as (select doc_id as index, parsed, parsed and not regexp_matches(said, '(?i)CVE-\d{{4}}-\d+|cpe:2\.3:') as text_ok, parsed and doc_id % 5 <> 0 as severities_ok from x)"""


def _scored(t) -> DataFrame:
    outputs = t("documents").selectExpr("doc_id as index", f"{_RAW} as raw_output")
    return training.scored_outputs(outputs, None, outputs.where("index % 5 = 0").select("index"))


@query(_SCORED + " select *, parsed and text_ok and severities_ok as passed from s")
def output_scores(t):
    """Answers with and without fences, prose around them and broken ends, whose texts name records or not."""
    return _scored(t)


@query(_SCORED + """ select count(*) as total, round(avg(cast(parsed and text_ok and severities_ok as int)), 9) as pass_rate, count(*) filter (not parsed) as parse_failures, count(*) filter (parsed and not text_ok) as text_failures,
       count(*) filter (parsed and text_ok and not severities_ok) as severity_failures, round(avg(cast(index % 100 as double)), 9) as mean_latency from s""")
def output_totals(t):
    out = training.score_totals(_scored(t).withColumn("latency", (F.col("index") % 100).cast("double")))
    return out.select("total", F.round("pass_rate", 9).alias("pass_rate"), "parse_failures", "text_failures", "severity_failures", F.round("mean_latency", 9).alias("mean_latency"))


@query("""with f as (select doc_id, lang, list_transform(range(doc_id % 5), lambda i: '{"n": "' || (doc_id + i) || '"' || case when (doc_id * 3 + i) % 7 > 0 then ', "fix_facts": "' || i || '"' else '' end || '}') as facts from documents)
select doc_id, case when len(list_filter(facts, lambda x: json_extract(x, '$.fix_facts') is null)) > 0 then 'superseded' else 'labeled' end as status, coalesce(lang, 'linux') as platform from f""")
def superseded_rows(t):
    """Lists of none to four facts, in which one or another lacks its structured part; the platform is a column that has gaps."""
    k = F.col("doc_id")
    fact = lambda i: F.concat(F.lit('{"n": "'), (k + i).cast("string"), F.lit('"'), F.when((k * 3 + i) % 7 > 0, F.concat(F.lit(', "fix_facts": "'), i.cast("string"), F.lit('"'))).otherwise(""), F.lit("}"))
    facts = F.when(k % 5 > 0, F.transform(F.sequence(F.lit(0), (k % 5 - 1).cast("int")), fact)).otherwise(F.array().cast("array<string>"))
    rows = t("documents").select("doc_id", F.concat(F.lit("["), F.array_join(facts, ", "), F.lit("]")).alias("ordered_facts"), F.lit("labeled").alias("status"), F.col("lang").alias("platform"))
    return training.with_platform(training.superseded(rows)).select("doc_id", "status", "platform")


# scalar rules

_WORDS = [w for _, words in scalars.VULN_CLASSES for w in words] + ["odd", "plain", "nothing known"]
_WEB = [w for _, words in scalars.WEB_CLASSES for w in words] + ["a page", "a form"]
_PACKAGES = [w for _, words in scalars.PACKAGE_CLASSES for w in words] + ["zlib", "vim"]
_SIGNS = [*scalars.HIGH_SIGNATURES, *scalars.MEDIUM_SIGNATURES, "Eicar", "Clean"]
_TESTS = [*scalars.TEST_CATEGORIES, "ZZZ", "A"]
_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "critical", None]
_RULES = {
    "p_partkey": "p_partkey", "level": pick("p_partkey", *_LEVELS), "high": "p_size % 9", "medium": "p_partkey % 13",
    "description": f"concat('A ', {pick('7 * p_partkey', *_WORDS)}, ' and ', upper({pick('p_size + 3 * p_partkey', *_WORDS)}))", "page": f"concat(upper({pick('p_partkey', *_WEB)}), ' / ', {pick('p_size', *_WEB)})",
    "package": f"concat({pick('p_partkey', *_PACKAGES)}, '-', cast(p_size as string))", "sign": f"concat('Win.', upper({pick('p_partkey', *_SIGNS)}), '-', {pick('p_size', *_SIGNS)})",
    "test": f"case when p_size % 3 = 0 then {pick('p_partkey', *_TESTS)} else concat({pick('p_partkey', *_TESTS)}, '-', cast(p_size as string)) end",
    "system": pick("p_size", "", None, "FreeBSD", "Windows"), "spoken": f"concat({pick('p_partkey', 'Windows-', 'linux-', 'DARWIN', 'Plan', '')}, cast(p_size as string))",
    "status": pick("p_partkey", "NEW", "WORSENED", "REAPPEARED", "PERSISTING", "IMPROVED", None), "age": "p_size - 3", "detected": "cast(p_size % 7 as int)",
    "version": f"concat({pick('p_partkey', '', 'v', '1.', '2.3.')}, cast(p_size as string), {pick('p_size', '', '.4', 'a', '-x', '.1.2.3.4')})",
}


def _contains(text: str, words: list[str]) -> str:
    return " or ".join(f"contains(lower({text}), '{w}')" for w in words)


@query(rf"""with i as ({select(_RULES)})
select p_partkey, cast({mapped_sql("level", scalars.FILESYSTEM_CVSS, "3.0")} as double) as filesystem, cast({mapped_sql("level", scalars.HOST_AUDIT_CVSS, "3.0")} as double) as host_audit, cast({mapped_sql("level", scalars.MALWARE_CVSS, "3.0")} as double) as malware,
  case when detected in (4, 5) then 'HIGH' when detected = 1 then 'LOW' else 'MEDIUM' end as detection, greatest(0, 100 - 15 * high - 5 * medium) as hardening,
  coalesce(nullif(lower(system), ''), case when starts_with(lower(spoken), 'windows') then 'windows' when starts_with(lower(spoken), 'linux') then 'linux' when starts_with(lower(spoken), 'darwin') then 'darwin' end, 'unknown') as platform,
  case when {_contains("sign", scalars.HIGH_SIGNATURES)} then 'HIGH' when {_contains("sign", scalars.MEDIUM_SIGNATURES)} then 'MEDIUM' else 'LOW' end as signature,
  {mapped_sql("case when contains(test, '-') then split_part(test, '-', 1) else substr(test, 1, 4) end", scalars.TEST_CATEGORIES, "'General'")} as category,
  {first_class_sql("description", scalars.VULN_CLASSES, "cve_other")} as vuln_class, {first_class_sql("page", scalars.WEB_CLASSES, "web_other")} as web_class, {first_class_sql("package", scalars.PACKAGE_CLASSES, "general")} as package_class,
  case when status = 'NEW' then '🆕 NEW' when status = 'WORSENED' then '⚠️ WORSENED' when status = 'REAPPEARED' then '🔁 BACK AGAIN' when status = 'PERSISTING' and age > 0 then '⏳ OPEN ' || age || ' DAYS' end as marker,
  regexp_matches(version, '^[0-9]+(\.[0-9]+){{0,4}}[a-z0-9]*$') as plausible from i""")
def scalar_rules(t):
    """Texts of two words of all classes, signatures of two parts, tests of all prefixes, versions and systems in several forms."""
    i = t("part").selectExpr(*[f"{x} as {name}" for name, x in _RULES.items()])
    return i.select(
        "p_partkey", scalars.filesystem_cvss("level").alias("filesystem"), scalars.host_audit_cvss("level").alias("host_audit"), scalars.malware_cvss("level").alias("malware"), scalars.detection_severity("detected").alias("detection"),
        scalars.hardening_index("high", "medium").alias("hardening"), scalars.platform_of("system", "spoken").alias("platform"), scalars.signature_severity("sign").alias("signature"), scalars.test_category("test").alias("category"),
        scalars.vuln_class("description").alias("vuln_class"), scalars.web_class("page").alias("web_class"), scalars.package_class("package").alias("package_class"), scalars.drift_marker("status", "age").alias("marker"), versions.plausible_version("version").alias("plausible"),
    )


@query("""with p as (select l_orderkey as target, case l_partkey % 7 when 0 then 443 when 1 then 80 when 2 then 80 when 3 then 8080 else 22 end as port from lineitem)
select target, case when bool_or(port = 443) then 'https://' when bool_or(port = 80) then 'http://' else '' end || 'h' || target as address from p group by target""")
def web_targets(t):
    """The address of each target by all the ports that were seen of it."""
    k = F.col("l_partkey") % 7
    ports = t("lineitem").select(F.col("l_orderkey").alias("target"), F.when(k == 0, 443).when(k < 3, 80).when(k == 3, 8080).otherwise(22).alias("port"))
    return fleet.web_targets(ports.withColumn("host", F.concat(F.lit("h"), F.col("target").cast("string"))), "host").select("target", "address")


# what to do about findings

_SERVICES = [*remediation.SERVICE_PACKAGES, "zzz", "SSH"]
_FIX = {
    "p_partkey": "p_partkey", "source": pick("p_partkey", "filesystem", "host_audit", "network", "malware", "web", "iot_defaults", "network"), "word": "split_part(p_name, ' ', 1)",
    "affected": f"""case p_partkey % 7 when 0 then concat('Package: ', {pick(third("p_partkey", 7), *_PACKAGES)}, ' ', cast(p_size as string)) when 1 then 'Host setting: T' when 3 then concat('File: /d/', cast(p_size as string))
      when 4 then concat({pick("p_size", *_WEB)}, ' on http://h/', cast(p_size as string)) else concat('Port ', cast(p_partkey % 9000 as string), ' — ', {pick("p_size", *_SERVICES)}) end""",
    "description": f"concat('A ', {pick('7 * p_partkey', *_WORDS)})", "ref": pick("p_partkey + p_size", "8.1", "http://x/1", "", None), "platform": pick(third("p_partkey", 7), "linux", "Windows", "Darwin", "plan9"), "creds": "p_partkey % 13 = 0",
}
#: Five classes of a catalog, one for each row of region.
_CATALOG = {
    "class": ["crash", "default_creds", "malware", "web_other", "bypass"], "fix_summary": ["Update {service}.", "Set new credentials for {service} on port {port}.", "Isolate the host.", "Review {service}.", "Install {package} {fixed_version}."],
    "first": ["Restart {service}", "Log in to {service}", "Scan again", "Open {service}", "Install {fixed_version}"], "second": ["Check port {port}", "Write it down", "Check {path}", "Look at it", "Check {package}"],
}
_COMMANDS = {"linux_apt": "systemctl restart {package}", "windows_powershell": "Restart-Service {service}", "darwin_brew": "brew services restart {package}", "windows_winget": "winget upgrade {package}"}
_NAMES = ("service", "port", "package", "fixed_version")


def _filled(template: str) -> str:
    lacks = " or ".join(f"contains({template}, '{{{n}}}') and coalesce({n}, '') = ''" for n in _NAMES) + f" or contains({template}, '{{path}}')"
    out = template
    for n in _NAMES:
        out = f"replace({out}, '{{{n}}}', coalesce({n}, ''))"
    return f"case when not ({lacks}) then {out} end"


_PKG = ", ".join(f"('{s}', '{p.lower()}', {i}, '{packages[k]}')" for s, packages in remediation.SERVICE_PACKAGES.items() for p, keys in remediation.PLATFORM_KEYS.items() for i, k in enumerate(keys) if k in packages)
_COMMAND = ", ".join(f"('{p}', {i}, '{_COMMANDS[k]}')" for p, keys in remediation.PLATFORM_KEYS.items() for i, k in enumerate(keys) if k in _COMMANDS)


@query(f"""with i as ({select(_FIX)}),
k as (select *, case when source in ('network', 'iot_defaults') then case when creds then 'default_creds' else {first_class_sql("description", scalars.VULN_CLASSES, "cve_other")} end when source = 'malware' then 'malware'
                 when source = 'web' then {first_class_sql("(affected || ' ' || description)", scalars.WEB_CLASSES, "web_other")} end as kind,
            case when source = 'web' then trim(split_part(affected, ' on ', 1)) when starts_with(affected, 'Port ') then split_part(affected, ' ', 4) end as service,
            case when starts_with(affected, 'Port ') then split_part(affected, ' ', 2) end as port, case when source <> 'web' and not starts_with(coalesce(ref, ''), 'http') then ref end as fixed_version from i),
p as (select p_partkey, arg_min(v.package, v.n) as package from k join (values {_PKG}) v(service, platform, n, package) on lower(trim(k.service)) = v.service and lower(k.platform) = v.platform where source <> 'web' group by 1),
c as (select {', '.join(f"{pick('r_regionkey', *v)} as {n}" for n, v in _CATALOG.items())} from region),
m as (select platform, arg_min(command, n) as command from (values {_COMMAND}) v(platform, n, command) group by 1),
j as (select k.*, package, c.class, c.fix_summary, c.first, c.second, m.command from k left join p using (p_partkey) left join c on c.class = k.kind left join m on m.platform = lower(k.platform)),
s as (select *, list_filter([{_filled("first")} || coalesce(chr(10) || '    $ ' || nullif({_filled("command")}, ''), ''), {_filled("second")}], lambda x: x is not null) as steps, {_filled("fix_summary")} as summary,
             case when starts_with(affected, 'Package: ') then split_part(substr(affected, 10), ' ', 1) end as named from j),
t as (select *, case when source = 'filesystem' and named is not null then 'filesystem' when source = 'host_audit' and coalesce(ref, '') <> '' then 'host_audit' when class is not null and (len(steps) > 0 or source = 'malware') then class end as out from s)
select p_partkey, out as class, case out when 'filesystem' then 'upgrade' when 'host_audit' then 'reconfigure' end as action, case when out = 'filesystem' then named end as package, case when out = 'filesystem' then {first_class_sql("named", scalars.PACKAGE_CLASSES, "general")} end as category,
       case when out = 'host_audit' then ref when out = 'filesystem' then case when coalesce(ref, '') <> '' then 'Update ' || named || ' to version ' || ref || ' or later.' else 'Update ' || named || ' to the latest available version.' end when out is not null then summary end as fix_summary,
       case when out in ('filesystem', 'host_audit') then null when out is not null then array_to_string(steps, ' | ') end as steps,
       case when out = 'filesystem' then ref when out = 'host_audit' then null when out is not null then fixed_version end as fixed_version,
       case when out in ('filesystem', 'host_audit') then 'verified:citation' when out is not null then 'authored' end as provenance, case when out not in ('filesystem', 'host_audit') and starts_with(ref, 'http') then ref end as refs
from t""")
def fix_facts(t):
    """Findings of six sources, thirteen services, four platforms and all classes of texts against a catalog of five classes, with the commands of each platform."""
    # a small file is few tasks, however much is to be done with a row
    part = t("part").select("p_partkey", "p_size", "p_name")
    i = part.repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey").selectExpr(*[f"{x} as {name}" for name, x in _FIX.items()])
    scripts = F.when(F.col("creds"), F.array(F.struct(F.lit("http-default-accounts").alias("id"), F.lit("found").alias("output"))))
    rows = i.select("*", F.when(F.col("ref").isNotNull(), F.array("ref")).alias("remediation_refs"), scripts.alias("script_findings"))
    commands = F.create_map(*[F.lit(x) for kv in _COMMANDS.items() for x in kv])
    c = t("region").selectExpr(*[f"{pick('r_regionkey', *v)} as {n}" for n, v in _CATALOG.items()])
    steps = F.array(F.struct(F.col("first").alias("text"), commands.alias("commands")), F.struct(F.col("second").alias("text"), F.lit(None).cast("map<string,string>").alias("commands")))
    out = remediation.with_fix_facts(rows, c.select("class", "fix_summary", steps.alias("steps"), F.lit("authored").alias("provenance")))
    f = F.col("fix_facts")
    return out.select("p_partkey", f["class"].alias("class"), f["action"].alias("action"), f["package"].alias("package"), f["category"].alias("category"), f["fix_summary"].alias("fix_summary"), F.array_join(f["steps"], " | ").alias("steps"), f["fixed_version"].alias("fixed_version"), f["provenance"].alias("provenance"), F.array_join(f["references"], " ").alias("refs"))


# samples

@query("""with r as (select *, row_number() over (partition by l_suppkey order by md5('7:' || cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar)), l_orderkey || '|' || l_linenumber, l_partkey) as n from lineitem)
select l_suppkey, l_orderkey, l_linenumber from r where n <= 5""")
def seeded_sample(t):
    """Five lines of each supplier in the order that seed 7 gives."""
    rows = t("lineitem").withColumn("id", F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return training.seeded_top(rows, ["l_suppkey"], F.col("id"), 5, seed=7).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""with p as (select distinct p_size * 11 as port, split_part(p_name, ' ', 1) as service from part where p_size * 11 not in (110, 143, 220)),
o as (select port, service, row_number() over (partition by port order by md5('3:' || service), service) as n from p)
select port, service from o where n = 1 order by md5('3:' || port), port limit 20""")
def service_sample(t):
    """A service for each of at most 20 ports, in the order that seed 3 gives."""
    rows = t("part").select((F.col("p_size") * 11).alias("port"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("service")).distinct()
    return training.one_service_a_port(rows, [110, 143, 220], 20, seed=3).select("port", "service")
