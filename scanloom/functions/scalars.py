"""Scalar rules as Column expressions: severities, keys, markers, classes, addresses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mapped(key: Col, values: dict[str, object], default: object = None) -> Column:
    """values[key], or the default."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, _c(key)), F.lit(default))


# severities

SEVERITY_RANK = {"critical": 3, "high": 2, "medium": 1, "low": 0}
#: Scores that sources without one get by severity; fixed values.
FILESYSTEM_CVSS = {"CRITICAL": 9.5, "HIGH": 7.5, "MEDIUM": 5.0}
HOST_AUDIT_CVSS = {"HIGH": 7.5, "MEDIUM": 5.0}
MALWARE_CVSS = {"HIGH": 9.0, "MEDIUM": 6.0}
WEB_CVSS = {"CRITICAL": 9.5, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.0}
#: What the history of antivirus detections calls its severities.
DETECTION_SEVERITY = {5: "HIGH", 4: "HIGH", 2: "MEDIUM", 1: "LOW"}


def severity_bucket(cvss: Col) -> Column:
    c = _c(cvss)
    return F.when(c >= 9, "critical").when(c >= 7, "high").when(c >= 4, "medium").otherwise("low")


def severity_rank(severity: Col) -> Column:
    return mapped(severity, SEVERITY_RANK, 0)


def severity_of_rank(rank: Col) -> Column:
    r = _c(rank)
    return F.when(r == 0, "low").when(r == 1, "medium").when(r == 2, "high").when(r == 3, "critical")


def filesystem_cvss(severity: Col) -> Column:
    return mapped(severity, FILESYSTEM_CVSS, 3.0)


def host_audit_cvss(severity: Col) -> Column:
    """critical gets 3.0 too, as any name that isn't listed."""
    return mapped(severity, HOST_AUDIT_CVSS, 3.0)


def malware_cvss(severity: Col) -> Column:
    return mapped(severity, MALWARE_CVSS, 3.0)


def web_cvss(score: Col, severity: Col) -> Column:
    """A score of 0 counts as none."""
    return F.coalesce(F.nullif(_c(score), F.lit(0.0)), mapped(severity, WEB_CVSS, 3.0))


def detection_severity(level: Col) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(DETECTION_SEVERITY.items())])
    return F.coalesce(F.try_element_at(table, _c(level).cast("int")), F.lit("MEDIUM"))


def hardening_index(high: Col, medium: Col) -> Column:
    return F.greatest(F.lit(0), 100 - 15 * _c(high) - 5 * _c(medium))


# keys, text, dates


def key_part(value: Col, default: str = "unknown") -> Column:
    """Trimmed, in lower case, white space as underscores; the default if nothing is left."""
    text = F.lower(F.regexp_replace(_c(value).cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.nullif(F.regexp_replace(text, r"(?U)\s+", "_"), F.lit("")), F.lit(default))


def finding_key(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), *parts)


def clean_truncate(text: Col, most: int = 400) -> Column:
    """At most `most` characters, cut back to the last space if there is one."""
    t = _c(text)
    return F.when(F.length(t) > most, F.regexp_replace(F.substring(t, 1, most), r"(?s) [^ ]*\z", "")).otherwise(t)


def age_days(since: Col, now: Col) -> Column:
    """Whole days between two timestamps, 0 at least. now is the job's parameter."""
    seconds = F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(since))
    return F.greatest(F.lit(0).cast("bigint"), F.floor(seconds / 86400))


def scan_date_label(ts: Col) -> Column:
    return F.date_format(_c(ts), "MMM d")


BARS = "▁▂▃▄▅▆▇█"


def spark_bar(value: Col, most: float = 10.0) -> Column:
    at = F.least(F.lit(7), F.greatest(F.lit(0), (_c(value) / most * 7).cast("int")))
    return F.substring(F.lit(BARS), at + 1, F.lit(1))


def drift_marker(status: Col, age: Col) -> Column:
    s, a = _c(status), _c(age)
    return (
        F.when(s == "NEW", "\U0001f195 NEW").when(s == "WORSENED", "⚠️ WORSENED").when(s == "REAPPEARED", "\U0001f501 BACK AGAIN")
        .when((s == "PERSISTING") & (a > 0), F.concat(F.lit("⏳ OPEN "), a.cast("string"), F.lit(" DAYS")))
    )


def http_refs(refs: Col, most: int = 2) -> Column:
    return F.slice(F.filter(F.coalesce(_c(refs), F.array().cast("array<string>")), lambda r: F.startswith(r, F.lit("http"))), 1, most)


def checksum(text: Col) -> Column:
    return F.sha2(_c(text).cast("string"), 256)


def whole_json(text: Col) -> Column:
    """A text that is JSON and nothing more as a VARIANT, else null. The parser alone would pass over what follows a value, which neither a list nor an object around it lets stand."""
    t = _c(text)
    listed, held = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}")))
    return F.when(held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def canonical_json(text: Col) -> Column:
    """A JSON text in one form, without blanks and with the keys of all objects in order; null if it is none or repeats a key.

    A VARIANT keeps an object's fields by key, numbers by value (1.50 is 1.5) and texts without escapes, so that writing it out is the form.
    """
    return F.to_json(whole_json(text))


def canonical_checksum(text: Col) -> Column:
    return F.sha2(canonical_json(text), 256)


def chunks_checksum(chunks: Col) -> Column:
    return F.sha2(F.array_join(_c(chunks), "\n---\n"), 256)


# classes by keyword; order matters, the first that matches wins. Fixed values.

VULN_CLASSES = [
    ("rce", ["code execution", "execute arbitrary", "arbitrary code", "run arbitrary"]),
    ("downgrade", ["downgrade", "man-in-the-middle", "mitm", "protocol-downgrade"]),
    ("bypass", ["bypass", "spoof", "does not properly validate", "does not require", "authenticate", "without the need", "enumerate"]),
    ("privesc", ["privilege", "gain privileges", "elevat"]),
    ("infoleak", ["information disclosure", "obtain sensitive", "sensitive information", "disclose", "read secret", "out-of-bounds read", "memory read", "leak", "process memory"]),
    ("crash", ["denial of service", "crash", "use-after-free", "null pointer", "buffer overflow", "stack overflow", "segmentation fault", "memory consumption", "memory corruption", "uninitialized", "out of bound", "out-of-bounds write"]),
]
WEB_CLASSES = [
    ("rce_template", ["remote code execution", " rce", "struts"]),
    ("open_datastore", ["no auth", "unauthenticated", "open redis", "open database", "open instance"]),
    ("default_creds", ["default credential", "default login", "default password"]),
    ("exposed_source", ["exposed .git", ".git directory", "source code exposed", "exposed source"]),
    ("exposed_admin", ["admin login", "admin panel", "admin page"]),
    ("outdated_cms", ["outdated", "out of date", "out-of-date", "old version"]),
]
PACKAGE_CLASSES = [
    ("kernel", ["linux-headers", "linux-image", "linux-modules", "linux-libc-dev", "linux-tools", "linux-firmware"]),
    ("crypto", ["openssl", "libssl", "gnutls", "libgnutls", "ca-certificates"]),
    ("network_client", ["curl", "libcurl", "wget"]),
    ("remote_access", ["openssh", "ssh"]),
    ("web_server", ["apache2", "nginx", "httpd", "lighttpd"]),
    ("core_library", ["glibc", "libc6", "libc-bin", "libc-dev"]),
    ("runtime", ["python", "perl", "ruby", "openjdk", "nodejs", "php"]),
    ("system_service", ["systemd", "dbus", "udev", "polkit"]),
]
#: Parts of malware signatures; fixed values.
HIGH_SIGNATURES = ["trojan", "backdoor", "rootkit", "exploit", "ransomware", "worm", "virus", "malware", "keylogger", "stealer", "dropper", "downloader", "injector", "rat", "botnet", "shellcode", "webshell", "cryptominer", "miner"]
MEDIUM_SIGNATURES = ["adware", "spyware", "pua", "pup", "riskware", "heuristics.encrypted", "heuristics.structured", "heuristics.ole", "hacktool", "tool.crack", "tool.keygen", "tool.patcher", "suspicious", "obfuscated", "countermeasure"]


def any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def first_class(text: Col, classes: list[tuple[str, list[str]]], other: str) -> Column:
    lower = F.lower(F.coalesce(_c(text), F.lit("")))
    out = None
    for name, words in classes:
        out = (F if out is None else out).when(any_of(lower, words), name)
    return out.otherwise(other)


def vuln_class(description: Col) -> Column:
    return first_class(description, VULN_CLASSES, "cve_other")


def web_class(text: Col) -> Column:
    return first_class(text, WEB_CLASSES, "web_other")


def package_class(name: Col) -> Column:
    return first_class(name, PACKAGE_CLASSES, "general")


def signature_severity(signature: Col) -> Column:
    """By substring, so that "rat" is also found in "separate"."""
    s = F.lower(_c(signature))
    return F.when(any_of(s, HIGH_SIGNATURES), "HIGH").when(any_of(s, MEDIUM_SIGNATURES), "MEDIUM").otherwise("LOW")


#: Prefixes of host-audit tests; fixed values.
TEST_CATEGORIES = {
    "AUTH": "Authentication", "BOOT": "Boot", "CONT": "Containers", "CRYP": "Cryptography", "DBS": "Databases", "DEB": "Packages",
    "DNS": "DNS", "FILE": "File Permissions", "FINT": "File Integrity", "FIRE": "Firewall", "HOME": "Home Directories",
    "HRDN": "Hardening", "HTTP": "Web Servers", "INSE": "Insecure Services", "KRB": "Kerberos", "KRNL": "Kernel", "LDAP": "LDAP",
    "LOGG": "Logging", "MACF": "MAC Frameworks", "MAIL": "Mail", "MALW": "Malware", "NAME": "Name Services", "NETW": "Networking",
    "PHP": "PHP", "PKGS": "Packages", "PRNT": "Printing", "PROC": "Processes", "RBAC": "RBAC", "SCHD": "Scheduling", "SHLL": "Shell",
    "SINT": "System Integrity", "SNMP": "SNMP", "SQD": "Squid Proxy", "SSH": "SSH", "STRG": "Storage", "TIME": "Time/NTP",
    "TOOL": "Tooling", "USB": "USB", "VIRT": "Virtualization",
}


def test_category(test_id: Col) -> Column:
    t = _c(test_id)
    return mapped(F.when(F.contains(t, F.lit("-")), F.split_part(t, F.lit("-"), F.lit(1))).otherwise(F.substring(t, 1, 4)), TEST_CATEGORIES, "General")


# hosts

WINDOWS_PORTS = [3389, 5985, 5986, 135, 139, 445]


def host_class(ports: Col, vendor: Col) -> Column:
    """os_guess and transport."""
    p = F.coalesce(_c(ports), F.array().cast("array<int>"))
    pair = lambda a, b: F.struct(F.lit(a).alias("os_guess"), F.lit(b).cast("string").alias("transport"))
    return (
        F.when(F.arrays_overlap(p, F.array(*map(F.lit, WINDOWS_PORTS))), pair("windows", "winrm"))
        .when(F.array_contains(p, 22), pair("posix", "ssh"))
        .when(F.contains(F.lower(F.coalesce(_c(vendor), F.lit(""))), F.lit("apple")), pair("posix", "ssh"))
        .otherwise(pair("unknown", None))
    )


def web_target(target: Col, ports: Col) -> Column:
    """The address to scan, by the ports seen, whatever their state."""
    t, p = _c(target), _c(ports)
    return F.when(F.array_contains(p, 443), F.concat(F.lit("https://"), t)).when(F.array_contains(p, 80), F.concat(F.lit("http://"), t)).otherwise(t)


def is_local_target(target: Col) -> Column:
    t = _c(target)
    second = F.try_to_number(F.split_part(t, F.lit("."), F.lit(2)), F.lit("999"))
    return F.coalesce(
        t.isin("localhost", "127.0.0.1", "::1") | F.startswith(t, F.lit("127.")) | F.startswith(t, F.lit("192.168.")) | F.startswith(t, F.lit("10."))
        | (F.startswith(t, F.lit("172.")) & second.between(16, 31)),
        F.lit(False),
    )


def is_valid_target(target: Col, web: bool = False) -> Column:
    return F.coalesce(_c(target).rlike(r"(?U)^[\w.\-/:]+\z" if web else r"(?U)^[\w.\-/]+\z"), F.lit(False))


def ipv4_number(ip: Col) -> Column:
    parts = F.split(_c(ip), r"\.")
    n = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("bigint")
    fits = F.size(parts) == 4
    return F.when(fits & F.forall(parts, lambda x: x.rlike(r"^\d{1,3}$") & (x.try_cast("int") <= 255)), n(1) * 16777216 + n(2) * 65536 + n(3) * 256 + n(4))


def _let(value: Column, body) -> Column:
    """body with value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address_hex(ip: Col) -> Column:
    """8 hexadecimal digits of an IPv4 address, 32 of an IPv6 one (also with :: and with an IPv4 tail); null for anything else."""
    pair = lambda h: F.concat(F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))
    digits = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")

    def groups(sides: Column) -> Column:
        """Eight groups, :: standing for as many zeros as are lacking."""
        of = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        both = F.struct(of(0).alias("left"), of(1).alias("right"), F.size(sides).alias("n"))
        lacking = lambda x: 8 - F.size(x["left"]) - F.size(x["right"])
        return _let(both, lambda x: F.when((x["n"] == 2) & (lacking(x) > 0), F.concat(x["left"], F.array_repeat(F.lit("0"), lacking(x)), x["right"])).when((x["n"] == 1) & (lacking(x) == 0), x["left"]))

    def six(text: Column) -> Column:
        whole = F.when(~text.rlike("(^|[^:]):$|^:[^:]|:::"), groups(F.split(text, "::")))
        return _let(whole, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))

    def any_form(text: Column) -> Column:
        tail = ipv4_number(F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1))
        plain = _let(tail, lambda n: F.when(n.isNull(), text).otherwise(F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), pair(digits(n)))))
        return F.when(F.contains(text, F.lit(":")), _let(plain, six)).otherwise(digits(ipv4_number(text)))

    return _let(F.lower(F.trim(_c(ip))), any_form)


def address_prefix(digits: Col, bits: Col) -> Column:
    """The first bits of address_hex, as text that is equal for equal prefixes of one length."""
    d, n = _c(digits), _c(bits)
    next_digit = F.conv(F.substring(d, F.floor(n / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.when(n % 4 > 0, F.floor(next_digit / F.pow(F.lit(2), 4 - n % 4)).cast("int").cast("string")).otherwise("")
    return F.concat(F.substring(d, F.lit(1), F.floor(n / 4).cast("int")), F.lit("/"), rest)


def platform_of(system: Col, verbose: Col) -> Column:
    v = F.lower(_c(verbose))
    named = F.when(F.startswith(v, F.lit("windows")), "windows").when(F.startswith(v, F.lit("linux")), "linux").when(F.startswith(v, F.lit("darwin")), "darwin")
    return F.coalesce(F.nullif(F.lower(_c(system)), F.lit("")), named, F.lit("unknown"))


# affected strings


def service_and_port(affected: Col) -> Column:
    """The service and port that a text such as "Port 22 — ssh" or "Operating system: X" names."""
    a = F.coalesce(_c(affected), F.lit(""))
    port = F.nullif(F.regexp_extract(a, r"(?U)^Port\s+(\d+)\s+—\s+(\S+)", 1), F.lit(""))
    service = F.nullif(F.regexp_extract(a, r"(?U)^Port\s+(\d+)\s+—\s+(\S+)", 2), F.lit(""))
    system = F.when(F.startswith(a, F.lit("Operating system:")), F.nullif(F.trim(F.substring(a, F.lit(18), F.length(a))), F.lit("")))
    return F.struct(F.coalesce(service, system).alias("service"), port.alias("port"))


def package_of(affected: Col) -> Column:
    a = _c(affected)
    return F.when(F.startswith(a, F.lit("Package: ")), F.nullif(F.trim(F.split_part(F.substring(a, F.lit(10), F.length(a)), F.lit(" "), F.lit(1))), F.lit("")))


def web_service(affected: Col) -> Column:
    a = _c(affected)
    return F.nullif(F.trim(F.split_part(a, F.lit(" on "), F.lit(1))), F.lit(""))


# vectors


def cosine(a: Col, b: Col) -> Column:
    """0 where a vector has no length. A longer vector's tail counts in its length only."""
    x, y = (F.transform(_c(v), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.filter(F.zip_with(x, y, lambda p, q: p * q), lambda e: e.isNotNull()))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda e: e * e)))
    size = norm(x) * norm(y)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def register(spark: SparkSession) -> None:
    """SQL functions for users; Catalyst inlines them."""
    for ddl in (
        "severity_bucket(x double) returns string return case when x >= 9 then 'critical' when x >= 7 then 'high' when x >= 4 then 'medium' else 'low' end",
        r"key_part(x string) returns string return coalesce(nullif(regexp_replace(lower(regexp_replace(x, '(?U)^\\s+|\\s+$', '')), '(?U)\\s+', '_'), ''), 'unknown')",
        r"version_key(x string) returns array<bigint> return case when x rlike '^\\d' then transform(split(regexp_extract(x, '^(\\d+(\\.\\d+)*)', 1), '\\.'), p -> try_cast(p as bigint)) else array() end",
        "cpe_base(x string) returns string return concat('cpe:2.3:', array_join(slice(split(regexp_replace(x, '^cpe:(2[.]3:|/)', ''), ':'), 1, 3), ':'))",
    ):
        spark.sql(f"create or replace temporary function {ddl}")
