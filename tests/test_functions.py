"""Scalar rules on rows with known answers."""

import pytest
from pyspark.sql import functions as F

from scanloom.functions import scalars as s
from scanloom.functions import text as tx
from scanloom.functions import versions as v


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(x).alias(k) for k, x in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def col(spark, rows, ddl, expr):
    return [r["x"] for r in spark.createDataFrame(rows, ddl).select(expr.alias("x")).collect()]


def test_severity_and_maps(spark):
    assert col(spark, [(9.0,), (8.9,), (7.0,), (4.0,), (3.9,), (None,)], "c double", s.severity_bucket("c")) == ["critical", "high", "high", "medium", "low", "low"]
    assert col(spark, [("CRITICAL",), ("LOW",), (None,)], "c string", s.filesystem_cvss("c")) == [9.5, 3.0, 3.0]
    assert col(spark, [("CRITICAL",), ("HIGH",)], "c string", s.host_audit_cvss("c")) == [3.0, 7.5]
    assert col(spark, [(0.0, "HIGH"), (None, "LOW"), (6.1, "LOW"), (None, "INFO")], "a double, b string", s.web_cvss("a", "b")) == [7.5, 2.0, 6.1, 3.0]
    assert col(spark, [(5,), (4,), (2,), (1,), (0,), (None,)], "a int", s.detection_severity("a")) == ["HIGH", "HIGH", "MEDIUM", "LOW", "MEDIUM", "MEDIUM"]


def test_keys_text_and_dates(spark):
    assert col(spark, [("\t A  b\n",), ("",), (None,), (" x ",)], "a string", s.key_part("a")) == ["a_b", "unknown", "unknown", "x"]
    long = "word " * 100
    cut = col(spark, [(long,), ("x" * 500,), ("short",), (None,)], "a string", s.clean_truncate("a"))
    assert len(cut[0]) <= 400 and not cut[0].endswith(" w") and cut[1] == "x" * 400 and cut[2:] == ["short", None]
    assert col(spark, [(0.0,), (10.0,), (5.0,), (-3.0,)], "a double", s.spark_bar("a")) == ["▁", "█", "▄", "▁"]
    assert col(spark, [("NEW", 0), ("PERSISTING", 3), ("PERSISTING", 0), ("IMPROVED", 2)], "a string, b int", s.drift_marker("a", "b")) == ["\U0001f195 NEW", "⏳ OPEN 3 DAYS", None, None]


@pytest.mark.parametrize("text,expected", [("allows remote code execution and crash", "rce"), ("a LEAK", "infoleak"), ("nothing", "cve_other"), (None, "cve_other")])
def test_vuln_class(spark, text, expected):
    assert col(spark, [(text,)], "a string", s.vuln_class("a")) == [expected]


def test_other_classes(spark):
    assert col(spark, [("Win.Separate-1",), ("PUA.Tool",), ("Clean",)], "a string", s.signature_severity("a")) == ["HIGH", "MEDIUM", "LOW"]
    assert col(spark, [("openssl",), ("python3",), ("zlib",)], "a string", s.package_class("a")) == ["crypto", "runtime", "general"]
    assert col(spark, [("AUTH-9262",), ("KRNL",), ("ZZZZ-1",)], "a string", s.test_category("a")) == ["Authentication", "Kernel", "General"]


def test_hosts(spark):
    got = col(spark, [([3389, 22], None), ([22], None), ([], "Apple Inc"), ([80], "x"), (None, None)], "p array<int>, v string", s.host_class("p", "v"))
    assert [(r.os_guess, r.transport) for r in got] == [("windows", "winrm"), ("posix", "ssh"), ("posix", "ssh"), ("unknown", None), ("unknown", None)]
    assert col(spark, [("localhost",), ("172.20.1.1",), ("172.40.1.1",), ("8.8.8.8",), (None,)], "a string", s.is_local_target("a")) == [True, True, False, False, False]
    assert col(spark, [("1.2.3.4",), ("1.2.3",), ("1.2.3.999",), ("x",)], "a string", s.ipv4_number("a")) == [16909060, None, None, None]
    assert col(spark, [("a.b-c/d",), ("a b",), (None,)], "a string", s.is_valid_target("a")) == [True, False, False]


def test_cpe(spark):
    cpes = [("cpe:2.3:a:v:p:1.2:*",), ("cpe:/o:linux:linux_kernel:5",), ("cpe:2.3:a:v:p:-",), ("cpe:2.3:a:v",), (None,)]
    assert col(spark, cpes, "c string", v.cpe_base("c")) == ["cpe:2.3:a:v:p", "cpe:2.3:o:linux:linux_kernel", "cpe:2.3:a:v:p", None, None]
    assert col(spark, cpes, "c string", v.cpe_version("c")) == ["1.2", "5", "*", None, None]
    assert col(spark, cpes[1:2], "c string", v.humanized("c")) == ["Linux Kernel 5"]


RANGES = [
    ("1.2.3", "1.2", None, None, True), ("1.20", "1.2", None, None, False), ("1.2p1", "1.2", "9", "9", True), ("2.0", "1.0", "1", "3", False),
    ("1.5", "*", "1.0", "2.0", True), ("2.0", "*", "1.0", "2.0", True), ("2.0.1", "*", "1.0", "2.0", False), ("3.1", "*", "1.0", None, False), ("2.9", "*", "1.0", None, True),
    ("1.0", "*", None, None, False), ("abc", "*", "1", "2", False), ("1.0", "*", "x", "2", False), ("*", "*", "1", "2", False), (None, "1", None, None, False), ("1.4 (Debian)", "*", None, "1.5", True),
]


def test_version_in_range(spark):
    got = col(spark, [r[:4] for r in RANGES], "t string, x string, a string, b string", v.version_in_range("t", "x", "a", "b"))
    assert got == [r[4] for r in RANGES]
    assert col(spark, [("1.9",), ("2.0b",), ("x",)], "a string", v.bumped("a")) == ["1.10", "2.1b", "x"]
    assert col(spark, [("1.2.3a",), ("v1",), (None,)], "a string", v.plausible_version("a")) == [True, False, False]


def test_chunks(spark):
    paragraphs = ["a" * 300, "b" * 600, "c" * 1600, "short", "d" * 100]
    got = col(spark, [("\r\n\r\n".join(paragraphs),)], "t string", tx.page_chunks("t"))[0]
    assert [len(x) for x in got] == [902, 1600, 100]
    whole = "x" * 4000
    sliced = col(spark, [(whole,), ("s",)], "t string", tx.rule_chunks("t"))
    assert [len(x) for x in sliced[0]] == [1520, 1520, 960] and sliced[1] == ["s"]


def test_pages(spark):
    html = "<p>A &amp; B</p><script>x</script><nav>N</nav><form>f</form><div>C</div>"
    text = spark.createDataFrame([(html,), (None,)], "h string").select(tx.page_text("h").alias("x")).collect()
    assert text[0]["x"] == "\nA & B\nN\nC\n" and text[1]["x"] is None
    native = col(spark, [("<p>A</p><script>x</script><div>C</div>",)], "h string", tx.page_text_native("h"))
    assert native == ["\nA\n\nC\n"]


def test_model_output_and_leaks(spark):
    raw = [('{"a": 3} and more',), ('x ```json\n{"a": 1}\n``` y',), ('prose {"a": 2}',), ("none",), (None,)]
    got = col(spark, raw, "r string", F.to_json(tx.parsed_report("r")))
    assert got == [None, '{"a":1}', '{"a":2}', None, None]
    assert col(spark, [("see cve-2024-1",), ("CPE:2.3:a",), ("fine",), (None,)], "t string", tx.leaks("t")) == [True, True, False, False]


def test_commands_and_templates(spark):
    rows = [("apt-get install {package}", "bash"), ("sudo systemctl restart {service}", "bash"), ("apt; rm", "bash"), ("rm -rf", "bash"), ("apt {who}", "bash"), ("Set-ItemProperty x", "powershell"), ("", "bash"), ("apt 'x", "bash")]
    got = col(spark, rows, "t string, s string", tx.command_error("t", "s"))
    assert [x is None for x in got] == [True, True, False, False, False, True, False, False]
    filled = col(spark, [("{a} and {b}",), ("{a}",), ("{c}",)], "t string", tx.filled("t", {"a": F.lit("x"), "b": F.lit(None).cast("string")}))
    assert filled == [None, "x", None]


def test_cosine_and_sql(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0])]
    assert col(spark, rows, "a array<double>, b array<double>", F.round(s.cosine("a", "b"), 4)) == [1.0, 0.0, 0.6]
    s.register(spark)
    assert spark.sql("select severity_bucket(9.1D) a, key_part(' A b ') b, version_key('1.10-x') c, cpe_base('cpe:2.3:a:v:p:1') d").first() == ("critical", "a_b", [1, 10], "cpe:2.3:a:v:p")


def test_page_text(spark):
    pages = [
        ("<p>a</p><script>if (a < b) { '<p>' }</script><b>b</b> <!-- <p>no</p> --><br/>c", "\na\nb\n\nc"),
        ("<form>x<svg>y</svg>z</form>shown<form><p>hidden</p>", "shown\n\n"),
        ("&lt;b&gt; &amp; &copy;<p title='a>b'>&nbsp;</p>", "<b> & \u00a9\n\n"),
        ("<STYLE>p{}</STYLE><DIV>one<nav>two</nav></DIV></form>three", "\nonetwo\nthree"), ("plain", "plain"), ("", ""), (None, None), ("<script>never closed <p>", ""), ("1 < 2 and <", "1 < 2 and <"),
    ]
    got = spark.createDataFrame([(h,) for h, _ in pages], "html string").select("html", tx.page_text("html").alias("t")).collect()
    assert {r["html"]: r["t"] for r in got} == dict(pages)


def test_entities_without_semicolon(spark):
    rows = [("a&amp</title>",), ("a &amp; &copy &#65; &#65 &ampx; &quot;",)]
    text = lambda bare: [r["t"] for r in spark.createDataFrame(rows, "html string").select(tx.page_text("html", bare).alias("t")).collect()]
    assert text(True) == ["a&", 'a & \u00a9 A A &x; "'] and text(False) == ["a&amp", 'a & &copy A &#65 &ampx; "']


def test_named_chunks(spark):
    row = spark.range(1).select(tx.numbered_chunks(F.lit("r"), F.array(F.lit("a"), F.lit("b"))).alias("x")).first()["x"]
    assert [tuple(c) for c in row] == [("r", "a"), ("r#2", "Rule: r (continued)\n\nb")]


def test_words_are_those_of_a_shell(spark):
    import random
    import shlex

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab '\"\\\t;$`") for _ in range(rng.randrange(12))) for _ in range(400)] + ["a''b \"\" '' c", "", None]
    got = col(spark, [(t,) for t in texts], "t string", tx.shell_words("t"))
    for t, r in zip(texts, got):
        try:
            want = (None, shlex.split(t or ""))
        except ValueError as e:
            want = ("escape" if "escaped" in str(e) else "quote", r["words"])
        assert (r["open"], r["words"]) == want, t


def test_chaining_in_quotes(spark):
    rows = [("apt install 'a;b'", True, False), ('apt install "a;b"', True, False), ('apt install "`x`"', True, True), ("apt install '$(x)'", True, False), ("apt x; y", True, True), ("apt x\\;y", True, False), ("apt '{port}'", False, False)]
    for strict in (True, False):
        got = col(spark, [(r[0],) for r in rows], "t string", tx.command_error("t", F.lit("bash"), strict))
        assert [x is not None for x in got] == [r[1] if strict else r[2] for r in rows]
    assert col(spark, [("apt x", "zsh"), ("apt x", None)], "t string, s string", tx.command_error("t", "s")) == ["unknown shell"] * 2


def test_a_command_is_folded_once(spark):
    """Both checks of a command, also of one with long quotes, read it once."""
    rows = [("apt install 'a;b'", "bash"), ('apt "' + "x\\\\y" * 20000 + '"', "bash"), ("rm x", "bash"), ("winget a;b", "powershell")]
    df = spark.createDataFrame(rows, "t string, s string").select(tx.command_checks("t", "s", F.current_timestamp()).alias("x"))
    got = [[(c["in_quotes"], c["c"]["error"]) for c in r["x"]] for r in df.collect()]
    chained = "chaining, redirection or substitution"
    assert got == [[(True, chained), (False, None)], [(True, None), (False, None)], [(True, "not allowed: rm"), (False, "not allowed: rm")], [(True, chained), (False, chained)]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_canonical_json(spark):
    same = ['{"b": [1, 2.50, null, true], "a": {"y": "\\u00e9\\n", "x": {}}}', '{"a":{"x":{},"y":"é\\n"},"b":[1,2.5,null,true]}']
    other = ['{"b": [2.5, 1, null, true], "a": {"y": "é\\n", "x": {}}}', '{"a": 1, "a": 2}', "{broken", None, '{"a": 1} x', '{"a": 1}] x', '{"a": 1}} x', '{"a": 1}, {"a": 2}', ""]
    got = col(spark, [(t,) for t in same + other], "t string", s.canonical_json("t"))
    assert got[0] == got[1] == '{"a":{"x":{},"y":"é\\n"},"b":[1,2.5,null,true]}' and got[2] not in (None, got[0]) and got[3:] == [None] * 8
