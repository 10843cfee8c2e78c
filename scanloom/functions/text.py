"""Text rules: paragraphs and chunks, pages, model output, leaks, command checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import Col, _c, whole_json


def normalized(text: Col) -> Column:
    """Unix line ends, one space for blanks and tabs, trimmed lines."""
    t = F.regexp_replace(F.regexp_replace(_c(text), "\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(t, r"(?m)^ | $", "")


def paragraphs(text: Col, least: int = 40) -> Column:
    parts = F.transform(F.split(normalized(text), r"\n{2,}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: F.length(p) >= least)


def packed(parts: Column, most: int, enough: int | None = None, glue: str = "\n\n") -> Column:
    """Greedy packing in order: a part joins the pack while that stays within `most` and, if given, the pack is below `enough`."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, p: Column) -> Column:
        joined = F.concat(s["held"], F.lit(glue), p)
        fits = (F.length(joined) <= most) & (F.lit(True) if enough is None else F.length(s["held"]) < enough)
        return (
            F.when(s["held"].isNull(), F.struct(s["done"].alias("done"), p.alias("held")))
            .when(fits, F.struct(s["done"].alias("done"), joined.alias("held")))
            .otherwise(F.struct(F.array_append(s["done"], s["held"]).alias("done"), p.alias("held")))
        )

    return F.aggregate(parts, empty, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["held"])))


def page_chunks(text: Col, target: int = 800, most: int = 1500) -> Column:
    """Paragraphs merged until they reach the target; a single longer paragraph stays whole."""
    return packed(paragraphs(text), most, target)


def sliced(atom: Column, most: int) -> Column:
    n = F.ceil(F.length(atom) / most).cast("int")
    return F.when(F.length(atom) <= most, F.array(atom)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(atom, i * most + 1, F.lit(most))))


def rule_chunks(text: Col, single: int = 1600, most: int = 1520) -> Column:
    """A short text stays one chunk; else its paragraphs are packed, longer ones being sliced first. See numbered_chunks for their names."""
    t = _c(text)
    atoms = F.flatten(F.transform(F.filter(F.split(t, "\n\n"), lambda p: F.trim(p) != ""), lambda p: sliced(p, most)))
    return F.when(F.length(t) <= single, F.array(t)).otherwise(packed(atoms, most))


def numbered_chunks(name: Col, chunks: Col) -> Column:
    """Chunks of a rule with references: the first has the rule's name, the others name#n and a line that says what they go on with (fixed form)."""
    n, c = _c(name), _c(chunks)
    ref = lambda i: F.when(i == 0, n).otherwise(F.concat(n, F.lit("#"), (i + 1).cast("string")))
    said = lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("Rule: "), n, F.lit(" (continued)\n\n"), x))
    return F.transform(c, lambda x, i: F.struct(ref(i).alias("section_ref"), said(x, i).alias("chunk")))


#: Elements whose content isn't shown, and those that begin and end a line; fixed values.
SKIPPED = ("script", "style", "noscript", "svg", "form")
BLOCKS = ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "section", "article", "pre", "blockquote")
#: A tag: slash of an end tag, name, slash of an empty element.
_TAG = r"(?s)<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(/?)>"


def _page_text(bare_entities: bool):
    def page_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        from html import unescape
        from html.entities import html5
        from itertools import accumulate

        raw, tag = re.compile(r"(?is)(<(script|style)\b[^>]*>).*?(?=</\2|\Z)"), re.compile(_TAG)
        hidden = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*>")
        entity = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([a-zA-Z][a-zA-Z0-9]*));")
        closed = lambda x: entity.sub(lambda m: unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], x)
        decoded = unescape if bare_entities else closed

        def text(page: str) -> str:
            # pieces: text, then slash, name, slash and text for each tag
            pieces = tag.split(hidden.sub("", raw.sub(r"\1", page)))
            names = [n.lower() for n in pieces[2::4]]
            depth = [0, *accumulate((0 if n not in SKIPPED or empty else -1 if end else 1 for end, n, empty in zip(pieces[1::4], names, pieces[3::4])), lambda d, x: max(0, d + x))]
            breaks = ["", *("\n" * ((n in BLOCKS) + (n in BLOCKS and empty != "")) for n, empty in zip(names, pieces[3::4]))]
            shown = (decoded(x) if d == 0 else "" for x, d in zip(pieces[::4], depth))
            return "".join(b + x * bool(x.strip()) for b, x in zip(breaks, shown))

        for part in pages:
            yield part.map(text, na_action="ignore")

    return F.pandas_udf(page_text, StringType())


def page_text(html: Col, bare_entities: bool = True) -> Column:
    """What a page shows: no content of skipped elements, a line end at both ends of blocks, entities decoded, blank runs left out.

    bare_entities: whether the old entities that browsers know without their semicolon are decoded so too (&amp at a cut); else only those that end in one.
    Pages are split at their tags; running sums of begun and ended skipped elements tell the shown pieces. One pass over each page in Python,
    as broken markup and the table of entities are beyond patterns; page_text_native does without.
    """
    return _page_text(bare_entities)(_c(html))


def page_text_native(html: Col) -> Column:
    """The same by patterns alone, without entities: for pages without nested skipped elements."""
    t = F.regexp_replace(_c(html), r"(?s)<!--.*?-->|<[!?][^>]*>", "")
    t = F.regexp_replace(t, rf"(?is)<({'|'.join(SKIPPED)})\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, rf"(?i)</?({'|'.join(BLOCKS)})\b[^>]*>", "\n")
    return F.regexp_replace(t, r"<[^>]*>", "")


def parsed_report(raw: Col) -> Column:
    """The JSON object in a model's answer as a VARIANT; null if there is none or text follows it."""
    r = _c(raw)
    fenced = F.regexp_extract(r, r"(?s)```(?:json)?\s*\n(.*?)\n\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(r)
    at = F.locate("{", body)
    return F.when(at > 0, whole_json(F.substring(body, at, F.length(body))))


def how_to_fix_text(value: Column) -> Column:
    """A VARIANT text as it is, a list of texts as numbered lines."""
    steps = F.try_variant_get(value, "$", "array<string>")
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), numbered).otherwise(F.try_variant_get(value, "$", "string"))


def leaks(text: Col) -> Column:
    return F.coalesce(_c(text).rlike(r"(?i)CVE-\d{4}-\d+|cpe:2\.3:"), F.lit(False))


#: What a command may begin with, and its placeholders; fixed values.
SHELL_COMMANDS = ["apt-get", "apt", "dnf", "yum", "pacman", "zypper", "brew", "systemctl", "service", "ufw", "firewall-cmd", "freshclam"]
POWERSHELL_COMMANDS = [
    "install-module", "update-module", "uninstall-module", "set-mppreference", "update-mpsignature", "enable-windowsoptionalfeature",
    "disable-windowsoptionalfeature", "set-netfirewallprofile", "enable-netfirewallrule", "disable-netfirewallrule",
    "set-smbserverconfiguration", "set-itemproperty", "disable-localuser", "new-item", "set-executionpolicy", "winget",
    "restart-service", "new-netfirewallrule", "stop-service",
]
PLACEHOLDERS = ["service", "package", "fixed_version", "port", "path"]
PLACEHOLDER = r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"


#: Pieces of a command: single quotes, double quotes, an escape, blanks, plain characters; and what double quotes hold.
_PIECES = r"""(?s)('[^']*+(?:'|\z)|"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|\\(?:.|\z)|[ \t\r\n]++|[^'"\\ \t\r\n]++)"""
_HELD = r'(?s)^"((?:[^"\\]++|\\.)*+)'


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shell_words(command: Col) -> Column:
    """words, open (what is left open at the end: quote, escape or null), bare (what stands outside of all quotes and escapes) and live (bare, and what stands in double quotes).

    A fold over the pieces: single quotes keep all, double quotes let \\ escape " and itself, outside of quotes \\ escapes any character; quoted and plain pieces side by side are one word.
    """
    none = F.array().cast("array<string>")
    first = lambda x: F.substring(x, 1, 1)
    blank = lambda x: first(x).isin(" ", "\t", "\r", "\n")
    held = lambda x: F.regexp_extract(x, _HELD, 1)
    said = lambda x: (
        F.when(first(x) == "'", F.replace(x, F.lit("'"), F.lit(""))).when(first(x) == '"', F.regexp_replace(held(x), r'\\(["\\])', "$1"))
        .when(first(x) == "\\", F.substring(x, F.lit(2), F.length(x))).otherwise(x)
    )
    live = lambda x: F.when(first(x).isin("'", "\\"), "").when(first(x) == '"', F.regexp_replace(held(x), r"(?s)\\.", "")).otherwise(x)

    def step(a: Column, x: Column) -> Column:
        ends = blank(x) & a["word"].isNotNull()
        return F.struct(
            F.when(~blank(x), F.concat(F.coalesce(a["word"], F.lit("")), said(x))).alias("word"),
            F.when(ends, F.array_append(a["words"], a["word"])).otherwise(a["words"]).alias("words"),
        )

    begin = F.struct(F.lit(None).cast("string").alias("word"), none.alias("words"))
    end = lambda a: F.when(a["word"].isNull(), a["words"]).otherwise(F.array_append(a["words"], a["word"]))

    def parts(pieces: Column) -> Column:
        last = F.get(pieces, F.size(pieces) - 1)
        left = (
            F.when((first(last) == "'") & ((F.length(last) == 1) | ~F.endswith(last, F.lit("'"))), "quote").when((first(last) == "\\") & (F.length(last) == 1), "escape")
            .when((first(last) == '"') & last.rlike(_HELD + r"\\\z"), "escape").when((first(last) == '"') & ~last.rlike(_HELD + r'"\z'), "quote")
        )
        bare = F.array_join(F.filter(pieces, lambda x: ~first(x).isin("'", '"', "\\")), "")
        return F.struct(F.aggregate(pieces, begin, step, end).alias("words"), left.alias("open"), bare.alias("bare"), F.array_join(F.transform(pieces, live), "").alias("live"))

    return _once(F.regexp_extract_all(F.coalesce(_c(command), F.lit("")), F.lit(_PIECES), 1), parts)


def command_errors(template: Col, shell: Col, in_quotes: tuple[bool, ...]) -> Column:
    """The errors of command_error for each of in_quotes; the command is read once for all of them."""
    t = F.coalesce(_c(template), F.lit(""))
    unknown = F.array_except(F.regexp_extract_all(t, F.lit(PLACEHOLDER), 1), F.array(*map(F.lit, PLACEHOLDERS)))
    bash = _c(shell) == "bash"
    bare = F.regexp_replace(t, PLACEHOLDER, "PLACEHOLDERVAL")
    odd = lambda text, q: F.length(F.regexp_replace(text, f"[^{q}]", "")) % 2 == 1

    def read(x: Column) -> Column:
        bare, parts = x["bare"], x["parts"]
        words = F.when(bash, parts["words"]).otherwise(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
        first = _once(words, lambda w: F.when(bash & (F.get(w, F.lit(0)) == "sudo"), F.get(w, F.lit(1))).otherwise(F.get(w, F.lit(0))))
        left = F.when(bash, parts["open"]).when(odd(bare, "'") | odd(bare, '"'), "quote")
        anywhere = bare.rlike(r"[;|`<>]|&&|\$\(")
        outside = F.when(bash, parts["bare"].rlike("[;|<>]|&&") | parts["live"].rlike(r"`|\$\(")).otherwise(anywhere)
        return F.struct(first.alias("first"), left.alias("left"), anywhere.alias("anywhere"), outside.alias("outside"))

    def error(x: Column, quoted: bool) -> Column:
        allowed = F.when(bash, x["first"].isin(SHELL_COMMANDS)).otherwise(F.lower(x["first"]).isin(POWERSHELL_COMMANDS))
        return (
            F.when(~_c(shell).isin("bash", "powershell") | _c(shell).isNull(), "unknown shell")
            .when(F.size(unknown) > 0, F.concat(F.lit("unknown placeholder "), F.get(unknown, F.lit(0))))
            .when(x["anywhere"] if quoted else x["outside"], "chaining, redirection or substitution")
            .when(F.contains(t, F.lit("\n")), "more than one line")
            .when(x["left"].isNotNull(), F.concat(F.lit("open "), x["left"]))
            .when(x["first"].isNull(), "empty command")
            .when(~allowed, F.concat(F.lit("not allowed: "), x["first"]))
        )

    parsed = _once(bare, lambda b: F.struct(b.alias("bare"), F.when(bash, shell_words(b)).alias("parts")))
    return _once(_once(parsed, read), lambda x: F.array(*[error(x, q) for q in in_quotes]))


def command_error(template: Col, shell: Col, in_quotes: bool = True) -> Column:
    """Null for a single plain call of an allowed command, else what is wrong with it. shell: bash or powershell.

    in_quotes: whether chaining counts in quotes too, where a shell would take it as text.
    """
    return F.get(command_errors(template, shell, (in_quotes,)), F.lit(0))


def command_checks(template: Col, shell: Col, now: Column) -> Column:
    """The checks (in_quotes, and c as command_check has it) with chaining counted in quotes and without."""
    both = (True, False)
    kept = lambda e: F.struct(e.isNull().alias("ok"), F.concat(_c(shell), F.lit("-words")).alias("validator"), e.alias("error"), now.alias("checked_at"))
    return F.transform(command_errors(template, shell, both), lambda e, i: F.struct((i == 0).alias("in_quotes"), kept(e).alias("c")))


def command_check(template: Col, shell: Col, now: Column, in_quotes: bool = True) -> Column:
    """The row that is kept of a check: ok, validator, error, checked_at."""
    error = command_error(template, shell, in_quotes)
    return F.struct(error.isNull().alias("ok"), F.concat(_c(shell), F.lit("-words")).alias("validator"), error.alias("error"), now.alias("checked_at"))


def filled(template: Col, values: dict[str, Column]) -> Column:
    """The template with its {names} filled; null if it uses one without a value."""
    t = _c(template)
    known = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", k) for k, v in values.items()]))
    lacking = F.size(F.array_except(F.regexp_extract_all(t, F.lit(r"\{(\w+)\}"), 1), known)) > 0
    out = t
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return F.when(~lacking, out)
