"""Product names and versions: parts of a product string, version order, version ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import Col, _c


def _pieces(cpe: Col) -> Column:
    return F.split(F.regexp_replace(_c(cpe), r"^cpe:(2\.3:|/)", ""), ":")


def cpe_part(cpe: Col) -> Column:
    return F.get(_pieces(cpe), F.lit(0))


def cpe_base(cpe: Col) -> Column:
    """cpe:2.3:part:vendor:product; null with fewer pieces. Escaped colons aren't known."""
    p = _pieces(cpe)
    return F.when(F.size(p) >= 3, F.concat(F.lit("cpe:2.3:"), F.array_join(F.slice(p, 1, 3), ":")))


def cpe_version(cpe: Col) -> Column:
    p = _pieces(cpe)
    v = F.get(p, F.lit(3))
    return F.when(F.size(p) >= 3, F.when(v.isNull() | v.isin("", "*", "-"), F.lit("*")).otherwise(v))


def as_cpe23(cpe: Col) -> Column:
    return F.regexp_replace(_c(cpe), r"^cpe:/", "cpe:2.3:")


def humanized(cpe: Col) -> Column:
    """The product with capitals after every non-letter, and the version if there is one."""
    words = F.translate(F.element_at(F.split(cpe_base(cpe), ":"), -1), "_", " ")
    letters = F.regexp_extract_all(words, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    title = F.array_join(F.transform(letters, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")
    v = cpe_version(cpe)
    return F.when(v == "*", title).otherwise(F.concat_ws(" ", title, v))


def version_key(version: Col) -> Column:
    """The leading dotted numbers; arrays of them compare like versions. Empty if there are none."""
    head = F.regexp_extract(F.coalesce(_c(version), F.lit("")), r"^(\d+(\.\d+)*)", 1)
    return F.when(head == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(head, r"\."), lambda x: x.try_cast("bigint")))


def parsed_version(version: Col) -> Column:
    """What version_in_range reads of a version: its first word and its key."""
    t = F.split_part(F.coalesce(_c(version), F.lit("")), F.lit(" "), F.lit(1))
    return F.struct(t.alias("text"), version_key(t).alias("key"))


def parsed_range(exact: Col, start: Col, end: Col) -> Column:
    """What version_in_range reads of a record."""
    x, lo, hi = (F.coalesce(_c(v), F.lit("")) for v in (exact, start, end))
    return F.struct(x.alias("exact"), lo.alias("low"), hi.alias("high"), version_key(lo).alias("low_key"), version_key(hi).alias("high_key"))


def in_parsed_range(version: Col, bounds: Col) -> Column:
    """version_in_range over parsed sides: comparisons only, fit for the condition of a join."""
    v, r = _c(version), _c(bounds)
    t, tk, x, lo, hi, lk, hk = v["text"], v["key"], r["exact"], r["low"], r["high"], r["low_key"], r["high_key"]
    exactly = (t == x) | (F.startswith(t, x) & F.substring(t, F.length(x) + 1, F.lit(1)).isin(".", "-", "p", "_"))
    above = (lo == "") | ((F.size(lk) > 0) & (lk <= tk) & ((hi != "") | (F.get(tk, F.lit(0)) <= F.get(lk, F.lit(0)) + 1)))
    below = (hi == "") | ((F.size(hk) > 0) & (tk <= hk))
    ranged = ((lo != "") | (hi != "")) & (F.size(tk) > 0) & above & below
    found = F.when((x != "") & (x != "*"), exactly).otherwise(ranged)
    return F.coalesce(~t.isin("", "*") & found, F.lit(False))


def version_in_range(target: Col, exact: Col, start: Col, end: Col) -> Column:
    """Whether a version is the exact one (or goes on from it after . - p _), or else lies in the bounds.

    Without an end, a version more than one major number past the start is out. A bound that isn't a version matches nothing.
    """
    return in_parsed_range(parsed_version(target), parsed_range(exact, start, end))


def plausible_version(version: Col) -> Column:
    return F.coalesce(_c(version).rlike(r"^[0-9]+(\.[0-9]+){0,4}[a-z0-9]*\z"), F.lit(False))


def bumped(version: Col) -> Column:
    """The last run of digits, one higher."""
    v = _c(version)
    part = lambda i: F.regexp_extract(v, r"^(.*?)(\d+)(\D*)$", i)
    return F.when(part(2) == "", v).otherwise(F.concat(part(1), (part(2).cast("bigint") + 1).cast("string"), part(3)))
