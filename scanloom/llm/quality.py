"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Each rule's cost and share of rejections are estimated on a sample of the rows that pass the base rule; rules then
stand in one CASE in the order of rejections per cost, so that a row leaves at the first rule that rejects it. The
next rule is always the best for the rows that those before it leave. A rule's cost is the number of elements that it looks at (words,
lines, or one comparison; a test of a line weighs 2 or 3 by the patterns it holds), counted on the sample, so that equal samples give equal orders. The order changes
the work and never the verdict, which is that no rule rejects; the result records it in rule_order. The base measures are results, so they
are computed for every row: what short-circuiting saves are the rules that look at words and lines.

A null text has no word. Whole texts are measured, whatever their length. Rows are independent: repeated ids and rows each get a row. Other columns stay; the
added names get a suffix _ where they are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

#: Rows that the estimate looks at, about; the verdicts cover every row.
SAMPLE_ROWS = 2_000

#: The contract's white space and symbols; fixed values.
WHITE_CLASS = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOL_CLASS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: a lambda variable isn't computed again for each element."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words in 3-word windows that are found twice or more. windows: a hash of each window, in text order.

    Equal hashes stand together once sorted; from the sorted places p of repeated windows, each covers
    3 words, or as many as lie before the next place.
    """

    def places(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        flagged = F.filter(at, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(flagged, lambda i: F.get(s, i)["p"]))

    def count(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(let(pairs, places), count))


def _measures(text: Column) -> Column:
    """words, lines and the base measures of a text."""

    def of(words: Column) -> Column:
        n = F.size(words)
        windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        )
        return F.struct(
            words.alias("words"),
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            let(windows, _covered).alias("n_repeat_words"),
        )

    return let(F.filter(F.split(text, WHITE_CLASS), lambda w: w != ""), of)


def measured(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with a column of measures, and the names that it took."""
    names = {k: free_name(docs.columns, k) for k in ("measures", "lines")}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    return docs.withColumns({names["measures"]: _measures(text), names["lines"]: with_word}), names


def base(names: dict[str, str], text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    m, lines = F.col(names["measures"]), F.col(names["lines"])
    return {
        "n_words": m["n_words"],
        "word_chars": m["word_chars"],
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOL_CLASS, ""))).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": m["n_repeat_words"],
    }


def rules(b: dict[str, Column], names: dict[str, str]) -> dict[str, Column]:
    """Each is true where it rejects. Whole numbers only, so that every engine agrees."""
    words, lines = F.col(names["measures"])["words"], F.col(names["lines"])
    part = lambda xs, test: F.size(F.filter(xs, test))
    return {
        "word_length": (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"]),
        "symbols": 10 * b["n_symbols"] > b["n_words"],
        "repeated_lines": 10 * b["n_dup_lines"] > 3 * F.size(lines),
        "lettered_words": 10 * part(words, lambda w: w.rlike(r"\p{L}")) < 6 * b["n_words"],
        "cut_lines": 10 * part(lines, lambda x: x.endswith("...") | x.endswith("…")) > 3 * F.size(lines),
        "bullet_lines": 10 * part(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•")) > 9 * F.size(lines),
    }


def base_failed(b: dict[str, Column]) -> Column:
    return (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])


def costs(names: dict[str, str]) -> dict[str, Column]:
    """Elements that each rule looks at in a row: comparisons of measures that are there count 1; a pattern on a word or a test of a line counts 1 for each."""
    words, lines, one = F.size(F.col(names["measures"])["words"]), F.size(F.col(names["lines"])), F.lit(1)
    return {"word_length": 2 * one, "symbols": one, "repeated_lines": one, "lettered_words": one + words, "cut_lines": one + 2 * lines, "bullet_lines": one + 3 * lines}


def estimate(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, share that it rejects of the rows that reach it, elements a row), in the order of the cascade, from about sample_rows rows in one job."""
    # a limit would gather that many rows of every partition in one task
    share = min(1.0, sample_rows / max(1, docs.count()))
    some, names = measured(docs.select(text_col).sample(share, seed=5), text_col)
    b = base(names, text_col)
    found, looked = rules(b, names), costs(names)
    seen = some.where(~base_failed(b)).select(*[x.alias(k) for k, x in found.items()], *[looked[k].alias(f"{k}_cost") for k in found])
    # a row for each combination of verdicts: 2 ** rules at most
    kinds = seen.groupBy(*found).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{k}_cost").alias(f"{k}_cost") for k in found]).collect()
    order, left = [], list(found)
    while left:
        total = sum(r["n"] for r in kinds)
        rated = [(sum(r["n"] for r in kinds if r[k]) / total if total else 0.0, sum(r[f"{k}_cost"] for r in kinds) / total if total else 1.0, k) for k in left]
        hit, cost, best = min(rated, key=lambda x: (-x[0] / x[1], x[1], x[2]))
        order.append((best, hit, cost))
        left.remove(best)
        kinds = [r for r in kinds if not r[best]]
    return order


def cascade(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """docs with the base measures, base_failed, kept, rejected_by (the first rule that rejected, or base, or null) and rule_order. order: None estimates it."""
    order = [k for k, _, _ in estimate(docs, text_col)] if order is None else order
    rows, names = measured(docs, text_col)
    b = base(names, text_col)
    taken = {k: free_name(docs.columns, k) for k in [*b, "base_failed", "kept", "rejected_by", "rule_order"]}
    rows = rows.withColumns({taken[k]: x for k, x in b.items()})
    b = {k: F.col(taken[k]) for k in b}
    verdict, found = F.when(base_failed(b), F.lit("base")), rules(b, names)
    for k in order:
        verdict = verdict.when(found[k], F.lit(k))
    rows = rows.withColumn(taken["base_failed"], base_failed(b)).withColumn(taken["rejected_by"], verdict)
    rows = rows.withColumn(taken["kept"], F.col(taken["rejected_by"]).isNull()).withColumn(taken["rule_order"], F.lit(", ".join(order)))
    return rows.drop(*names.values())


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
win as (
  select doc_id, unnest(range(1, len(w) - 1)) as p, w from t where len(w) >= 3),
grams as (
  select doc_id, p, count(*) over (partition by doc_id, w[p], w[p + 1], w[p + 2]) as c from win),
repeats as (
  select doc_id, count(distinct p + d) as n from grams, range(3) r(d) where c >= 2 group by doc_id),
m as (
  select t.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(repeats.n, 0) as bigint) as n_repeat_words,
         len(l) as n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) as lettered,
         len(list_filter(l, lambda x: ends_with(x, '...') or ends_with(x, chr(8230)))) as cut,
         len(list_filter(l, lambda x: starts_with(x, '- ') or starts_with(x, '* ') or starts_with(x, chr(8226)))) as bullets
  from t left join repeats on t.doc_id = repeats.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words
            or 10 * n_dup_lines > 3 * n_lines or 10 * lettered < 6 * n_words or 10 * cut > 3 * n_lines or 10 * bullets > 9 * n_lines) as kept
from f
"""
