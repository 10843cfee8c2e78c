"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant and all
others as named users; only the assistant's words and their end mark are to be learned. A row is one
rendered turn with its place in the rendered dialogue, so that a dialogue of any length spreads over tasks:
the turns of one perspective in order, put together, are its text.

Places are running sums in two steps, within range partitions of all rendered turns and over the partitions' sums, so
that no window holds a whole long dialogue, whether its turns are numbered, share a number or have none. Speakers meet
their dialogue's turns as one array of names, which a dialogue has few of, and not in a join. Turns are ordered by
number (null first), role and the MD5 of the text; repeated rows stay. Texts of any length stay whole.
A user's name is the speaker's with `\\`, `<|` and line ends escaped, so that no two speakers get one name, in any script.
A null or empty role is the speaker `unknown`, a null text is empty, and each row without a dialogue id is a dialogue of its own
whose id is null, so that unrelated rows never meet. A dialogue gives a row for each of its turns and speakers, which is what rotation is. Roles in `system` speak as system in every perspective and have none of their own. Marks in a text
are broken by a space, so that no text ends a turn. Other columns are left out, clashing names among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written


def rotated(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, learned (boolean), start, end, learn_start, learn_end (characters; null if not learned)."""
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.nullif(F.col(role_col).cast("string"), F.lit("")), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("< |im_")).alias("said"),
        F.monotonically_increasing_id().alias("tie"),
    )
    is_system = F.col("speaker").isin(list(system))
    alone = rows.where(F.col("conv_id").isNull() & ~is_system)
    rows = rows.where("conv_id is not null")
    people = rows.where(~is_system).groupBy("conv_id").agg(F.array_sort(F.collect_set("speaker")).alias("people"))
    # a dialogue without speakers has no perspective; the small side is a row for each dialogue
    seen = _with_people(rows, people).select("*", F.explode("people").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(is_system, F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), escaped("speaker"), F.lit("\n")))
    keys, order = ["conv_id", "perspective"], [F.col("turn").asc_nulls_first(), F.col("speaker"), F.md5("said")]
    seen = seen.select(*keys, "turn", "speaker", "said", "tie", own.alias("learned"), head.alias("head"), (F.length(head) + F.length("said") + len("<|im_end|>\n")).cast("bigint").alias("chars"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal turns are told apart by their place in the input, so that many of them spread too; the table fixes what lies where
    dealt = seen.repartitionByRange(parts, *keys, *order, "tie").drop("tie").withColumn("block", F.spark_partition_id())
    dealt = written(dealt, "chat-blocks")
    sums = dealt.groupBy(*keys, "block").agg(F.sum("chars").alias("block_chars"))
    before = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # a row for each range partition that a perspective reaches
    sums = sums.select(*[F.col(k).alias(f"of_{k}") for k in (*keys, "block")], F.coalesce(F.sum("block_chars").over(before), F.lit(0)).alias("block_start"))
    matched: Column = F.lit(True)
    for k in (*keys, "block"):
        matched = matched & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inside = W.partitionBy(*keys, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(sums, matched).withColumn("start", F.col("start") + F.col("block_start"))
    placed = placed.withColumns({"rendered": F.concat("head", "said", F.lit("<|im_end|>\n")), "head_chars": F.length("head").cast("bigint")})
    mine = F.concat(F.lit("<|im_start|>assistant\n"), F.col("said"), F.lit("<|im_end|>\n"))
    alone = alone.select(
        "conv_id", F.col("speaker").alias("perspective"), "turn", "speaker", F.lit(True).alias("learned"), F.lit(0).cast("bigint").alias("start"), mine.alias("rendered"),
        F.length(mine).cast("bigint").alias("chars"), F.lit(len("<|im_start|>assistant\n")).cast("bigint").alias("head_chars"),
    )
    placed = placed.select(alone.columns).unionByName(alone)
    end = F.col("start") + F.col("chars")
    return placed.select(
        *keys, "turn", "speaker", "rendered", "learned", "start", end.alias("end"),
        F.when(F.col("learned"), F.col("start") + F.col("head_chars")).alias("learn_start"),
        F.when(F.col("learned"), end - 1).alias("learn_end"),
    )


def escaped(name: str) -> Column:
    """A speaker as a name of one line without marks; different speakers stay different."""
    out = F.col(name)
    for a, b in (("\\", "\\\\"), ("<|", "<\\|"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _with_people(rows: DataFrame, people: DataFrame) -> DataFrame:
    """rows with the speakers of their dialogue. Adaptive execution splits a large dialogue's side, as the other has one row for it."""
    of = people.withColumnRenamed("conv_id", "of")
    return rows.join(of, F.col("conv_id") == F.col("of")).drop("of")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
with t as (
  select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(nullif(role, ''), 'unknown') as speaker,
         replace(coalesce(text, ''), '<|im_', '< |im_') as said
  from conversations),
p as (select distinct conv_id, own, speaker as perspective from t where speaker <> 'system'),
h as (
  select t.conv_id, t.own, perspective, turn, speaker, said, speaker = perspective as learned,
         case when speaker = perspective then '<|im_start|>assistant' || chr(10)
              when speaker = 'system' then '<|im_start|>system' || chr(10)
              else '<|im_start|>user name=' || replace(replace(replace(replace(speaker, '\', '\\'), '<|', '<\|'), chr(10), '\n'), chr(13), '\r') || chr(10) end as head
  from t join p on t.conv_id is not distinct from p.conv_id and t.own is not distinct from p.own),
r as (select *, head || said || '<|im_end|>' || chr(10) as rendered from h),
s as (
  select *, cast(coalesce(sum(length(rendered)) over (partition by conv_id, own, perspective order by turn nulls first, speaker, md5(said)
                                                      rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from r)
select conv_id, perspective, turn, speaker, rendered, learned, start, start + length(rendered) as "end",
       case when learned then start + length(head) end as learn_start,
       case when learned then start + length(rendered) - 1 end as learn_end
from s
"""
